"""Options of the checks and fixes, grouped in sections, with validation and deep merge.

Precedence when merging is defaults < file < runtime overrides, key by key.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field, fields
from typing import Any

from sieveline.errors import OptionsError
from sieveline.functions.fixed import SENTINEL_VALUES


def _one_of(section: str, name: str, value: Any, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise OptionsError(f"{section}.{name} must be one of {', '.join(allowed)}; got {value!r}")


def _number(section: str, name: str, value: Any, low: float | None = None, high: float | None = None,
            above: float | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise OptionsError(f"{section}.{name} must be a number; got {value!r}")
    if low is not None and value < low or high is not None and value > high or above is not None and value <= above:
        raise OptionsError(f"{section}.{name} is out of range: {value!r}")


@dataclass(frozen=True)
class DatasetOptions:
    encoding: str = "utf-8"
    delimiter: str = ","


@dataclass(frozen=True)
class MissingOptions:
    drop_column_threshold: float = 0.8
    drop_row_threshold: float = 0.5
    numeric_imputation: str = "median"
    categorical_imputation: str = "mode"
    constant_fill_value: Any = "UNKNOWN"

    def __post_init__(self):
        _number("missing_values", "drop_column_threshold", self.drop_column_threshold, 0.0, 1.0)
        _number("missing_values", "drop_row_threshold", self.drop_row_threshold, 0.0, 1.0)
        _one_of("missing_values", "numeric_imputation", self.numeric_imputation,
                ("mean", "median", "mode", "zero", "constant", "none"))
        _one_of("missing_values", "categorical_imputation", self.categorical_imputation,
                ("mode", "constant", "none"))


@dataclass(frozen=True)
class DuplicateOptions:
    keep: str = "first"

    def __post_init__(self):
        _one_of("duplicates", "keep", self.keep, ("first", "last", "none"))


@dataclass(frozen=True)
class OutlierOptions:
    method: str = "iqr"
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    action: str = "flag"

    def __post_init__(self):
        _one_of("outliers", "method", self.method, ("iqr", "zscore", "both"))
        _number("outliers", "iqr_multiplier", self.iqr_multiplier, above=0.0)
        _number("outliers", "zscore_threshold", self.zscore_threshold, above=0.0)
        _one_of("outliers", "action", self.action, ("flag", "cap", "drop"))


@dataclass(frozen=True)
class CardinalityOptions:
    high_cardinality_threshold: float = 0.95
    near_constant_threshold: float = 0.99

    def __post_init__(self):
        _number("cardinality", "high_cardinality_threshold", self.high_cardinality_threshold, 0.0, 1.0)
        _number("cardinality", "near_constant_threshold", self.near_constant_threshold, 0.0, 1.0)


@dataclass(frozen=True)
class CategoryOptions:
    normalize_case: bool = True
    strip_whitespace: bool = True


@dataclass(frozen=True)
class TypeOptions:
    min_numeric_ratio: float = 0.95
    min_date_ratio: float = 0.8

    def __post_init__(self):
        _number("type_inference", "min_numeric_ratio", self.min_numeric_ratio, 0.0, 1.0)
        _number("type_inference", "min_date_ratio", self.min_date_ratio, 0.0, 1.0)


@dataclass(frozen=True)
class SuspiciousOptions:
    sentinel_values: tuple[float, ...] = SENTINEL_VALUES
    sentinel_min_z: float = 2.5
    extreme_ratio_threshold: float = 1000.0

    def __post_init__(self):
        object.__setattr__(self, "sentinel_values", tuple(float(v) for v in self.sentinel_values))
        _number("suspicious_values", "sentinel_min_z", self.sentinel_min_z, 0.0)
        _number("suspicious_values", "extreme_ratio_threshold", self.extreme_ratio_threshold, above=1.0)


@dataclass(frozen=True)
class ScaleOptions:
    """Physical choices; none of them changes a result unless an ``exact_*`` flag is switched off."""

    exact_quantiles: bool = True
    exact_distinct: bool = True
    fields_per_pass: int = 90
    broadcast_rows: int = 1_000_000

    def __post_init__(self):
        _number("scale", "fields_per_pass", self.fields_per_pass, low=1)
        _number("scale", "broadcast_rows", self.broadcast_rows, low=0)


@dataclass(frozen=True)
class Options:
    dataset: DatasetOptions = field(default_factory=DatasetOptions)
    missing_values: MissingOptions = field(default_factory=MissingOptions)
    duplicates: DuplicateOptions = field(default_factory=DuplicateOptions)
    outliers: OutlierOptions = field(default_factory=OutlierOptions)
    cardinality: CardinalityOptions = field(default_factory=CardinalityOptions)
    categories: CategoryOptions = field(default_factory=CategoryOptions)
    type_inference: TypeOptions = field(default_factory=TypeOptions)
    suspicious_values: SuspiciousOptions = field(default_factory=SuspiciousOptions)
    scale: ScaleOptions = field(default_factory=ScaleOptions)

    def merge(self, *overrides: dict[str, dict[str, Any]]) -> "Options":
        """A copy with each override applied in turn; later ones win, other keys stay."""
        merged = self
        for override in overrides:
            if not isinstance(override, dict):
                raise OptionsError(f"options must be a mapping of sections, got {type(override).__name__}")
            for name, values in override.items():
                section = getattr(merged, name, None)
                if not dataclasses.is_dataclass(section):
                    raise OptionsError(f"unknown option section {name!r}")
                if not isinstance(values, dict):
                    raise OptionsError(f"section {name!r} must be a mapping")
                unknown = sorted(set(values) - {f.name for f in fields(section)})
                if unknown:
                    raise OptionsError(f"unknown option(s) in {name!r}: {', '.join(unknown)}")
                merged = dataclasses.replace(merged, **{name: dataclasses.replace(section, **values)})
        return merged

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(dataclasses.asdict(self)))

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> "Options":
        return cls().merge(values)

    @classmethod
    def load(cls, path: str | None = None, overrides: dict[str, dict[str, Any]] | None = None) -> "Options":
        """Defaults, then the JSON file at ``path``, then ``overrides``."""
        options = cls()
        if path is not None:
            try:
                with open(path, encoding="utf-8") as handle:
                    options = options.merge(json.load(handle))
            except OSError as error:
                raise OptionsError(f"cannot read options file {path}: {error}") from error
            except json.JSONDecodeError as error:
                raise OptionsError(f"options file {path} is not valid JSON: {error}") from error
        return options.merge(overrides or {})
