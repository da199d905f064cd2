"""A cleaning plan: the ordered fixes with every constant fitted, storable as JSON.

Replaying a plan on later data uses the fitted constants; to learn new ones, profile and fit the
new data.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from sieveline.errors import PlanError
from sieveline.operators import fixes
from sieveline.operators.duplicates import Copies, find_copies
from sieveline.options import Options

STEPS = (
    "drop_duplicates", "constant_columns", "type_caster", "category_normalizer", "missing_values", "outlier_handler",
)
FORMAT = 1

_EXTRA_FIXES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_fix(name: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Apply ``change(table)`` after the six built-in steps of every run, and where a plan names it."""
    if name in STEPS:
        raise PlanError(f"{name!r} is the name of a built-in step")
    _EXTRA_FIXES[name] = change


def unregister_fix(name: str) -> None:
    _EXTRA_FIXES.pop(name, None)


def registered_fixes() -> list[str]:
    """Names of the own fixes, in the order they run."""
    return list(_EXTRA_FIXES)


def apply_fix(name: str, df: DataFrame) -> DataFrame:
    """The table after one own fix."""
    if name not in _EXTRA_FIXES:
        raise PlanError(f"the plan needs the fix {name!r}, which is not registered")
    return _EXTRA_FIXES[name](df)


@dataclass
class CleaningPlan:
    """Constants of every step; empty or None where the step has nothing to do."""

    columns: dict[str, str] = field(default_factory=dict)
    row_id: str | None = None
    keep: str | None = None
    constant_columns: list[str] = field(default_factory=list)
    casts: dict[str, str] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    normalize_case: bool = True
    strip_whitespace: bool = True
    sparse_columns: list[str] = field(default_factory=list)
    min_present: int | None = None
    fills: list[fixes.Fill] = field(default_factory=list)
    fences: list[fixes.Fence] = field(default_factory=list)
    action: str = "flag"
    options: dict[str, Any] = field(default_factory=dict)
    extra_fixes: list[str] = field(default_factory=list)
    dry_run: bool = False

    def check(self, df: DataFrame) -> None:
        """Raise unless every column the plan was fitted on is there with the same type."""
        types = dict(df.dtypes)
        wrong = [f"{n} ({t}, found {types.get(n, 'nothing')})" for n, t in self.columns.items() if types.get(n) != t]
        if wrong:
            raise PlanError("the table does not fit the plan: " + "; ".join(wrong))

    def apply(self, df: DataFrame, copies: Copies | None = None) -> DataFrame:
        """The cleaned table. ``copies`` must stem from this same table.

        Where copies are to go and none are given, the table is looked through for them first, by hashes of its rows. The plan
        itself then shuffles no row but those that may have a copy, unless these are too many to be broadcast.
        """
        self.check(df)
        if self.keep:
            copies = copies or find_copies(df, self.fitted_options(), self.row_id)
            df = fixes.drop_duplicates(df, self.keep, copies, self.row_id)
        return self.apply_to_rows(df)

    def apply_to_rows(self, df: DataFrame) -> DataFrame:
        """Every step but duplicate removal: one projection and filter, no shuffle, then own fixes as they are."""
        df = fixes.drop_columns(df, self.constant_columns)
        df = fixes.cast_columns(df, self.casts)
        df = fixes.normalize_categories(df, self.categories, self.normalize_case, self.strip_whitespace)
        df = fixes.drop_columns(df, self.sparse_columns)
        if self.min_present is not None:
            df = fixes.drop_sparse_rows(df, self.min_present, self.row_id, list(self.casts))
        df = fixes.fill_missing(df, self.fills)
        df = fixes.handle_outliers(df, self.fences, self.action)
        for name in self.extra_fixes:
            df = apply_fix(name, df)
        return df

    def to_json(self) -> str:
        return json.dumps({"format": FORMAT, **asdict(self)}, indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, document: str) -> "CleaningPlan":
        try:
            values = json.loads(document)
            if values.pop("format") != FORMAT:
                raise PlanError("the plan was written in another format")
            values["fills"] = [fixes.Fill(**v) for v in values["fills"]]
            values["fences"] = [fixes.Fence(**v) for v in values["fences"]]
            return cls(**values)
        except (json.JSONDecodeError, KeyError, TypeError) as error:
            raise PlanError(f"not a cleaning plan: {error}") from error

    def fitted_options(self) -> Options:
        return Options.from_dict(self.options)
