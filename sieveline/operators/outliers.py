"""Statistical outliers of numeric columns: IQR fences, z-scores, or either."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sieveline.functions.columns import NUMERIC_KINDS, count_if, double, kinds, number, ref, slot_name
from sieveline.functions.fixed import EXAMPLE_VALUES, MIN_VALUES_FOR_OUTLIERS
from sieveline.operators.aggregate import aggregate_row, side_by_side
from sieveline.operators.quantiles import Quantiles, quantiles
from sieveline.options import Options, OutlierOptions

QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class NumericStats:
    """Moments and quartiles of the present values of one column."""

    column: str
    n: int
    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    std: float | None = None
    std_pop: float | None = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None

    def fences(self, multiplier: float) -> tuple[float, float] | None:
        """IQR fences, or None where there are too few values or the quartiles are not finite."""
        if self.n < MIN_VALUES_FOR_OUTLIERS or self.q1 is None:
            return None
        spread = self.q3 - self.q1
        low, high = self.q1 - multiplier * spread, self.q3 + multiplier * spread
        return None if math.isnan(low) or math.isnan(high) else (low, high)

    def outside_fences(self, value: str, multiplier: float) -> str | None:
        fences = self.fences(multiplier)
        return fences and f"({value} < {double(fences[0])} OR {value} > {double(fences[1])})"

    def zscore(self, value: str) -> str | None:
        """abs(value - mean) / population std, or None where it is undefined or always 0."""
        usable = self.n >= MIN_VALUES_FOR_OUTLIERS and self.std_pop and math.isfinite(self.std_pop)
        return f"abs({value} - {double(self.mean)}) / {double(self.std_pop)}" if usable else None

    def is_outlier(self, value: str, rules: OutlierOptions) -> str | None:
        """SQL condition for the chosen method, or None where no value can be an outlier."""
        by_fence = self.outside_fences(value, rules.iqr_multiplier) if rules.method != "zscore" else None
        z = self.zscore(value) if rules.method != "iqr" else None
        by_z = z and f"{z} > {double(rules.zscore_threshold)}"
        conditions = [c for c in (by_fence, by_z) if c]
        return f"({' OR '.join(conditions)})" if conditions else None


@dataclass(frozen=True)
class ColumnOutliers:
    stats: NumericStats
    n_outliers: int
    lower_fence: float | None
    upper_fence: float | None
    max_zscore: float | None

    @property
    def column(self) -> str:
        return self.stats.column

    @property
    def outlier_pct(self) -> float:
        return self.n_outliers / self.stats.n


def moment_expressions(df: DataFrame, columns: list[str] | None = None) -> dict[tuple[str, str], str]:
    """Aggregates behind ``moments``, to share a scan with others."""
    return {
        (name, part): f"{function}({number(name, kind)})" for name, kind in kinds(df).items()
        if kind in NUMERIC_KINDS and (columns is None or name in columns)
        for part, function in (("count", "count"), ("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp"))
    }


def moments_from(seen: dict[tuple[str, str], float]) -> dict[str, NumericStats]:
    result = {}
    for name in [name for name, part in seen if part == "mean"]:
        n, std = seen[name, "count"], seen[name, "std"]
        pop = std * math.sqrt((n - 1) / n) if std is not None else 0.0 if n else None
        result[name] = NumericStats(name, n, *[seen[name, part] for part in ("min", "max", "mean")], std, pop)
    return result


def moments(df: DataFrame, columns: list[str] | None = None) -> dict[str, NumericStats]:
    """Count, min, max, mean and standard deviations of numeric columns in one scan."""
    return moments_from(aggregate_row(df, moment_expressions(df, columns)))


def column_quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...],
                     options: Options = Options(), weight: str | None = None) -> dict[str, Quantiles]:
    column_kinds = kinds(df)
    return quantiles(df, {name: number(name, column_kinds[name]) for name in columns}, probabilities,
                     options.scale.exact_quantiles, weight=weight)


def with_quartiles(stats: dict[str, NumericStats], found: dict[str, Quantiles]) -> dict[str, NumericStats]:
    """The moments with the quartiles or the median added, whichever were asked for."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    return {
        name: NumericStats(**{**s.__dict__, **{names[p]: value for p, value in found[name].values.items()}})
        for name, s in stats.items()
    }


def numeric_stats(df: DataFrame, options: Options = Options(), columns: list[str] | None = None,
                  probabilities: tuple[float, ...] = QUARTILES) -> dict[str, NumericStats]:
    """Moments and quartiles of numeric columns, from jobs that run side by side."""
    names = [n for n, k in kinds(df).items() if k in NUMERIC_KINDS and (columns is None or n in columns)]
    by_column, found = side_by_side(
        df.sparkSession, lambda: moments(df, names), lambda: column_quantiles(df, names, probabilities, options))
    return with_quartiles(by_column, found)


def outliers(df: DataFrame, options: Options = Options(),
             stats: dict[str, NumericStats] | None = None, columns: list[str] | None = None) -> dict[str, ColumnOutliers]:
    """Outliers of every numeric column that has any, by the method in the options."""
    rules = options.outliers
    if stats is None:
        stats = moments(df, columns) if rules.method == "zscore" else numeric_stats(df, options, columns)
    column_kinds = kinds(df)
    wanted = {}
    for name, of_column in stats.items():
        value = number(name, column_kinds[name])
        condition = of_column.is_outlier(value, rules)
        if condition:
            wanted[name, "n"] = count_if(condition)
        if rules.method == "zscore" and of_column.zscore(value):
            wanted[name, "z"] = f"max({of_column.zscore(value)})"
    seen = aggregate_row(df, wanted)
    result = {}
    for name, of_column in stats.items():
        if seen.get((name, "n")):
            low, high = (of_column.fences(rules.iqr_multiplier) or (None, None)) if rules.method != "zscore" else (None, None)
            result[name] = ColumnOutliers(of_column, seen[name, "n"], low, high, seen.get((name, "z")))
    return result


def _rounded(value: float | None, digits: int = 4) -> float | None:
    return None if value is None else round(value, digits)


def outlier_table(df: DataFrame, found: dict[str, ColumnOutliers]) -> DataFrame:
    """One row per column with outliers; numbers rounded to four digits."""
    return df.sparkSession.createDataFrame(
        [(o.column, o.stats.n, o.n_outliers, _rounded(o.outlier_pct), _rounded(o.lower_fence), _rounded(o.upper_fence),
          _rounded(o.stats.q1), _rounded(o.stats.q3), _rounded(o.max_zscore)) for o in found.values()],
        "column string, n_values long, n_outliers long, outlier_pct double, lower_fence double, upper_fence double, "
        "q1 double, q3 double, max_zscore double",
    )


def stats_table(df: DataFrame, stats: dict[str, NumericStats], digits: int = 4) -> DataFrame:
    """One row per numeric column; numbers rounded."""
    return df.sparkSession.createDataFrame(
        [(s.column, s.n, *[_rounded(v, digits) for v in (s.minimum, s.maximum, s.mean, s.std, s.q1, s.median, s.q3)])
         for s in stats.values()],
        "column string, n_values long, min_value double, max_value double, mean_value double, std_value double, "
        "q1 double, median double, q3 double",
    )


def outlier_examples(df: DataFrame, found: dict[str, ColumnOutliers], options: Options = Options(),
                     row_id: str | None = None, with_ids: bool = False) -> DataFrame:
    """Up to five outlier values per column: first by row id, or the smallest distinct ones; with the row ids, if asked for.

    The ranking limit is applied per task before the shuffle, so columns full of outliers cost no more.
    """
    column_kinds = kinds(df)
    names = list(found)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, nth int, value double" + ", row_id string" * with_ids)
    cells = []
    for i, name in enumerate(names):
        value = number(name, column_kinds[name])
        cells.append(f"CASE WHEN {found[name].stats.is_outlier(value, options.outliers)} THEN {value} END AS v{i}")
    labels = [f"v{i}" for i in range(len(names))]
    ids = [f"{ref(row_id)} AS row_id"] if row_id else []
    flagged = (
        df.selectExpr(*ids, *cells).where(" OR ".join(f"{label} IS NOT NULL" for label in labels))
        .unpivot(["row_id"] if row_id else [], labels, "slot", "value").where("value IS NOT NULL")
    )
    if not row_id:
        flagged = flagged.distinct()
    order = "row_id" if row_id else "value"
    return (
        flagged.selectExpr("slot", "value", f"row_number() OVER (PARTITION BY slot ORDER BY {order}) AS nth", *(["row_id"] if row_id else []))
        .where(f"nth <= {EXAMPLE_VALUES}").selectExpr(
            f"{slot_name(names)} AS column", "nth", "value", *([f"CAST({'row_id' if row_id else 'NULL'} AS STRING) AS row_id"] if with_ids else []))
    )
