"""Values that are valid but implausible: negatives, placeholder sentinels, extreme magnitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import NUMERIC_KINDS, count_if, double, kinds, number, ref, text
from sieveline.functions.fixed import MIN_VALUES_FOR_EXTREMES, POSITIVE_DOMAIN_HINTS, SAMPLE_ROWS
from sieveline.operators.aggregate import aggregate_row
from sieveline.operators.outliers import NumericStats, numeric_stats
from sieveline.operators.types import suggests
from sieveline.options import Options

NEGATIVE, SENTINEL, EXTREME = "negative_in_positive_domain", "common_placeholder_sentinel", "extreme_magnitude"
SCHEMA = (
    "column string, finding_type string, value double, n long, magnitude_ratio double, column_median double, "
    "sample_ids array<string>"
)


def _sentinels(options: Options) -> list[float]:
    return [value for value in options.suspicious_values.sentinel_values if value != 0.0]


def _is_negative(name: str, value: str) -> str | None:
    return f"{value} < 0" if suggests(name, POSITIVE_DOMAIN_HINTS) else None


def _is_sentinel(stats: NumericStats, value: str, options: Options) -> str | None:
    """One of the sentinels that lies far from the median; any of them where the column does not vary."""
    far = [
        s for s in _sentinels(options)
        if not (stats.std and stats.std > 0) or abs(s - stats.median) / stats.std >= options.suspicious_values.sentinel_min_z
    ]
    return f"{value} IN ({', '.join(map(double, far))})" if stats.n and far else None


def _is_extreme(stats: NumericStats, value: str, options: Options) -> str | None:
    if stats.n < MIN_VALUES_FOR_EXTREMES or not stats.median:
        return None
    listed = ", ".join(map(double, [*_sentinels(options), 0.0]))
    return (f"(abs({value}) / {double(abs(stats.median))} > {double(options.suspicious_values.extreme_ratio_threshold)} "
            f"AND {value} NOT IN ({listed}))")


def _rules(df: DataFrame, options: Options, stats: dict[str, NumericStats] | None, types: tuple[str, ...],
           columns: list[str] | None) -> list[tuple[str, str, str, str, float | None]]:
    """Column, finding type, condition, value and median of every rule that applies."""
    rules = []
    for name, kind in kinds(df).items():
        if kind not in NUMERIC_KINDS or columns is not None and name not in columns:
            continue
        value = number(name, kind)
        conditions = {NEGATIVE: _is_negative(name, value)}
        if stats is not None:
            conditions[SENTINEL] = _is_sentinel(stats[name], value, options)
            conditions[EXTREME] = _is_extreme(stats[name], value, options)
        median = stats[name].median if stats is not None else None
        rules += [(name, t, conditions[t], value, median) for t in types if conditions.get(t)]
    return rules


def suspicious_counts(df: DataFrame, options: Options, stats: dict[str, NumericStats], columns: list[str]) -> dict[str, int]:
    """Flagged cells of each column that has any (a value counts once per finding), by one aggregate without a shuffle of values."""
    rules = _rules(df, options, stats, (NEGATIVE, SENTINEL, EXTREME), columns)
    counts = aggregate_row(df, {i: count_if(rule[2]) for i, rule in enumerate(rules)}, options.scale.fields_per_pass)
    totals: dict[str, int] = {}
    for i, rule in enumerate(rules):
        if counts[i]:
            totals[rule[0]] = totals.get(rule[0], 0) + counts[i]
    return totals


def suspicious_values(df: DataFrame, options: Options = Options(), stats: dict[str, NumericStats] | None = None,
                      types: tuple[str, ...] = (NEGATIVE, SENTINEL, EXTREME), columns: list[str] | None = None,
                      row_id: str | None = None) -> DataFrame:
    """One row per finding: column, finding_type, value, n, ratio to and value of the median, sample ids.

    Only flagged cells leave the scan. They are counted per value with partial aggregation, and
    sample ids are ranked with a limit that is applied before the shuffle. Lazy once the column
    statistics are known; negatives alone need none.
    """
    column_kinds = {n: k for n, k in kinds(df).items() if k in NUMERIC_KINDS and (columns is None or n in columns)}
    if stats is None and set(types) != {NEGATIVE}:
        stats = numeric_stats(df, options, list(column_kinds), (0.5,))
    rules = _rules(df, options, stats, types, columns)
    if not rules:
        return df.sparkSession.createDataFrame([], SCHEMA)

    labels = [f"v{i}" for i in range(len(rules))]
    ids = [f"CAST({ref(row_id)} AS STRING) AS shown_id", f"{ref(row_id)} AS row_id"] if row_id else []
    kept = ["shown_id", "row_id"] if row_id else []
    flagged = (
        df.selectExpr(*ids, *[f"CASE WHEN {rule[2]} THEN {rule[3]} END AS v{i}" for i, rule in enumerate(rules)])
        .where(" OR ".join(f"{label} IS NOT NULL" for label in labels))
        .unpivot(kept, labels, "slot", "value").where("value IS NOT NULL")
    )
    found = flagged.groupBy("slot", "value").agg(F.count("*").alias("n"))
    if row_id:
        samples = (
            flagged.selectExpr("slot", "value", "shown_id",
                               "row_number() OVER (PARTITION BY slot, value ORDER BY row_id) AS nth")
            .where(f"nth <= {SAMPLE_ROWS}").groupBy("slot", "value")
            .agg(F.expr("transform(array_sort(collect_list(struct(nth, shown_id))), s -> s.shown_id)").alias("sample_ids"))
        )
        found = found.join(samples, ["slot", "value"])
    else:
        found = found.withColumn("sample_ids", F.expr("CAST(array() AS ARRAY<STRING>)"))
    columns_of, types_of, medians = (
        f"element_at(array({', '.join(parts)}), CAST(substring(slot, 2) AS INT) + 1)" for parts in (
            [text(r[0]) for r in rules], [text(r[1]) for r in rules],
            [double(r[4]) if r[1] == EXTREME else "CAST(NULL AS DOUBLE)" for r in rules])
    )
    return found.selectExpr(
        f"{columns_of} AS column", f"{types_of} AS finding_type", "value", "n",
        f"round(abs(value) / abs({medians}), 1) AS magnitude_ratio", f"round({medians}, 4) AS column_median", "sample_ids")


def suspicious_totals(findings: DataFrame) -> DataFrame:
    """One row: flagged cells (a value counts once per finding) and affected columns."""
    return findings.selectExpr("coalesce(sum(n), 0) AS total_suspicious_cells",
                               "count(DISTINCT column) AS affected_columns")
