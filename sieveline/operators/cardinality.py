"""Distinct values per column: constant, near-constant and high-cardinality columns, top values.

Columns of one type are unpivoted and counted together, so a table is scanned once per type with
only that type's columns, values are hashed in their native form, and partial aggregation
collapses frequent values before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import STRING, count_if, has_map, kinds, present, slot_name
from sieveline.functions.fixed import TOP_VALUES
from sieveline.functions.scalars import short_key
from sieveline.operators.aggregate import aggregate_row
from sieveline.options import Options


@dataclass(frozen=True)
class Distinct:
    """Distinct and present values of a column, and the count of its most frequent value."""

    column: str
    n_distinct: int
    n_values: int
    top_count: int | None


COLUMNS_PER_UNPIVOT = 40
#: Items that a sketch of frequent ones tracks: its error is then below 0.0003 of the rows, far less than LEAST_SHARE.
TRACKED, LEAST_SHARE = 10_000, 0.001


def _families(df: DataFrame, columns: list[str] | None) -> list[list[str]]:
    """Countable columns grouped by type, in batches. Maps cannot be keys and are left out."""
    groups: dict[str, list[str]] = {}
    for field in df.schema.fields:
        if (columns is None or field.name in columns) and not has_map(field.dataType):
            groups.setdefault(field.dataType.simpleString(), []).append(field.name)
    return [names[i:i + COLUMNS_PER_UNPIVOT] for names in groups.values() for i in range(0, len(names), COLUMNS_PER_UNPIVOT)]


def _family_counts(df: DataFrame, names: list[str], short: bool, weight: str | None = None) -> DataFrame:
    """slot, value, n of the present values of same-typed columns; rows may carry a weight."""
    column_kinds = kinds(df)
    cells = []
    for i, name in enumerate(names):
        cell = present(name, column_kinds[name])
        cells.append(f"{short_key(cell) if short and column_kinds[name] == STRING else cell} AS v{i}")
    labels = [f"v{i}" for i in range(len(names))]
    if weight is None:
        return (
            df.selectExpr(*cells).unpivot([], labels, "slot", "value").where("value IS NOT NULL")
            .groupBy("slot", "value").agg(F.count("*").alias("n"))
        )
    return (
        df.selectExpr(*cells, f"{weight} AS w").unpivot(["w"], labels, "slot", "value").where("value IS NOT NULL")
        .groupBy("slot", "value").agg(F.sum("w").alias("n")).where("n > 0")
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Value histogram: column, value (as text), n. One row per distinct present value."""
    parts = [
        _family_counts(df, names, short=False).selectExpr(f"{slot_name(names)} AS column", "CAST(value AS STRING) AS value", "n")
        for names in _families(df, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def _dominant_counts(df: DataFrame, names: list[str], options: Options) -> dict[str, int]:
    """The count of the most frequent value of the columns in which one has at least the near-constant share of the rows.

    A sketch of frequent items keeps every value with more than a small share of the rows, so the values that can have the
    near-constant share are among its first ones. A second scan counts those. Values are told apart by 64-bit hashes.
    """
    column_kinds, share = kinds(df), options.cardinality.near_constant_threshold
    cells = {n: f"CASE WHEN {present(n, column_kinds[n])} IS NOT NULL THEN xxhash64({present(n, column_kinds[n])}) END" for n in names}
    listed = aggregate_row(df, {n: f"transform(approx_top_k({cells[n]}, {math.ceil(1 / share) + 1}, {TRACKED}), e -> e.item)" for n in names})
    wanted = {(n, value): count_if(f"{cells[n]} = {value}L") for n in names for value in listed[n] or [] if value is not None}
    counts = aggregate_row(df, {**wanted, None: "count(1)"})
    top: dict[str, int] = {}
    for name, value in wanted:
        top[name] = max(top.get(name, 0), counts[name, value])
    return {n: count for n, count in top.items() if counts[None] and count / counts[None] >= share}


def distinct_counts(df: DataFrame, options: Options = Options(), columns: list[str] | None = None) -> dict[str, Distinct]:
    """Distinct counts of every column. Long texts are counted by digest, so they are not shuffled.

    With ``exact_distinct`` off, one scan of mergeable sketches replaces the value shuffle; the
    top count is then known only of columns that a value fills to the near-constant threshold. A
    threshold below LEAST_SHARE is too small for the sketch and is settled by the exact path.
    """
    column_kinds = kinds(df)
    names = [n for family in _families(df, columns) for n in family]
    if not options.scale.exact_distinct and options.cardinality.near_constant_threshold >= LEAST_SHARE:
        seen = aggregate_row(df, {
            (n, part): f"{function}({present(n, column_kinds[n])})" for n in names
            for part, function in (("d", "approx_count_distinct"), ("n", "count"))
        })
        top = _dominant_counts(df, names, options)
        return {n: Distinct(n, seen[n, "d"], seen[n, "n"], top.get(n)) for n in names}
    parts = [
        _family_counts(df, family, short=True).groupBy("slot")
        .agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_values"), F.max("n").alias("top_count"))
        .selectExpr(f"{slot_name(family)} AS column", "n_distinct", "n_values", "top_count")
        for family in _families(df, columns)
    ]
    rows = {row["column"]: row for row in reduce(DataFrame.unionByName, parts).collect()} if parts else {}
    return {
        n: Distinct(n, rows[n]["n_distinct"], rows[n]["n_values"], rows[n]["top_count"]) if n in rows
        else Distinct(n, 0, 0, 0)
        for n in names
    }


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES, weight: str | None = None) -> DataFrame:
    """The k most frequent values per column: column, nth, value (as text), n. Ties go to the smaller value.

    The ranking limit is applied per task before the shuffle to one group per column.
    """
    parts = [
        _family_counts(df, names, short=False, weight=weight)
        .selectExpr("*", "row_number() OVER (PARTITION BY slot ORDER BY n DESC, value) AS nth").where(f"nth <= {k}")
        .selectExpr(f"{slot_name(names)} AS column", "nth", "CAST(value AS STRING) AS value", "n")
        for names in _families(df, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def smallest_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The k smallest present values per column, as ``top_values`` has them for columns without repeats.

    Nothing is counted, so no values are shuffled but the k smallest of every task.
    """
    column_kinds = kinds(df)
    parts = []
    for names in _families(df, columns):
        cells = df.selectExpr(*[f"{present(name, column_kinds[name])} AS v{i}" for i, name in enumerate(names)])
        parts.append(
            cells.unpivot([], [f"v{i}" for i in range(len(names))], "slot", "value").where("value IS NOT NULL")
            .selectExpr("*", "row_number() OVER (PARTITION BY slot ORDER BY value) AS nth").where(f"nth <= {k}")
            .selectExpr(f"{slot_name(names)} AS column", "nth", "CAST(value AS STRING) AS value", "1L AS n"))
    return reduce(DataFrame.unionByName, parts)


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Columns whose present values are all equal, with that value as text. One scan, no shuffle of values."""
    column_kinds = kinds(df)
    names = [n for family in _families(df, columns) for n in family]
    seen = aggregate_row(df, {
        (n, part): f"{function}({present(n, column_kinds[n])})" for n in names
        for part, function in (("low", "min"), ("high", "max"))
    })
    same = [n for n in names if seen[n, "low"] is not None and seen[n, "low"] == seen[n, "high"]]
    if not same:
        return {}
    values = aggregate_row(df, {n: f"CAST(min({present(n, column_kinds[n])}) AS STRING)" for n in same})
    return {n: values[n] for n in same}


def has_unique_column(counts: dict[str, Distinct], n_rows: int) -> bool:
    """Whether some column holds a different value in every row, so that no two rows can be equal."""
    return any(c.top_count == 1 and c.n_values == n_rows for c in counts.values())


@dataclass(frozen=True)
class CardinalityIssues:
    """Names of the columns in each class; near-constant takes precedence over high-cardinality."""

    n_rows: int
    counts: dict[str, Distinct]
    constant: tuple[str, ...]
    near_constant: tuple[str, ...]
    high_cardinality: tuple[str, ...]


def cardinality_issues(df: DataFrame, options: Options = Options(), columns: list[str] | None = None,
                       n_rows: int | None = None, counts: dict[str, Distinct] | None = None) -> CardinalityIssues:
    rules = options.cardinality
    n_rows = df.count() if n_rows is None else n_rows
    counts = distinct_counts(df, options, columns) if counts is None else counts
    order = [n for n in df.columns if n in counts and counts[n].n_values > 0]
    constant = [n for n in order if counts[n].n_distinct <= 1]
    near = [n for n in order if n not in constant and counts[n].top_count is not None
            and counts[n].top_count / n_rows >= rules.near_constant_threshold]
    high = [n for n in order if n not in constant and n not in near
            and counts[n].n_distinct / n_rows >= rules.high_cardinality_threshold]
    return CardinalityIssues(n_rows, counts, tuple(constant), tuple(near), tuple(high))


def near_constant_table(df: DataFrame, found: CardinalityIssues) -> DataFrame:
    """column, dominant_value, dominant_count, dominant_pct, unique_count."""
    values = {row["column"]: row["value"] for row in top_values(df, list(found.near_constant), 1).collect()} \
        if found.near_constant else {}
    return df.sparkSession.createDataFrame(
        [(n, values[n], found.counts[n].top_count, found.counts[n].top_count / found.n_rows, found.counts[n].n_distinct)
         for n in found.near_constant],
        "column string, dominant_value string, dominant_count long, dominant_pct double, unique_count long",
    )


def high_cardinality_table(df: DataFrame, found: CardinalityIssues) -> DataFrame:
    """column, unique_count, unique_ratio, data_type."""
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame(
        [(n, found.counts[n].n_distinct, found.counts[n].n_distinct / found.n_rows, types[n]) for n in found.high_cardinality],
        "column string, unique_count long, unique_ratio double, data_type string",
    )
