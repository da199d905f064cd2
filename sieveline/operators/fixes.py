"""The transformations: pure functions from table to table with all constants given.

Apart from duplicate removal every fix looks at one row at a time, so any chain of them is one
projection and filter over the scan, in batch and in streaming.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sieveline.errors import PlanError
from sieveline.functions.columns import (
    BOOLEAN, FLOATING, NUMERIC_KINDS, double, kinds, missing_cells, number, present, ref, text,
)
from sieveline.functions.scalars import normalize, parse_number, parse_timestamp
from sieveline.operators.duplicates import Copies, grouped_rows
from sieveline.operators.types import BOOLEAN_AS_INTEGER, DATE_STRING, MIXED_NUMERIC_STRING, NUMERIC_STRING


def _project(df: DataFrame, changed: dict[str, str], added: dict[str, str] | None = None) -> DataFrame:
    """All columns in order, some replaced by an expression, then the added ones."""
    if not changed and not added:
        return df
    return df.selectExpr(*[f"{changed.get(n, ref(n))} AS {ref(n)}" for n in df.columns],
                         *[f"{expression} AS {ref(n)}" for n, expression in (added or {}).items()])


def drop_duplicates(df: DataFrame, keep: str = "first", copies: Copies | None = None, row_id: str | None = None) -> DataFrame:
    """One copy of every row (first, last), or only rows without a copy (none).

    A ``row_id`` column is not compared: first keeps the copy with the smallest id, last the one
    with the largest. Without it the copies are equal and it does not matter which one stays.
    With a small set of suspects found on this same table, rows pass straight through, and the
    suspects join them as already grouped.
    """
    if keep not in ("first", "last", "none"):
        raise PlanError(f"keep must be first, last or none; got {keep!r}")
    content = [n for n in df.columns if n != row_id]
    if copies is None:
        groups = grouped_rows(df, content, row_id)
        copies = Copies(content, row_id, -1, False, groups, groups)
    if not copies.few:
        return copies.kept(keep).select(*[ref(n) for n in df.columns])
    if copies.n_hashes == 0:
        return df
    return copies.outside(df).unionByName(copies.kept(keep))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns) if columns else df


def cast_expression(column: str, issue: str) -> str:
    if issue in (NUMERIC_STRING, MIXED_NUMERIC_STRING):
        return parse_number(ref(column))
    if issue == DATE_STRING:
        return parse_timestamp(ref(column))
    if issue == BOOLEAN_AS_INTEGER:
        return f"CAST({ref(column)} AS BOOLEAN)"
    raise PlanError(f"unknown type issue {issue!r} for column {column!r}")


def cast_columns(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Columns converted by their type issue; cells that do not parse become missing."""
    return _project(df, {n: cast_expression(n, issue) for n, issue in casts.items()})


def normalize_categories(df: DataFrame, columns: list[str], case: bool = True, whitespace: bool = True) -> DataFrame:
    """Text columns stripped, then lower-cased, as asked. Missing cells stay missing."""
    return _project(df, {n: normalize(ref(n), case, whitespace) for n in columns})


def min_present(n_columns: int, threshold: float) -> int:
    """Fewest present cells a row needs to be kept."""
    return min(math.floor(n_columns * (1.0 - threshold)) + 1, n_columns)


def dense_row(column_kinds: dict[str, str], needed: int, costly: list[str] | None = None) -> str:
    """Condition: the row has at least ``needed`` present cells among the given columns.

    ``costly`` columns are results of a parse. They are looked at only in rows where the other
    columns do not settle the matter.
    """
    cheap = {n: k for n, k in column_kinds.items() if n not in (costly or [])}
    decided = f"{len(column_kinds)} - {missing_cells(column_kinds)} >= {needed}"
    if len(cheap) == len(column_kinds) or len(cheap) < needed:
        return decided
    return f"({len(cheap)} - {missing_cells(cheap)} >= {needed} OR {decided})"


def drop_sparse_rows(df: DataFrame, needed: int, row_id: str | None = None, costly: list[str] | None = None) -> DataFrame:
    """Rows with enough present cells, not counting the row id."""
    return df.where(dense_row({n: k for n, k in kinds(df).items() if n != row_id}, needed, costly))


@dataclass(frozen=True)
class Fill:
    """Replacement for the missing cells of a column, as text of the given SQL type."""

    column: str
    strategy: str
    value: str
    data_type: str

    @property
    def literal(self) -> str:
        return f"CAST({text(self.value)} AS {self.data_type})"


def fill_missing(df: DataFrame, fills: list[Fill]) -> DataFrame:
    """Missing cells replaced. The column takes the type of the fill, e.g. integers become double for a median."""
    column_kinds = kinds(df)
    return _project(df, {
        f.column: f"coalesce(CAST({present(f.column, column_kinds[f.column])} AS {f.data_type}), {f.literal})" for f in fills
    })


@dataclass(frozen=True)
class Fence:
    column: str
    lower: float
    upper: float

    def outside(self, kind: str) -> str:
        """Condition: the value lies outside the fences. False, not NULL, for missing cells."""
        value = number(self.column, kind)
        return f"coalesce({value} < {double(self.lower)} OR {value} > {double(self.upper)}, false)"


def usable_fences(df: DataFrame, fences: list[Fence]) -> list[Fence]:
    """Fences whose column is present with numbers or flags."""
    column_kinds = kinds(df)
    return [f for f in fences if column_kinds.get(f.column) in (*NUMERIC_KINDS, BOOLEAN)]


def flag_outliers(df: DataFrame, fences: list[Fence]) -> DataFrame:
    """Adds ``<column>_is_outlier``; the data stays as it is."""
    column_kinds = kinds(df)
    flags = {f"{f.column}_is_outlier": f.outside(column_kinds[f.column]) for f in fences}
    return _project(df, {n: e for n, e in flags.items() if n in column_kinds},
                    {n: e for n, e in flags.items() if n not in column_kinds})


def cap_outliers(df: DataFrame, fences: list[Fence]) -> DataFrame:
    """Values outside the fences moved onto them. Missing cells stay missing; flags are left alone."""
    column_kinds = kinds(df)
    changed = {}
    for fence in fences:
        kind = column_kinds[fence.column]
        if kind == BOOLEAN:
            continue
        value = number(fence.column, kind)
        whole = fence.lower.is_integer() and fence.upper.is_integer() and kind not in (FLOATING,)
        kept = ref(fence.column) if whole else value
        target = dict(df.dtypes)[fence.column] if whole else "double"
        changed[fence.column] = (
            f"CASE WHEN {value} < {double(fence.lower)} THEN CAST({double(fence.lower)} AS {target}) "
            f"WHEN {value} > {double(fence.upper)} THEN CAST({double(fence.upper)} AS {target}) ELSE {kept} END")
    return _project(df, changed)


def drop_outliers(df: DataFrame, fences: list[Fence]) -> DataFrame:
    """Rows without a value outside the fences of any column."""
    column_kinds = kinds(df)
    outside = " OR ".join(f.outside(column_kinds[f.column]) for f in fences)
    return df.where(f"NOT ({outside})") if fences else df


def handle_outliers(df: DataFrame, fences: list[Fence], action: str) -> DataFrame:
    return {"flag": flag_outliers, "cap": cap_outliers, "drop": drop_outliers}[action](df, fences)
