"""Single cleaners on their own: each detects what to change on the table it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sieveline.functions.columns import count_if, is_missing, kinds, numeric_columns, string_columns
from sieveline.operators import cardinality, fixes, outliers, types
from sieveline.operators.aggregate import aggregate_row
from sieveline.operators.duplicates import find_copies
from sieveline.operators.missing import strategy_for
from sieveline.options import Options
from sieveline.plans.fit import fit_fills


def drop_duplicate_rows(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows without their exact copies; only rows that may have one are shuffled.

    The cached suspects belong to the returned table and go when the session does.
    """
    return fixes.drop_duplicates(df, options.duplicates.keep, find_copies(df, options))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold at most one value, all-missing ones included."""
    column_kinds = kinds(df)
    seen = aggregate_row(df, {n: f"count(CASE WHEN NOT {is_missing(n, k)} THEN 1 END)" for n, k in column_kinds.items()})
    empty = [n for n, present in seen.items() if present == 0]
    return fixes.drop_columns(df, [*cardinality.constant_columns(df), *empty])


def cast_mistyped_columns(df: DataFrame, options: Options = Options(), issues: tuple[str, ...] | None = None) -> DataFrame:
    """Mistyped columns converted; optionally only those with the given issues."""
    found = types.type_issues(df, options)
    return fixes.cast_columns(df, {i.column: i.issue for i in found if issues is None or i.issue in issues})


def normalize_all_categories(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Every text column stripped and lower-cased as the options say."""
    rules = options.categories
    return fixes.normalize_categories(df, string_columns(df), rules.normalize_case, rules.strip_whitespace)


def sparse_columns(df: DataFrame, options: Options = Options()) -> list[str]:
    column_kinds = kinds(df)
    seen = aggregate_row(df, {("", "rows"): "count(1)", **{
        (n, "m"): count_if(is_missing(n, k)) for n, k in column_kinds.items()}})
    return [n for n in column_kinds if seen[n, "m"] and
            seen[n, "m"] / seen["", "rows"] >= options.missing_values.drop_column_threshold]


def drop_sparse_columns(df: DataFrame, options: Options = Options()) -> DataFrame:
    return fixes.drop_columns(df, sparse_columns(df, options))


def drop_sparse_rows(df: DataFrame, options: Options = Options()) -> DataFrame:
    return fixes.drop_sparse_rows(df, fixes.min_present(len(df.columns), options.missing_values.drop_row_threshold))


def impute(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Every column with gaps filled by its strategy; ``none`` counts as the most frequent value here."""
    column_kinds = kinds(df)
    seen = aggregate_row(df, {("", "rows"): "count(1)", **{
        (n, "m"): count_if(is_missing(n, k)) for n, k in column_kinds.items()}})
    gaps = {n: strategy_for(k, options.missing_values) for n, k in column_kinds.items() if 0 < seen[n, "m"] < seen["", "rows"]}
    return fixes.fill_missing(df, fit_fills(df, gaps, options))


def handle_missing(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Sparse columns dropped, then sparse rows, then the remaining gaps filled."""
    return impute(drop_sparse_rows(drop_sparse_columns(df, options), options), options)


def outlier_fences(df: DataFrame, options: Options = Options(), columns: list[str] | None = None) -> list[fixes.Fence]:
    """Unrounded IQR fences of the numeric columns that have values outside them."""
    rules = options.merge({"outliers": {"method": "iqr"}})
    names = numeric_columns(df) if columns is None else columns
    quartiles = outliers.column_quantiles(df, names, (0.25, 0.75), options)
    stats = {n: outliers.NumericStats(n, q.n, q1=q.values[0.25], q3=q.values[0.75]) for n, q in quartiles.items()}
    return [fixes.Fence(n, o.lower_fence, o.upper_fence) for n, o in outliers.outliers(df, rules, stats).items()]


def handle_outliers(df: DataFrame, options: Options = Options(), columns: list[str] | None = None) -> DataFrame:
    return fixes.handle_outliers(df, outlier_fences(df, options, columns), options.outliers.action)
