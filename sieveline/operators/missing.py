"""Missing cells per column, sparse rows, totals, and what the cleaner should do about them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sieveline.functions.columns import BOOLEAN, NUMERIC_KINDS, count_if, is_missing, kinds, missing_cells, text
from sieveline.operators.aggregate import rows_from_aggregate
from sieveline.options import MissingOptions, Options


def strategy_for(kind: str, options: MissingOptions) -> str:
    """Numeric and boolean columns take the numeric strategy, everything else the categorical one."""
    numeric = kind in NUMERIC_KINDS or kind == BOOLEAN
    return options.numeric_imputation if numeric else options.categorical_imputation


def missing_by_column(df: DataFrame) -> DataFrame:
    """One row per column that has missing cells: column, missing_count, missing_pct."""
    return missing_column_actions(df).drop("recommended_action")


def missing_column_actions(df: DataFrame, options: Options = Options()) -> DataFrame:
    """``missing_by_column`` with the recommended action: drop_column or impute_<strategy>."""
    rules = options.missing_values
    entries = [
        {"column": text(name), "n_rows": "count(1)", "missing_count": count_if(is_missing(name, kind)),
         "strategy": text("impute_" + strategy_for(kind, rules))}
        for name, kind in kinds(df).items()
    ]
    return rows_from_aggregate(df, entries).where("missing_count > 0").selectExpr(
        "column", "missing_count", "missing_count / n_rows AS missing_pct",
        f"if(missing_count / n_rows >= {rules.drop_column_threshold}D, 'drop_column', strategy) AS recommended_action",
    )


def sparse_row(column_kinds: dict[str, str], threshold: float) -> str:
    """Condition: the share of missing cells over the given columns reaches the threshold."""
    return f"{missing_cells(column_kinds)} / {len(column_kinds)}D >= {float(threshold)}D"


def sparse_rows(df: DataFrame, options: Options = Options()) -> DataFrame:
    """One row: n_rows and how many rows are sparse."""
    condition = sparse_row(kinds(df), options.missing_values.drop_row_threshold)
    return df.selectExpr("count(1) AS n_rows", f"{count_if(condition)} AS sparse_rows")


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: total missing cells, their share of all cells, and the number of affected columns."""
    names = kinds(df)
    wide = df.selectExpr("count(1) AS n_rows", *[
        f"{count_if(is_missing(name, kind))} AS m{i}" for i, (name, kind) in enumerate(names.items())])
    total = "(" + " + ".join(f"m{i}" for i in range(len(names))) + ")"
    affected = " + ".join(f"CAST(m{i} > 0 AS BIGINT)" for i in range(len(names)))
    return wide.selectExpr(
        f"{total} AS total_missing_cells",
        f"coalesce(try_divide({total}, n_rows * {len(names)}L), 0D) AS total_missing_pct",
        f"{affected} AS affected_columns",
    )
