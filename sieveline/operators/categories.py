"""Text columns that spell one category in several ways (case, surrounding whitespace)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import STRING, kinds, ref, slot_name
from sieveline.functions.scalars import KEY_BYTES, normalize, short_key
from sieveline.options import Options


@dataclass(frozen=True)
class CategoryCounts:
    """Distinct raw and normalized values of a text column."""

    column: str
    raw: int
    normalized: int

    @property
    def inconsistencies(self) -> int:
        return self.raw - self.normalized


def _cells(df: DataFrame, names: list[str], expression) -> DataFrame:
    """slot, value of the present cells of text columns, with the expression applied to each."""
    labels = [f"v{i}" for i in range(len(names))]
    return (
        df.selectExpr(*[f"{expression(ref(name))} AS v{i}" for i, name in enumerate(names)])
        .unpivot([], labels, "slot", "value").where("value IS NOT NULL")
    )


def category_counts(df: DataFrame, options: Options = Options(), columns: list[str] | None = None) -> DataFrame:
    """column, raw_unique_count, normalized_unique_count, inconsistency_count of every text column. Lazy.

    Values travel as short keys, so long texts are neither shuffled nor compared in full. The
    number of inconsistencies, sum(cluster size - 1), is the difference of the two counts.
    """
    rules = options.categories
    names = [n for n, k in kinds(df).items() if k == STRING and (columns is None or n in columns)]
    schema = "column string, raw_unique_count long, normalized_unique_count long, inconsistency_count long"
    if not names or not (rules.normalize_case or rules.strip_whitespace):
        return df.sparkSession.createDataFrame([], schema)

    def shaped(cell: str) -> str:
        return short_key(normalize(cell, rules.normalize_case, rules.strip_whitespace))

    def keys(cell: str) -> str:
        # A short value is its own key, so it is normalized once per distinct value, after counting.
        long_norm = f"CASE WHEN octet_length({cell}) > {KEY_BYTES} THEN {shaped(cell)} END"
        return f"CASE WHEN {cell} IS NOT NULL THEN struct({short_key(cell)} AS raw, {long_norm} AS norm) END"

    return (
        _cells(df, names, keys).selectExpr("slot", "value.raw AS raw", "value.norm AS norm").distinct()
        .selectExpr("slot", f"coalesce(norm, {shaped('raw')}) AS norm")
        .groupBy("slot", "norm").agg(F.count("*").alias("variants"))
        .groupBy("slot").agg(F.sum("variants").alias("raw_unique_count"), F.count("*").alias("normalized_unique_count"))
        .selectExpr(f"{slot_name(names)} AS column", "raw_unique_count", "normalized_unique_count",
                    "raw_unique_count - normalized_unique_count AS inconsistency_count")
    )


def inconsistent_columns(df: DataFrame, options: Options = Options(), columns: list[str] | None = None) -> list[CategoryCounts]:
    """Text columns with fewer normalized than raw values, in column order."""
    rows = category_counts(df, options, columns).where("inconsistency_count > 0").collect()
    found = {r["column"]: CategoryCounts(r["column"], r["raw_unique_count"], r["normalized_unique_count"]) for r in rows}
    return [found[n] for n in df.columns if n in found]


def category_clusters(df: DataFrame, columns: list[str], options: Options = Options()) -> DataFrame:
    """One row per raw spelling of a category that has several: column, normalized, raw_value, variants, n.

    Copies are counted before anything else, so a value that fills the table is one row from
    there on. The spellings stay rows and are never collected into one list.
    """
    schema = "column string, normalized string, raw_value string, variants long, n long"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    rules = options.categories
    counted = (
        _cells(df, columns, lambda cell: cell).groupBy("slot", "value").agg(F.count("*").alias("n"))
        .withColumn("normalized", F.expr(normalize("value", rules.normalize_case, rules.strip_whitespace)))
    )
    several = (
        counted.groupBy("slot", "normalized").agg(F.count("*").alias("variants")).where("variants > 1")
    )
    return counted.join(several, ["slot", "normalized"]).selectExpr(
        f"{slot_name(columns)} AS column", "normalized", "value AS raw_value", "variants", "n")
