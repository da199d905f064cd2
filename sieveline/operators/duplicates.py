"""Exact duplicate rows: counts, samples, and the copies themselves.

A table is shuffled on whole rows only where it must be. Every row is first reduced to one
64-bit hash; hashes seen more than once are the suspects. With no suspects there are no
duplicates. With a checked, small number of suspects they are broadcast, and only the suspect
rows are compared in full. Otherwise duplicates are plentiful and whole rows are grouped, where
partial aggregation collapses copies before the shuffle. A hash collision only makes a row a
suspect, so all results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import ValidationError
from sieveline.functions.columns import has_map, ref
from sieveline.functions.fixed import SAMPLE_ROWS
from sieveline.options import Options
from sieveline.sources.shared import discard, kept, written

HASH, COPIES, FIRST_ID, LAST_ID = "__row_hash", "__copies", "__first_id", "__last_id"


def row_hash(df: DataFrame, content: list[str]) -> Column:
    """64-bit hash of the row; NULL, NaN and signed zero hash like they compare."""
    columns = [ref(f.name) for f in df.schema.fields if f.name in content and not has_map(f.dataType)]
    return F.expr(f"xxhash64({', '.join(columns)})" if columns else "0L")


@dataclass
class Copies:
    """Rows of one table that may have copies.

    ``hashes`` are the suspect hashes. ``groups`` holds every distinct suspect row once, with its
    number of copies and, if rows have ids, the smallest and largest id. While the suspects are
    ``few``, both are small tables, written to the shared folder until ``release``. Otherwise every row counts as suspect.
    """

    content: list[str]
    row_id: str | None
    n_hashes: int
    few: bool
    hashes: DataFrame | None
    groups: DataFrame | None
    stored: tuple[DataFrame, ...] = ()

    def count(self, keep: str = "first") -> int:
        """Rows beyond the kept one (first, last), or all rows of repeated groups (none)."""
        if self.n_hashes == 0:
            return 0
        extra = COPIES if keep == "none" else f"{COPIES} - 1"
        return self.groups.where(f"{COPIES} > 1").selectExpr(f"coalesce(sum({extra}), 0)").first()[0]

    def outside(self, df: DataFrame) -> DataFrame:
        """Rows of the table that cannot have a copy: found by a broadcast join, without a shuffle."""
        return df.withColumn(HASH, row_hash(df, self.content)).join(F.broadcast(self.hashes), HASH, "left_anti").drop(HASH)

    def kept(self, keep: str) -> DataFrame:
        """The suspect rows that stay."""
        rows = self.groups.where(f"{COPIES} = 1") if keep == "none" else self.groups
        chosen = LAST_ID if keep == "last" else FIRST_ID
        ids = [f"{chosen} AS {ref(self.row_id)}"] if self.row_id else []
        return rows.selectExpr(*[ref(n) for n in self.content], *ids)

    def surplus(self, keep: str) -> DataFrame:
        """Every repeated row once, with the number of copies to take away as ``__surplus``."""
        extra = COPIES if keep == "none" else f"{COPIES} - 1"
        return self.groups.where(f"{COPIES} > 1").selectExpr(*[ref(n) for n in self.content], f"{extra} AS __surplus")

    def release(self) -> None:
        """Delete what was stored to find these copies."""
        discard(*self.stored)
        self.stored = ()


def no_copies(df: DataFrame, row_id: str | None = None) -> Copies:
    """What ``find_copies`` finds where a column already tells all rows apart."""
    return Copies([n for n in df.columns if n != row_id], row_id, 0, True, None, None)


def grouped_rows(df: DataFrame, content: list[str], row_id: str | None = None) -> DataFrame:
    """Every distinct row with its number of copies and the range of its ids."""
    wanted = [F.count(F.lit(1)).alias(COPIES)]
    if row_id:
        wanted += [F.expr(f"min({ref(row_id)}) AS {FIRST_ID}"), F.expr(f"max({ref(row_id)}) AS {LAST_ID}")]
    return df.groupBy(*[ref(n) for n in content]).agg(*wanted)


def find_copies(df: DataFrame, options: Options = Options(), row_id: str | None = None, store: bool = False) -> Copies:
    """Look for rows with copies; a row id column is not compared.

    ``store`` writes the grouped rows to the shared folder where suspects are many, for callers
    that read them more than once.
    """
    content = [n for n in df.columns if n != row_id]
    hashes = (
        df.select(row_hash(df, content).alias(HASH)).groupBy(HASH).agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(HASH)
    )
    # One more than may be broadcast is enough to know that there are too many.
    hashes = kept(hashes.limit(options.scale.broadcast_rows + 1))
    n_hashes = hashes.count()
    few = n_hashes <= options.scale.broadcast_rows
    if few:
        suspects = df.withColumn(HASH, row_hash(df, content)).join(F.broadcast(hashes), HASH, "left_semi")
        groups = kept(grouped_rows(suspects, content, row_id))
    else:
        groups = written(grouped_rows(df, content, row_id)) if store else grouped_rows(df, content, row_id)
    return Copies(content, row_id, n_hashes, few, hashes, groups, (hashes, groups) if few or store else (hashes,))


def count_duplicates(df: DataFrame, keep: str = "first", options: Options = Options()) -> int:
    copies = find_copies(df, options)
    try:
        return copies.count(keep)
    finally:
        copies.release()


def duplicate_summary(df: DataFrame, keep: str = "first", options: Options = Options()) -> DataFrame:
    """One row: n_rows, duplicate_count, duplicate_pct, rows_that_would_remain."""
    n_rows, count = df.count(), count_duplicates(df, keep, options)
    return df.sparkSession.createDataFrame(
        [(n_rows, count, count / n_rows if n_rows else 0.0, n_rows - count)],
        "n_rows long, duplicate_count long, duplicate_pct double, rows_that_would_remain long",
    )


def duplicate_samples(df: DataFrame, row_id: str, keep: str = "first", options: Options = Options(),
                      copies: Copies | None = None) -> DataFrame:
    """The ten smallest row ids among the duplicates; the id column is not part of the comparison.

    At most eleven rows per group survive the first ranking, which Spark applies before the
    shuffle too, so a group holding most of the table stays cheap. Eleven are enough: ten to
    report, and one to tell whether a row is the last of its group.
    """
    if row_id not in df.columns:
        raise ValidationError(f"no column {row_id!r} to identify rows by")
    copies = copies or find_copies(df, options, row_id)
    hashed = df.withColumn(HASH, row_hash(df, copies.content))
    if copies.few:
        hashed = hashed.join(F.broadcast(copies.hashes), HASH, "left_semi")
    same_row = Window.partitionBy(HASH, *[ref(n) for n in copies.content])
    by_id = same_row.orderBy(ref(row_id))
    first_rows = hashed.withColumn("__nth", F.row_number().over(by_id)).where(F.col("__nth") <= SAMPLE_ROWS + 1)
    flagged = {
        "first": F.col("__nth") > 1,
        "last": F.col("__next").isNotNull() & (F.col("__nth") <= SAMPLE_ROWS),
        "none": F.col("__size") > 1,
    }[keep]
    return (
        first_rows
        .withColumn("__next", F.lead(F.lit(1)).over(by_id))
        .withColumn("__size", F.count(F.lit(1)).over(same_row))
        .where(flagged).select(F.col(ref(row_id)).alias("row_id")).orderBy("row_id").limit(SAMPLE_ROWS)
    )
