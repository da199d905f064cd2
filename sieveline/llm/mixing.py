"""Mixing sources to target weights by whole repeats and one drawn copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.llm.common import small
from sieveline.sources.shared import written

WEIGHTS = (5.0, 2.0, 1.0)
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most_repeats: int = 3) -> DataFrame:
    """source, source_size, target, rate: one row per source of a table (source, size).

    Sources are ordered by code point, NULL last, and weigh 5, 2, 1, repeating. All sizes together are shared by
    weight; no target passes `most_repeats` times its source's size, and what is above is shared again by weight.
    Sorted by size over weight, sources reach that bound one after another, so the shares are found in one pass: the
    sources before the first that stays below its bound are at it. A source without words has target 0. Sizes are
    summed in each task first; the order of sources is worked out over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bound = most_repeats * F.col("source_size")
    level = (F.col("total") - F.coalesce(F.sum(bound).over(before), F.lit(0))) / F.sum("weight").over(after)
    steps = (totals.withColumn("number", number).withColumn("weight", weight)
             .withColumn("total", F.sum("source_size").over(everything)).withColumn("level", level)
             .withColumn("open", F.col("level") * F.col("weight") <= bound))
    # The level at the first open source holds for every source from there on.
    steps = steps.withColumn("share", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.coalesce(F.least(F.col("share") * F.col("weight"), bound.cast("double")), bound.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most_repeats)))).otherwise(0.0)
    return steps.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(seed: int, id_column: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the id only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16 ** 12))


def repeats(docs: DataFrame, seed: int = 11, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies for every row of `docs`.

    copies is floor(rate) and one more if the id's draw is below the rest of the rate. So it depends on the id and
    its source's rate, and reruns agree; equal ids of one source draw alike. Draws are independent, so a source's words differ
    from its target by about the root of the sum of size^2 * f * (1 - f), f being the rest of the rate: little for many documents, much for few long ones. A NULL text has size 0, a NULL source is a
    source of its own, NULL ids draw as one id. Whole texts are counted; other columns are not read.
    """
    sizes = written(docs.select(F.col(id_column).alias("doc_id"), F.col(source).cast("string").alias("source"),
                                n_words(F.col(text).cast("string")).alias("size")))
    return with_copies(sizes, seed)


def with_copies(sizes: DataFrame, seed: int) -> DataFrame:
    targets = small(written(source_targets(sizes)).withColumnRenamed("source", "of_source"))
    whole = F.floor("rate")
    copies = (whole + (draw(seed, F.col("doc_id")) < F.col("rate") - whole).cast("long")).alias("copies")
    return sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "size", "source_size", "target", copies)


def mix(docs: DataFrame, seed: int = 11, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs`, all columns of any names, each as often as the mix takes it, by the rules of `repeats`."""
    sizes = docs.select(F.col(source).cast("string").alias("source"), n_words(F.col(text).cast("string")).alias("size"))
    targets = small(written(source_targets(sizes).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"))))
    rows = docs.select(F.struct("*").alias("mix_docs")).join(targets, F.col(f"mix_docs.`{source}`").cast("string").eqNullSafe(F.col("mix_source")))
    whole = F.floor("mix_rate")
    copies = whole + (draw(seed, F.col(f"mix_docs.`{id_column}`")) < F.col("mix_rate") - whole).cast("long")
    return (rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), copies))).where("mix_copy > 0")
            .select("mix_docs.*"))
