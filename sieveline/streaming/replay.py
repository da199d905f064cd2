"""Apply a fitted plan to a stream."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from sieveline.errors import PlanError
from sieveline.functions.columns import ref
from sieveline.operators import fixes
from sieveline.plans.plan import CleaningPlan

BATCH, KEY = "sieveline_batch", "sieveline_key"


def _check(plan: CleaningPlan, stream: DataFrame) -> None:
    if not stream.isStreaming:
        raise PlanError("the table is not a stream; use the plan's apply")
    plan.check(stream)
    if plan.keep == "none":
        raise PlanError("keep='none' cannot run on a stream: a copy may still arrive")
    if plan.keep == "last" and plan.row_id:
        raise PlanError("keep='last' by row id cannot run on a stream: a later copy may still arrive")


def content_key(names: list[str]) -> Column:
    """128 bits of the contents of these columns, NULLs apart from values: two hashes of 64 bits that begin differently."""
    parts = [part for n in names for part in (F.col(ref(n)).isNull(), F.col(ref(n)))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def clean_stream(plan: CleaningPlan, stream: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The cleaned stream. All steps but duplicate removal look at one row and keep no state.

    No row is left out, however late or without an event time, and copies are found at any distance: a key of 16 bytes of each
    different row stays in the state, as a copy may always come. With the state store on disk (RocksDB, see
    ``spark.sql.streaming.stateStore.providerClass``) that bounds the memory. The first copy to arrive stays. ``delay`` is the watermark of
    ``event_time`` that the result carries for operations that come after (if the column is a timestamp); nothing here is judged by it.
    ``write_clean_stream`` keeps the rows in files instead of keys in the state.
    """
    _check(plan, stream)
    if plan.keep is None:
        return plan.apply_to_rows(stream)
    if event_time is None or delay is None:
        raise PlanError("removing duplicates from a stream needs an event time column and a delay")
    content = [n for n in stream.columns if n != plan.row_id]
    once = stream.withColumn(KEY, content_key(content)).dropDuplicates([KEY]).drop(KEY)
    if dict(once.dtypes)[event_time] == "timestamp":
        once = once.withWatermark(event_time, delay)
    return plan.apply_to_rows(once)


def write_clean_stream(plan: CleaningPlan, stream: DataFrame, folder: str, event_time: str, span: str = "day") -> DataStreamWriter:
    """A writer that cleans the stream into ``folder``; start it, and read the result by ``read_clean_stream``.

    No row is too late, with or without an event time: what was kept is stored by batch, sorted by the ``span`` of its event time
    (a unit of date_trunc). Copies have equal times, so a batch is compared only with kept rows of the spans that it has rows in. Spark keeps no
    state. The first copy to arrive stays, within a batch the one with the smallest row id. A repeated batch replaces its own files.
    """
    _check(plan, stream)
    content = [n for n in stream.columns if n != plan.row_id]
    time = F.date_trunc(span, F.col(ref(event_time)).cast("timestamp"))

    def one(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch
        if plan.keep is not None:
            if number > 0:
                spans = [r[0] for r in batch.select(F.unix_micros(time)).distinct().collect()]
                timed = [v for v in spans if v is not None]
                seen = spark.read.parquet(f"{folder}/kept").where(F.col(BATCH) < number)
                seen = seen.where(F.col("sieveline_span").isin(timed) | (F.col("sieveline_span").isNull() if None in spans else F.lit(False)))
                seen = seen.select(*[F.col(ref(n)).alias(f"seen_{i}") for i, n in enumerate(content)])
                new = new.join(seen, reduce(and_, [F.col(ref(n)).eqNullSafe(F.col(f"seen_{i}")) for i, n in enumerate(content)]), "left_anti")
            new = fixes.drop_duplicates(new, plan.keep, row_id=plan.row_id)
            kept = f"{folder}/kept/{BATCH}={number}"
            new.withColumn("sieveline_span", F.unix_micros(time)).sortWithinPartitions("sieveline_span").write.mode("overwrite").parquet(kept)
            new = spark.read.schema(new.schema).parquet(kept)
        plan.apply_to_rows(new).write.mode("overwrite").parquet(f"{folder}/data/{BATCH}={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/state")


def read_clean_stream(spark: SparkSession, folder: str) -> DataFrame:
    """What a stream written by ``write_clean_stream`` has cleaned so far."""
    return spark.read.parquet(f"{folder}/data").drop(BATCH)
