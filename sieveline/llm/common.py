"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The most rows of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table marked for broadcast if it is counted to be small, else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held_out(id_column: str) -> Column:
    """Whether the remainder of the id's CRC-32 by 5 is 0: such documents are never learned from. NULL ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
