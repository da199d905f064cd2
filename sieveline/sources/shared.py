"""Intermediate tables in the folder that all executors of the cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sieveline.errors import SievelineError


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder of the session.

    Where the session names none, a run within one machine takes a folder of that machine; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise SievelineError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sieveline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table written once and read back, so later passes read only the columns they need."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made. Nothing may read them afterwards."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if re.search(r"/sieveline-[0-9a-f]{32}$", folder):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """A small table that several jobs use."""
    return written(df)
