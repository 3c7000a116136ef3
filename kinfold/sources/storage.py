"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _LOCAL
    _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="kinfold-")
    return _LOCAL


_LOCAL: str | None = None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in four parts a core, by keys or in turn: tables of ids are small, so Spark would leave costly work on them to one or two tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage and outlives executors; goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # no marker file, which nothing reads: to set its permissions, Hadoop without native code forks the driver twice a table
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)  # with its schema given, no job reads a file's footer for it
