"""Small JSON records of a run, in the same store as its tables, and fingerprints of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def is_empty(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return not fs.exists(at) or len(fs.listStatus(at)) == 0


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes beside the place and renames over it, so that there is a whole record at any moment: the old one or the new."""
    at, fs = _at(spark, path)
    beside, _ = _at(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(at), over)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def read_all_json(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per record, such as all shards' checkpoints."""
    return spark.read.json(pattern, multiLine=True)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read where they are stored."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
