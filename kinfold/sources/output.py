"""Writers of the two result tables, with the contract checked before anything is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contract import check


def write_tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """df as tab-separated text with a header, in the order of a column that isn't written. path must not exist.

    Parts are in order of their names: a sorted range of rows each, so that no single task writes all.
    """
    out = df.orderBy(order).drop(order) if order else df
    out.write.mode("errorifexists").option("emptyValue", "").csv(path, sep="\t", header=True)


def publish(s1: DataFrame, candidates: DataFrame, matches: DataFrame, folder: str, most_matches: int = 11) -> None:
    """Writes candidate_pairs.tsv and matching_results.tsv beside their place, and moves them there once both are whole."""
    check(s1, candidates, matches, most_matches)
    spark = s1.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging = f"{folder}/_staging"
    for name, table in (("candidate_pairs.tsv", candidates), ("matching_results.tsv", matches)):
        if fs.exists(path(f"{folder}/{name}")):
            raise FileExistsError(f"{folder}/{name}")
        write_tsv(table, f"{staging}/{name}", "row_pos")
    for name in ("candidate_pairs.tsv", "matching_results.tsv"):
        if not fs.rename(path(f"{staging}/{name}"), path(f"{folder}/{name}")):
            raise OSError(f"{name} could not be moved to {folder}")
    fs.delete(path(staging), True)


def shards(df: DataFrame, workers: int, order: str = "row_pos") -> DataFrame:
    """df plus the shard of each row: contiguous, equally long stretches of a dense order column."""
    total = df.count()
    length = max(1, -(-total // workers))
    return df.withColumn("shard", F.least(F.floor(F.col(order) / length), F.lit(workers - 1)).cast("int"))
