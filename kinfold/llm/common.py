"""What the training-data operators share: tables, written intermediate results, skew-safe joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import written as saved

#: Groups that hold over 1/HOT_SHARE of all rows are joined by broadcast: at most HOT_SHARE groups can.
HOT_SHARE = 1000
#: Bytes of the rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python by BATCH_BYTES at most, if it doesn't by less.

    Spark's own limits are 10,000 rows and 64 MB; whole texts come near them, and a batch is held by the JVM (twice while
    its buffer grows), by the worker, and once more as the worker's objects, in every running task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with groups, one row per key, where `size` says how many of the `total` rows have that key.

    Large groups (over total / HOT_SHARE rows, so fewer than HOT_SHARE of them) go by broadcast, so their rows
    never meet in one task; all others join by shuffle.
    """
    large = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    small = groups.where(F.col(size) * HOT_SHARE <= total)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))


def is_held_out(doc_id) -> "F.Column":
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
