"""Entities: the strict TSV source, and a view of the documents table as entities of three sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import normalize_columns
from .storage import dealt, written

HEADER = ["entity_id", "business_name", "business_address", "country"]
#: Rows whose order is counted in one window: ids are cut into stretches of this width.
STRETCH = 4096


def read_tsv(spark: SparkSession, path: str, columns: list[str] = HEADER) -> DataFrame:
    """A tab-separated table with exactly this header, all columns strings, empty fields empty strings, and row_pos.

    Rows with a wrong number of fields fail the job. row_pos is the place in the file, from 0.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first or first[0][0].rstrip("\r").split("\t") != columns:
        raise ValueError(f"{path} must begin with the header {columns}")
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, enforceSchema=False, mode="FAILFAST", quote='"', escape='"', multiLine=True)
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
    # ids of rows grow within and over partitions of a file, in its order
    return with_index(rows.withColumn("_at", F.monotonically_increasing_id()), [], "_at", "row_pos").drop("_at")


def with_index(df: DataFrame, groups: list[str], order: str, name: str, per_group: bool = False) -> DataFrame:
    """df plus a dense rank from 0 in the order of groups, then `order` (distinct whole numbers).

    Rows are counted in stretches of the order column; only the counts of the stretches are added up in one place.
    """
    stretch = F.floor(F.col(order) / STRETCH).alias("_stretch")
    cut = df.withColumn("_stretch", stretch)
    keys = [*groups, "_stretch"]
    running = Window.partitionBy(*groups) if per_group else Window.partitionBy()
    before = F.sum("_n").over(running.orderBy(*([] if per_group else groups), "_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return cut.withColumn("_in", within).join(starts, keys).withColumn(name, F.col("_start") + F.col("_in")).select(*df.columns, name)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r\f\u000b]+"), lambda w: w != "")


def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entities: source, entity_id, business_name, business_address, country and row_pos (the doc_id)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    w = F.col("w")
    source = (F.col("doc_id") % 3 + 1).cast("int")
    return docs.withColumn("w", _words(F.col("text"))).select(
        F.col("doc_id").alias("row_pos"), source.alias("source"), F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.array_join(F.slice(w, F.greatest(F.size(w) - 3, F.lit(1)), F.lit(4)), " ").alias("business_name"),
        F.concat(F.array_join(F.slice(w, 5, 10), " "), F.lit(" "), F.col("n_chars").cast("string")).alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
    )


def normalized(entities: DataFrame) -> DataFrame:
    """entities with n, a, c: normalised name, address and country."""
    renamed = entities.withColumnsRenamed({"business_name": "n", "business_address": "a", "country": "c"})
    return normalize_columns(renamed, {"n": True, "a": True, "c": False})


def queries_and_targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(S1 entities, targets with target_idx) of the documents view, normalised once and written, since plans read them often."""
    rows = written(normalized(entity_view(spark, sf_dir)), "entities")
    s1 = with_index(rows.where("source = 1").withColumnRenamed("row_pos", "_at"), [], "_at", "row_pos").select("row_pos", F.col("entity_id").alias("s1_id"), "n", "a", "c")
    targets = with_index(rows.where("source <> 1"), ["source"], "row_pos", "target_idx")
    return written(dealt(s1), "s1"), written(dealt(targets.select("target_idx", "entity_id", "n", "a", "c", "source")), "targets")
