"""Exact deduplication behind a two-pass Bloom filter, in DataFrame functions only.

Pass 1 hashes every text and counts how often each Bloom slot is hit; slots hit twice or more form the filter of
*possibly repeated* hashes. Pass 2 looks every text up in that filter: rows that miss it have a text of their own and
pass straight through without a shuffle, and only the rest are grouped by SHA-256.

The filter has 16 bits a document up to MAX_BITS. It is broadcast as words of 64 bits, so at most MAX_BITS / 64 rows of
16 bytes. Past that size more rows are only *possibly* repeated and shuffle (as digests, not texts): the result is the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, saved

#: Bound of the broadcast filter: 2^27 bits are 2,097,152 words, 32 MB of raw rows.
MAX_BITS = 27
BITS_PER_DOCUMENT = 16


def _slots(h: Column, bits: int) -> tuple[Column, Column]:
    mask = (1 << bits) - 1
    return h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask))


def _repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """(word, word_bits): the Bloom slots that two or more rows hit, 64 to a word."""
    one, two = _slots(F.col("h"), bits)
    hit = hashes.select(F.explode(F.array(one, two)).alias("slot")).groupBy("slot").count().where("count > 1")
    return hit.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("word_bits"))


def _with_possible(df: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """df (with h) plus `possible`: whether both slots of h are in the filter."""
    low = min(63, (1 << bits) - 1)
    for i, slot in enumerate(_slots(F.col("h"), bits)):
        words = F.broadcast(repeated.select(F.col("word").alias(f"_w{i}"), F.col("word_bits").alias(f"_b{i}")))
        df = df.join(words, F.shiftright(slot, 6) == F.col(f"_w{i}"), "left")
    hits = [F.expr(f"coalesce(shiftright(_b{i}, CAST({s} AS INT)) & 1, 0) = 1") for i, s in enumerate((f"h & {low}", f"shiftrightunsigned(h, 32) & {low}"))]
    return df.withColumn("possible", hits[0] & hits[1]).drop("_w0", "_b0", "_w1", "_b1")


def _filter(docs: DataFrame, text: str, max_bits: int) -> tuple[DataFrame, int, int]:
    total = docs.count()
    bits = min(max_bits, max(10, math.ceil(math.log2(BITS_PER_DOCUMENT * max(1, total)))))
    hashes = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    return saved(_repeated_slots(hashes, bits), "bloom"), bits, total


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, sha (binary), whether it passed the filter by.

    Equal texts (null is empty) form a group; its row with the largest id stays. Rows with a null id come after all
    others; if a group has only such rows, keep_id is null. Of repeated rows with one id and one text, one is kept.
    An empty table gives an empty result. Other columns are not read.
    """
    repeated, bits, total = _filter(docs, text, max_bits)
    value = F.coalesce(text, F.lit(""))
    read = docs.select(F.col(id).alias("doc_id"), F.xxhash64(value).alias("h"), F.unhex(F.sha2(value.cast("binary"), 256)).alias("sha"))
    digests = saved(_with_possible(read, repeated, bits).drop("h"), "digests")
    alone = digests.where(~F.col("possible")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    rows = saved(digests.where("possible").groupBy("sha", "doc_id").agg(F.count("*").alias("copies")), "copies")
    groups = saved(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("ids")), "groups")
    found = join_groups(rows, groups, "sha", "ids", total).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha"))


def drop_exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep, all columns as they were.

    Rows that miss the filter pass straight through; of the others, the text meets its group's decision in a join on
    hash and id, so a large group spreads over all tasks. Of repeated rows with one id and one text, any one stays.
    """
    repeated, bits, _ = _filter(docs, text, max_bits)
    columns = docs.columns
    value = F.coalesce(text, F.lit(""))
    wide = docs.select(F.struct(*columns).alias("_row"), F.xxhash64(value).alias("h"))
    seen = _with_possible(wide, repeated, bits)
    row_sha = F.unhex(F.sha2(F.coalesce(F.col("_row")[text], F.lit("")).cast("binary"), 256))
    maybe = seen.where("possible").select("_row", row_sha.alias("_sha"), F.col("_row")[id].alias("_id"))
    stays = saved(maybe.groupBy("_sha").agg(F.max("_id").alias("_keep")), "stays").withColumnRenamed("_sha", "_of")
    won = maybe.join(stays, (F.col("_sha") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha", "_id"])
    return seen.where(~F.col("possible")).select("_row.*").unionByName(won.select("_row.*"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
