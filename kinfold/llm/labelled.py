"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, saved


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, id: str = "doc_id", text: str = "text", others: Sequence[str] = ()) -> tuple[DataFrame, dict[int, int]]:
    """(rows, counts): doc_id, text, the other columns wanted, y of at most `per_class` documents of either label, and all labels' counts by class.

    Held-out rows are left out. The sample is drawn by a hash of the id, so it is the same each time; labels that are
    null or neither 0 nor 1, and labels without a document, don't count. A document with both labels may be drawn twice.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col(column).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    drawn = usable.where("y = 0").orderBy(*order).limit(per_class).unionByName(usable.where("y = 1").orderBy(*order).limit(per_class))
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *others)
    return saved(rows.join(F.broadcast(drawn), "doc_id"), "labelled"), counts
