"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, each cut into blocks of bounded size. Queries first meet the bucket of the
longest vectors, which gives each a threshold: the k-th best score so far. Then they meet the other buckets, where the
threshold over query length times the bucket's greatest length is a local cosine threshold: over 1, the whole block is
left out; high ones prune by coordinates, low ones by length; what is left is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, saved, table

BUCKETS = 8
#: Candidates in a block, and queries in one, on average over the buckets.
BLOCK, QUERY_BLOCK = 4096, 1024
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.3
FOCUS = 3

_VECTOR = "vec_id long, dim int, norm double, vector binary, lot long"


def quantise(embeddings: DataFrame, scale: float = 256.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows that take part, with floor(scale * x) of every component as 64-bit integers.

    Null vectors or ids, and vectors with null, NaN or infinite components take no part; vectors of different dimension
    never meet. Products are exact while they fit 64 bits.
    """

    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for i, (row, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                if row is None or not value.is_valid:
                    continue
                x = np.array([np.nan if c is None else c for c in value.as_py()], dtype=np.float64)
                if np.isfinite(x).all():
                    q = np.floor(scale * x).astype(np.int64)
                    out.append((row, len(q), float(np.sqrt((q.astype(np.float64) ** 2).sum())), q.tobytes(), xxhash.xxh64_intdigest(f"{row}:{i}", 7) >> 1))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["vec_id", "dim", "norm", "vector", "lot"])

    return embeddings.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")).mapInArrow(run, _VECTOR)


_PACKED = "dim int, bucket int, block long, kind int, ids binary, vectors binary, thresholds binary, longest double, least double"


def _pack(rows: DataFrame, kind: int) -> DataFrame:
    """One row for each (dim, bucket, block), its vectors longest first."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
        least = part["threshold"].to_numpy(dtype=np.float64)
        return pd.DataFrame({
            "dim": [int(key[0])], "bucket": [int(key[1])], "block": [int(key[2])], "kind": [kind], "ids": [part["vec_id"].to_numpy(dtype=np.int64).tobytes()],
            "vectors": [b"".join(part["vector"])], "thresholds": [least.tobytes()], "longest": [float(part["norm"].iloc[0])], "least": [float(least.min())],
        })

    return rows.groupBy("dim", "bucket", "block").applyInPandas(run, _PACKED)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:  # ties with the k-th stay in
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(queries, query_ids, thresholds, vectors, ids, k: int):
    """(query id, candidate id, score) of each query's k best in a block whose vectors are longest first."""
    exact = vectors.size == 0 or queries.size == 0 or float(np.abs(vectors).max()) * float(np.abs(queries).max()) * vectors.shape[1] < 2.0**53
    numbers = vectors.astype(np.float64)
    norms = np.sqrt((numbers**2).sum(axis=1))
    unit = numbers / np.where(norms, norms, 1)[:, None]
    columns = np.ascontiguousarray(unit.T)
    product = numbers if exact else vectors
    for q, own, threshold in zip(queries, query_ids.tolist(), thresholds.tolist()):
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        keep = np.arange(len(ids))
        if threshold > 0 and length > 0:
            local = threshold / (length * max(norms[0], 1e-300)) * (1 - 1e-9)
            if local > 1:
                continue
            if local >= COORDINATE_FROM and vectors.shape[1] > FOCUS:
                direction = q / length
                near = np.ones(len(ids), dtype=bool)
                for f in np.argsort(-np.abs(direction))[:FOCUS]:
                    wide = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - direction[f] ** 2)) + 1e-9
                    low, high = local * direction[f] - wide, local * direction[f] + wide
                    # a vector may lie closer to q than the threshold asks, up to q itself
                    near &= (columns[f] >= (low if low < direction[f] else direction[f])) if direction[f] > 0 else (columns[f] <= max(high, direction[f]))
                keep = np.flatnonzero(near)
            else:
                keep = keep[: int(np.searchsorted(-norms, -threshold / length * (1 - 1e-9), side="right"))]
        keep = keep[ids[keep] != own]
        if len(keep):
            scores = product[keep] @ (q.astype(np.float64) if exact else q)
            found = _best(scores, ids[keep], k)
            yield [own] * len(found), ids[keep][found].tolist(), [int(s) for s in scores[found].tolist()]


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Streams each block's queries past its candidates: a task holds one block and one group of queries."""

    def run(batches):
        vectors = ids = where = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    where = (row["dim"], row["bucket"], row["block"])
                    ids = np.frombuffer(row["ids"], dtype=np.int64)
                    vectors = np.frombuffer(row["vectors"], dtype=np.int64).reshape(len(ids), row["dim"])
                elif (row["dim"], row["bucket"], row["block"]) == where:
                    own = np.frombuffer(row["ids"], dtype=np.int64)
                    asked = np.frombuffer(row["vectors"], dtype=np.int64).reshape(len(own), row["dim"])
                    found = [sum(c, []) for c in zip(*search_block(asked, own, np.frombuffer(row["thresholds"]), vectors, ids, k))] or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    keyed = candidates.unionByName(queries).repartition("dim", "bucket", "block").sortWithinPartitions("dim", "bucket", "block", "kind")
    return keyed.mapInArrow(run, "query_id long, vec_id long, score long")


def _one_of_each_id(rows: DataFrame) -> DataFrame:
    """Rows without others of the same id. Vectors of ids that stand alone, mostly all, don't move."""
    repeated = saved(rows.groupBy("vec_id").count().where("count > 1").select("vec_id", "count"), "repeated")
    total = repeated.agg(F.sum("count")).first()[0]
    if not total:
        return rows
    known = repeated.withColumnRenamed("count", "copies")
    several = join_groups(rows, known, "vec_id", "copies", total).drop("copies")
    least = several.groupBy("vec_id").agg(F.min(F.struct("dim", "vector", "norm", "lot")).alias("r"))
    alone = rows.join(known, "vec_id", "left_anti")
    return saved(alone.unionByName(least.select("vec_id", "r.dim", "r.norm", "r.vector", "r.lot")), "different")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all rows with another id. Fewer candidates
    give fewer rows; an empty table gives none. Rows that share an id are one row, the one with the least vector (by
    dimension, then bytes): a query's answers are different ids. See quantise() for rows that take no part. Other
    columns are not read.
    """
    rows = _one_of_each_id(saved(quantise(embeddings, scale, id, vector), "quantised"))
    total = rows.count()
    edges = sorted(set(rows.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.001))) if total else []
    bucket = F.lit(len(edges))
    for i, edge in enumerate(edges):  # bucket 0 has the longest vectors
        bucket = F.when(F.col("norm") >= edge, len(edges) - 1 - i).otherwise(bucket)
    blocks = max(1, -(-total // (BUCKETS * BLOCK)))
    dealt = rows.withColumn("bucket", bucket.cast("int")).withColumn("block", F.col("lot") % blocks).withColumn("threshold", F.lit(float("-inf")))
    candidates = saved(_pack(dealt, 0), "blocks")
    groups = max(1, -(-total // (every * QUERY_BLOCK)))
    asked = rows.where(F.col("vec_id") % every == 0)

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        packed = _pack(queries.select("vec_id", "dim", "norm", "vector", "threshold", F.lit(0).alias("bucket"), (F.col("lot") % groups).alias("block")), 1)
        bounds = {0: float("inf")} if first else {b: edges[len(edges) - b] for b in range(1, len(edges) + 1)}
        of = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(most).alias("most")) for b, most in bounds.items()]).cast("array<struct<bucket:int,most:double>>")
        worth = F.filter(of, lambda x: F.col("longest") * x["most"] >= F.col("least") * (1 - 1e-9))
        pairs = packed.drop("bucket", "block").select("*", F.explode(worth).alias("to")).select("*", "to.bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        return _search(candidates.where("bucket = 0" if first else "bucket > 0"), pairs.select(*candidates.columns), k)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    early = saved(meet(asked.withColumn("threshold", F.lit(float("-inf"))), True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "early")
    known = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("threshold"))
    primed = asked.join(known.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))
    late = meet(primed, False)
    return early.unionByName(late).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """Query 7: top_k() of all embeddings, five for each id divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
