"""SimHash near-duplicates: fingerprints, and their Hamming self-join by a binary trie.

Two fingerprints that differ in at most b of 64 bits agree in at least two of b + 2 blocks (of 16 bits for a budget of
2). Distinct fingerprints are dealt by each pair of blocks (the part of the trie that is walked without errors), and each
group's trie is joined with itself: node pairs go down together, differing bits add up, and a pair over the budget is pruned.
Tasks return one link from each fingerprint to its group's smallest, not all pairs, and links join into components by
alternating large-star and small-star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, saved, table

BUDGET = 2
SHINGLE = 3
#: Node pairs that a task holds at once, and products small enough to compare at once.
FRONTIER, SMALL = 1 << 18, 16
#: Fingerprints whose groups are joined together in one go.
CHUNK = 1 << 20
#: Edges that the driver joins into components by itself, at most (4 MB): steps over so few cost it more memory, for their plans.
FEW = 1 << 18


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, each counted as often as it stands there; 0 without words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64, count=len(grams)))


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for every row, and h (a hash of the text) if wanted; null text is empty."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", "h"][: batch.num_columns])

    read = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"), *([text_hash(text)] if hashed else []))
    return read.mapInArrow(run, "doc_id long, fp long" + ", h long" * hashed)


def _halves(lo, hi, ones):
    """Where the children of trie nodes [lo, hi) meet: ones counts the set bits before each place."""
    return hi - (ones[hi] - ones[lo])


def trie_pairs(key: np.ndarray, fp: np.ndarray, budget: int = BUDGET):
    """Batches (i, j) of places within budget bits, for fp sorted within equal keys (both ascending): trie self-joins."""
    edges = np.flatnonzero(np.diff(key)) + 1
    lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(0, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    ones_at = (-1, None)
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(depth, nodes[:, half:]), (depth, nodes[:, :half])]
            continue
        alo, ahi, blo, bhi, err = nodes
        few = (ahi - alo) * (bhi - blo) <= SMALL if depth < 64 else np.ones(len(alo), dtype=bool)
        if few.any():
            rows, cols = (ahi - alo)[few], (bhi - blo)[few]
            n = rows * cols
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(alo[few], n) + inner // np.repeat(cols, n)
            j = np.repeat(blo[few], n) + inner % np.repeat(cols, n)
            near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
            yield i[near], j[near]
        alo, ahi, blo, bhi, err = nodes[:, ~few]
        if not len(alo):
            continue
        if ones_at[0] != depth:
            ones_at = (depth, np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64))
        amid, bmid, own = _halves(alo, ahi, ones_at[1]), _halves(blo, bhi, ones_at[1]), alo == blo
        children = [
            np.stack([alo, amid, blo, bmid, err]),
            np.stack([amid, ahi, bmid, bhi, err]),
            np.stack([alo, amid, bmid, bhi, err + 1]),
            np.stack([amid, ahi, blo, bmid, err + 1])[:, ~own],
        ]
        down = np.concatenate(children, axis=1)
        down = down[:, (down[4] <= budget) & (down[0] < down[1]) & (down[2] < down[3]) & ((down[0] != down[2]) | (down[1] - down[0] > 1))]
        if down.shape[1]:
            stack.append((depth + 1, down))


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _star_links(key: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with the smallest (of its key) that it is linked to in here."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    sets, touched = _Sets(len(fp)), set()
    for i, j in trie_pairs(key, fp, budget):
        for a, b in zip(i.tolist(), j.tolist()):
            sets.join(a, b)
        touched.update(i.tolist(), j.tolist())
    at = np.fromiter(touched, dtype=np.int64, count=len(touched))
    to = np.array([sets.find(i) for i in at.tolist()], dtype=np.int64)
    return fp[at[at != to]], fp[to[at != to]]


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v) with u > v, as longs: enough links between distinct fingerprints (column fp) to connect all within budget.

    A task takes its groups a chunk at a time; a group holds only fingerprints that agree in two blocks.
    """
    blocks = budget + 2
    ends = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", 64 - to).bitwiseAND(F.lit((1 << (to - at)) - 1)) for at, to in zip(ends, ends[1:])]
    pairs = [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    keys = F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j]) for n, (i, j) in enumerate(pairs)])

    def run(batches):
        keys, values, held = [], [], 0

        def flush(upto=None):
            nonlocal keys, values, held
            key, fp = np.concatenate(keys), np.concatenate(values)
            end = len(key) if upto is None else int(np.searchsorted(key, upto))
            u, v = _star_links(key[:end], fp[:end], budget)
            keys, values, held = [key[end:]], [fp[end:]], len(key) - end
            u, v = u.view(np.int64), v.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            values.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= CHUNK and keys[-1][-1] != keys[0][0]:
                yield flush(keys[-1][-1])
        if held:
            yield flush()

    keyed = distinct.select(F.explode(keys).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node and root of every node that isn't the smallest of its component, of edges u > v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u > v): root is the smallest node of its component.

    At most FEW edges are joined on the driver, and the result is written. With more, it
    alternates large-star (each neighbour above a node to the smallest around it) and small-star (each neighbour below)
    until nothing changes; every step is written to the shared folder. Nodes with very many edges are joined by broadcast.
    """
    edges = saved(edges.select("u", "v"), "edges")
    state = None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if (n, mark) == state or not n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if n <= FEW:
            few = edges.toArrow()
            node, root = joined(*(few.column(c).to_numpy() for c in ("u", "v")))
            return saved(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})), "components")
        state = (n, mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = join_groups(both, least, "u", "degree", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(large.distinct(), "large-star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        below = join_groups(edges, least, "u", "degree", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def _rooted(marked: DataFrame, budget: int) -> DataFrame:
    """fp, least, copies, root of every fingerprint: root is the smallest of its component."""
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    linked = components(links(distinct, budget)).withColumnRenamed("node", "fp")
    return saved(distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_components(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row: component_id is the smallest id of all rows linked with it, itself included.

    Rows without words have fingerprint 0 and are linked like any other. Null ids count only if a component has no
    other (then component_id is null). An empty table gives an empty result.
    """
    marked = saved(fingerprints(docs, shingle, id, text), "fingerprints")
    total = marked.count()
    rooted = _rooted(marked, budget)
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = saved(join_groups(rooted, whole, "root", "members", total).select("fp", "component_id", "copies"), "named")
    return join_groups(marked, named, "fp", "copies", total).select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the smallest id, all columns as they were.

    Rows with a null id stay only where no other of the component is there. Of rows that share the kept id, one stays;
    rows of other components don't matter, whatever their id. The text moves once, to meet its decision in a join on
    its hash and the id.
    """
    marked = saved(fingerprints(docs, shingle, id, text, hashed=True), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("first"))
    return rows_of(docs, _rooted(marked, budget).select("fp", "root").join(least, "fp").groupBy("root").agg(F.min("first").alias("first")), id, text)


def rows_of(docs: DataFrame, stays: DataFrame, id: str, text: str) -> DataFrame:
    """One row of docs for each different `first` (doc_id, h: id and hash of the text), all columns as they were."""
    stays = saved(stays.select(F.col("first.doc_id").alias("_keep"), F.col("first.h").alias("_of")), "stays")
    wide = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).cast("long").alias("_id"), text_hash(text).alias("_h"))
    won = wide.join(stays, (F.col("_h") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    return won.dropDuplicates(["_h", "_id"]).select("_row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
