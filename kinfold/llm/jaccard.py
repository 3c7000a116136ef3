"""Near-duplicate stage: SimHash proposes, the exact Jaccard similarity of word shingles decides, at 4/5 or more.

1. Every row gets, of its set of shingles, a mark (from here on a set is one node, however many rows have it), a SimHash
   fingerprint, KEYS min-hash keys of TURNS hashes each, and a sketch: the parity of its shingles over buckets of a hash.
2. Fingerprints within BUDGET bits are found by the trie self-join of simhash.links(), proposed as pairs and joined into
   components. Then each set is proposed with one leader of each of its min-hash keys, if that is of another component;
   after each such round components grow, and another set leads. That is linear work, even in a family of a third of all
   rows.
3. Sets of different components that share a min-hash key are compared by their sketches, inside the tasks. Sets alike by
   4/5 share no key with a probability of (1 - 0.8^TURNS)^KEYS, under 10^-7; more alike ones, of less. Keys of one component
   have nothing to compare, and sets of a key that very many have are dealt in blocks, each pair to one block.
4. Two sketches differ in no more places than the sets do, so sketches that differ too much rule a pair out; only the pairs
   left become rows, and are compared by all their shingles, as 64-bit hashes.
5. Links join into components, and one row of each stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, saved
from .simhash import components, links, majority, rows_of, text_hash
from .substrings import _ODD, REMEMBERED, Words

SHINGLE = 5
#: Bits in which fingerprints may differ to be proposed.
BUDGET = 3
#: Min-hash keys of a set, and hashes of each.
KEYS, TURNS = 32, 4
#: Rounds of leaders at most (a round without a link is the last), and sets of one key that a task compares at once, on average.
ROUNDS, TOGETHER = 2, 2048
#: Texts that are picked by broadcast, at most; more are picked by shuffle.
PICKED = 1 << 20
#: Words of the texts that are hashed together, and shingles that are min-hashed together.
PIECE, PART = 1 << 19, 1 << 12
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, KEYS * TURNS, dtype=np.uint64) | np.uint64(1)


def shingles(w: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text with these hashes of words; a shorter text is one shingle, one without words has none."""
    if not len(w):
        return w
    k = min(shingle, len(w))
    g = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        g = (g ^ (g >> np.uint64(29))) * _ODD[0] + w[j : j + len(g)] * _ODD[1]
    g = (g ^ (g >> np.uint64(31))) * _ODD[2]
    return np.unique(g ^ (g >> np.uint64(29)))


def _sets(batches, shingle: int):
    """The batches in pieces of about PIECE words, with the sets of their column 0."""
    words = Words()
    for batch in batches:
        first, numbers, held = 0, [], 0
        for i, t in enumerate(batch.column(0)):
            numbers.append(words.numbers((t.as_py() or "").encode().lower().split()))  # bytes: A-Z and ASCII white space only
            held += len(numbers[-1])
            if held >= PIECE or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), [shingles(words.hashes(n), shingle) for n in numbers]
                first, numbers, held = i + 1, [], 0
                words = Words() if len(words) > REMEMBERED else words


def _mark(g: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(g.tobytes(), 42)).view(np.int64)) if len(g) else 0


def _least(g: np.ndarray) -> np.ndarray:
    """The least of each of the hashes of a set that isn't empty."""
    parts = [(g[i : i + PART] * _FACTORS[:, None]).min(axis=1) for i in range(0, len(g), PART)]
    return np.min(parts, axis=0)


def _keys(g: np.ndarray) -> np.ndarray:
    """Min-hash keys of a set; none of an empty one."""
    if not len(g):
        return np.zeros(0, dtype=np.int64)
    key, least = np.arange(KEYS, dtype=np.uint64), _least(g).reshape(KEYS, TURNS)
    for turn in range(TURNS):
        key = ((key ^ (key >> np.uint64(29))) * _ODD[3] + least[:, turn]) * _ODD[1]
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def sketch(g: np.ndarray) -> np.ndarray:
    """How many shingles fall in each of 2 to 4 times as many buckets, odd or even: a bit each, in bytes."""
    size = 1 << max(6, (2 * len(g) - 1).bit_length())
    found = np.bincount((g ^ (g >> np.uint64(32))).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits(found.astype(np.uint8) & 1, bitorder="little")


def sketches_differ(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of shingles that only one of two sets has. The larger sketch is folded to the smaller."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _marked(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h (hash of the text), and of its set: fp (mark), n (size), sim (SimHash), keys, sketch; for every row."""

    def run(batches):
        for batch, sets in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1), batch.column(2), pa.array([_mark(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int32()),
                    pa.array(np.array([majority(g) for g in sets], dtype=np.uint64).view(np.int64)), pa.array([_keys(g) for g in sets], pa.list_(pa.int64())),
                    pa.array([sketch(g).tobytes() for g in sets], pa.binary()),
                ],
                names=["doc_id", "h", "fp", "n", "sim", "keys", "sketch"],
            )

    return texts.select("text", "doc_id", "h").mapInArrow(run, "doc_id long, h long, fp long, n int, sim long, keys array<long>, sketch binary")


def _with_both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """u, v, a, b: pairs with the value of either side; a node of very many pairs meets them by broadcast."""
    total = pairs.count()
    for node, value in (("u", "a"), ("v", "b")):
        degrees = pairs.groupBy(node).agg(F.count("*").alias("_degree"))
        known = degrees.join(values.select(F.col("fp").alias(node), F.col("value").alias(value)), node)
        pairs = join_groups(pairs, known, node, "_degree", total).drop("_degree")
    return pairs.select("u", "v", "a", "b")


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (written ones) that sketches don't rule out."""

    def rule_out(batches):
        for batch in batches:
            sizes, bits = ([batch.column(i).field(k) for i in (2, 3)] for k in (0, 1))
            a, b = ([np.frombuffer(x.as_py(), dtype=np.uint8) for x in column] for column in bits)
            near = pa.array([9 * sketches_differ(x, y) <= n + m for n, m, x, y in zip(sizes[0].to_pylist(), sizes[1].to_pylist(), a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(near)

    return _with_both(pairs, sets.select("fp", F.struct("n", "sketch").alias("value"))).mapInArrow(rule_out, "u long, v long")


def sketch_pairs(n: np.ndarray, root: np.ndarray, part: np.ndarray, sketches: list[np.ndarray], across: bool):
    """Batches (i, j) of sets whose sketches allow 4/5, roots differ and, if `across`, parts too."""
    order = np.argsort(n, kind="stable")
    size = np.array([len(x) for x in sketches])
    for of in np.unique(size):
        # the larger set of a pair alike by 4/5 has a sketch of the same size or twice that
        others = order[(size[order] == of) | (size[order] == 2 * of)]
        rows = np.stack([np.bitwise_xor.reduce(sketches[i].reshape(-1, of), axis=0) for i in others.tolist()]).view(np.uint64)
        sizes, roots, parts = n[others], root[others], part[others]
        for at in np.flatnonzero(size[others] == of).tolist():
            to = int(np.searchsorted(sizes, sizes[at] * 5 // 4, side="right"))
            near = roots[at + 1 : to] != roots[at]
            if across:
                near &= parts[at + 1 : to] != parts[at]
            j = at + 1 + np.flatnonzero(near)
            if len(j):
                j = j[9 * np.bitwise_count(rows[j] ^ rows[at]).sum(axis=1, dtype=np.int64) <= sizes[at] + sizes[j]]
                yield np.full(len(j), others[at]), others[j]


def _across(named: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): sets of one key and different roots whose sketches don't rule them out; each pair in its first key alone."""
    keyed = named.select("fp", "n", "root", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg((F.min("root") < F.max("root")).alias("open"), F.count("*").alias("size")).where("open")
    open_keys = sizes.select("key", F.ceil(F.col("size") / TOGETHER).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp", "key"), "parts").cast("int")
    left = keyed.join(open_keys, "key").withColumn("part", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = left.select("key", "fp", "n", "root", "part", other.alias("other")).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    rows = saved(dealt, "left").join(sets.select("fp", "sketch", "keys"), "fp").select("key", "lo", "hi", "fp", "n", "root", "part", "sketch", "keys")

    def run(batches):
        held, where = [], None

        def settle():
            n, root, part, fp = (np.array([r[k] for r in held], dtype=np.int64) for k in ("n", "root", "part", "fp"))
            out = [np.zeros((2, 0), dtype=np.int64)]
            if len(held) > 1 and (root != root[0]).any():
                sketches = [np.frombuffer(r["sketch"], dtype=np.uint8) for r in held]
                keys = np.array([r["keys"] for r in held], dtype=np.int64)
                for i, j in sketch_pairs(n, root, part, sketches, where[1] != where[2]):
                    first = (keys[i] == keys[j]).argmax(axis=1)
                    here = keys[i, first] == where[0]
                    out.append(np.stack([fp[i[here]], fp[j[here]]]))
            u, v = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            for row in batch.to_pylist():
                of = row["key"], row["lo"], row["hi"]
                if of != where:
                    if len(held) > 1:
                        yield settle()
                    held, where = [], of
                held.append(row)
        if len(held) > 1:
            yield settle()

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "u long, v long")


def _similar(pairs: DataFrame, marked: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(u, v), u > v: those of the pairs whose sets are at or over 4/5."""
    likely = saved(pairs.distinct(), "likely")
    if likely.isEmpty():
        return likely
    ids = likely.select(F.col("u").alias("fp")).union(likely.select("v")).distinct()
    wanted = saved(marked.select("fp", "h").join(ids, "fp").groupBy("fp").agg(F.min("h").alias("h")).select("h").distinct(), "wanted")
    picked = texts.join(F.broadcast(wanted) if wanted.count() <= PICKED else wanted, "h", "left_semi").select("text")

    def run(batches):
        for _, grams in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array([_mark(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["fp", "value"])

    def compare(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(i)] for i in (2, 3))
            near = pa.array([9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(near)

    whole = saved(picked.mapInArrow(run, "fp long, value binary").dropDuplicates(["fp"]), "whole")
    return saved(_with_both(likely, whole).mapInArrow(compare, "u long, v long"), "similar")


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


_SIZES = "5 * least({a}.n, {b}.n) >= 4 * greatest({a}.n, {b}.n) AND {a}.fp <> {b}.fp"


def _near_fingerprints(sets: DataFrame, budget: int) -> DataFrame:
    """(u, v): sets of one fingerprint, each with the least of them, and the least ones of near fingerprints."""
    node = F.struct("fp", "n")
    simmed = sets.select(node.alias("own"), "sim")
    alike = saved(simmed.groupBy("sim").agg(F.min("own").alias("leader"), F.count("*").alias("size")), "alike")
    by_sim = join_groups(simmed, alike.where("size > 1"), "sim", "size", sets.count()).select("own", "leader")
    near = links(alike.select(F.col("sim").alias("fp")), budget)
    lead = alike.select("sim", "leader")
    across = near.join(lead.toDF("u", "own"), "u").join(lead.toDF("v", "leader"), "v").select("own", "leader")
    return by_sim.unionByName(across).where(_SIZES.format(a="own", b="leader")).select(*_ordered("own.fp", "leader.fp")).distinct()


def _led(named: DataFrame, turn: int) -> DataFrame:
    """(u, v): sets (fp, n, root, keys) with the leader of each of their keys, where components and sizes let them be alike."""
    keyed = named.select(F.struct("fp", "n", "root").alias("own"), F.explode("keys").alias("key"))
    leader = F.min_by("own", F.xxhash64("own.fp", "key", F.lit(turn))).alias("leader")
    leaders = keyed.groupBy("key").agg(leader, F.count("*").alias("size"), (F.min("own.root") < F.max("own.root")).alias("open")).where("open")
    led = join_groups(keyed, saved(leaders, "leaders"), "key", "size", KEYS * named.count())
    return led.where("own.root <> leader.root AND " + _SIZES.format(a="own", b="leader")).select(*_ordered("own.fp", "leader.fp")).distinct()


def _named(sets: DataFrame, rooted: DataFrame) -> DataFrame:
    """fp, n, keys, root of every set."""
    joined = sets.select("fp", "n", "keys").join(rooted.withColumnRenamed("node", "fp"), "fp", "left")
    return saved(joined.withColumn("root", F.coalesce("root", "fp")), "named")


def _grown(rooted: DataFrame, more: DataFrame) -> DataFrame:
    """The components with more links."""
    return components(rooted.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more).distinct())


def near_sets(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, fp) and links (node, root) of all sets that are like another; null text is empty."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), value.alias("text"), text_hash(text))
    marked = saved(_marked(texts, shingle), "marked")
    sets = saved(marked.select("fp", "n", "sim", "keys", "sketch").dropDuplicates(["fp"]), "sets")
    rooted = components(_similar(_likely(saved(_near_fingerprints(sets, budget), "proposed"), sets), marked, texts, shingle))
    named = _named(sets, rooted)
    for turn in range(ROUNDS):
        found = _similar(_likely(saved(_led(named, turn), "led"), sets), marked, texts, shingle)
        if found.isEmpty():
            break
        rooted = _grown(rooted, found)
        named = _named(sets, rooted)
    more = _similar(_across(named, sets), marked, texts, shingle)
    return marked.select("doc_id", "h", "fp"), _grown(rooted, more)


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of similar texts, the one with the smallest id, all columns as they were.

    Rows without words are like each other; null text is empty; an empty table gives an empty result. Rows with a null
    id stay only where no other of the component is there. Of rows that share the kept id, one stays; rows of other
    components don't matter, whatever their id.
    """
    marked, linked = near_sets(docs, shingle, budget, id, text)
    rows = marked.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("least"))
    rooted = rows.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rows_of(docs, rooted.groupBy("root").agg(F.min("least").alias("first")), id, text)
