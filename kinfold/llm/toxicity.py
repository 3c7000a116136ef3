"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and weighted votes.

Terms are lower-case words and the first PREFIX bytes of longer ones, all of a whole text, hashed to SPACE numbers. A term
weighs (1 + log of its count) times its IDF over all documents times its relevance: z^2 / (z^2 + RELEVANCE), where z is
the standard score of its log odds between the labelled classes. So no term is left out, but those that say nothing about
the label can't drown the others. Each text's k nearest examples by cosine are found exactly: blocks of examples are read
only where the sum of their lists' greatest weights reaches the k-th best. The log odds of the distance-weighted votes are
calibrated by isotonic regression on leave-one-out votes of the examples, weighted to the labels' prior.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, table
from .labelled import sample

#: Labelled examples of either class, at most.
PER_CLASS = 1500
#: Numbers that terms are hashed to: this bounds the model and the counts, whatever the input's size.
SPACE = 1 << 20
PREFIX = 5
RELEVANCE = 9.0
NEIGHBOURS, BLOCK = 9, 64
#: Terms whose lists are kept as a matrix, and queries that meet it together; any values give the same neighbours.
FREQUENT, TOGETHER = 1024, 64
#: Different texts whose answers a worker remembers, at least.
ANSWERS = 1 << 12
#: Counts that travel in one row.
STRETCH = 1 << 14
THRESHOLD = 0.7

#: Bytes of words: ASCII letters and digits, and all of other characters.
_WORD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_WORD).split()


def terms(word: bytes) -> tuple[bytes, ...]:
    return (word, word[:PREFIX] + b"*") if len(word) > PREFIX else (word,)


def numbers(found: list[bytes]) -> tuple[list[int], list[int]]:
    """Numbers of these words' terms, and which word each is of."""
    crc = zlib.crc32
    long = [i for i, w in enumerate(found) if len(w) > PREFIX]
    return [crc(w) % SPACE for w in found] + [crc(found[i][:PREFIX] + b"*") % SPACE for i in long], [*range(len(found)), *long]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a whole text, in order, and how often each is there."""
    times = Counter(words(text))
    at, of = numbers(list(times))
    at, n = np.array(at, dtype=np.int64), np.fromiter(times.values(), dtype=np.float64, count=len(times))[of]
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return at[order[first]], np.add.reduceat(n[order], first) if len(first) else n


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i], ..., first[i] + n[i] - 1 of all i end to end."""
    ends = np.cumsum(n)
    out = np.repeat(first - ends + n, n)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Inverted lists of examples, cut at blocks; each cut with its greatest weight.

    The lists of the FREQUENT most frequent terms reach all blocks, so they are one matrix, and count exactly. Of the
    others, the term of number i has the cuts from term[i] on, and a cut has the postings from its first on.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK, frequent: int = FREQUENT):
        self.block, self.n, self.matrix = block, len(vectors), None
        t = np.concatenate([np.zeros(0, dtype=np.int64), *(v[0] for v in vectors)])
        weight = np.concatenate([np.zeros(0), *(v[1] for v in vectors)])
        example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        self.number = np.full(SPACE, -1, dtype=np.int32)  # rows of the matrix count down from -2
        often = np.argsort(-np.bincount(t, minlength=SPACE), kind="stable")[: min(frequent, len(np.unique(t)))]
        self.number[often] = -2 - np.arange(len(often))
        row = -2 - self.number[t]
        dense = row >= 0
        self.dense = len(often), row[dense], example[dense], weight[dense]
        t, example, weight = t[~dense], example[~dense], weight[~dense]
        order = np.lexsort((example, t))
        t, self.example, self.weight = t[order], example[order].astype(np.int32), weight[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (np.diff(self.example // block) != 0)])[: len(t)])
        self.first, self.size = new, np.diff(np.append(new, len(t)))
        self.of_block = self.example[new] // block
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        terms, self.term = np.unique(t[new], return_index=True)
        self.cuts = np.diff(np.append(self.term, len(new)))
        self.number[terms] = np.arange(len(terms))

    def _frequent(self, queries: list) -> np.ndarray:
        """Of each query and example, what the matrix adds to their similarity."""
        if self.matrix is None:
            rows, row, example, weight = self.dense
            self.matrix = np.zeros((rows, self.n))
            self.matrix[row, example] = weight
        asked = np.zeros((len(queries), len(self.matrix)))
        for i, (t, w) in enumerate(queries):
            row = -2 - self.number[t]
            asked[i, row[row >= 0]] = w[row >= 0]
        return asked @ self.matrix

    def _postings(self, cuts: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the postings of these cuts add, for a query that weighs w there."""
        n = self.size[cuts]
        at = _ranges(self.first[cuts], n)
        return np.bincount(self.example[at], np.repeat(w, n) * self.weight[at], minlength=self.n)

    def _search(self, query: tuple[np.ndarray, np.ndarray], scores: np.ndarray, k: int) -> list[tuple[float, int]]:
        at = self.number[query[0]]
        here = at >= 0
        at = at[here]
        n = self.cuts[at]
        cuts, w = _ranges(self.term[at], n), np.repeat(query[1][here], n)
        of = self.of_block[cuts]
        starts = np.arange(0, self.n, self.block)
        bound = np.maximum.reduceat(scores, starts) + np.bincount(of, w * self.most[cuts], minlength=len(starts))
        unread = np.ones(len(bound), dtype=bool)
        unread[np.argsort(-bound, kind="stable")[: 2 + k // self.block]] = False
        now = ~unread[of]
        scores = scores + self._postings(cuts[now], w[now])
        least = np.partition(scores, self.n - k)[self.n - k] if self.n > k else 0.0
        more = unread & (bound >= least * (1 - 1e-9))
        if more.any():
            now = more[of]
            scores += self._postings(cuts[now], w[now])
            least = np.partition(scores, self.n - k)[self.n - k] if self.n > k else 0.0
        near = np.flatnonzero(scores >= max(least - 1e-9, 1e-12))
        exact = scores[near].round(12)
        best = np.lexsort((near, -exact))[:k]
        return list(zip(exact[best].tolist(), near[best].tolist()))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """Each query's k best (similarity to 12 places, example), ties to the lower example; only similarities over 0.

        A block's bound is the best that the matrix gives in it and the greatest weights of its cuts. Blocks with the
        highest bounds are read first; of the others, only those whose bound reaches the k-th best similarity found so
        far. Other blocks' postings aren't touched.
        """
        if not self.n:
            return [[] for _ in queries]
        out = []
        for i in range(0, len(queries), TOGETHER):
            part = queries[i : i + TOGETHER]
            out += [self._search(q, scores, k) for q, scores in zip(part, self._frequent(part))]
        return out


def relevance(with_term: np.ndarray, without: np.ndarray, share: float) -> np.ndarray:
    """z^2 / (z^2 + RELEVANCE) of terms that this many examples of label 1 and of label 0 have; 0 where none has."""
    a, b = with_term + 2 * share, without + 2 * (1 - share)
    z2 = (np.log(a / b) - math.log(share / (1 - share))) ** 2 / (1 / a + 1 / b)
    return z2 / (z2 + RELEVANCE)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Both ends and the values of the levels of the rising function of x next to y; each is drawn to the prior by half an example."""
    levels: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        levels.append([weight[i] * y[i], weight[i], x[i], x[i]])
        while len(levels) > 1 and (levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1] or levels[-2][3] == levels[-1][2]):
            last = levels.pop()
            levels[-1] = [levels[-1][0] + last[0], levels[-1][1] + last[1], levels[-1][2], last[3]]
    value = np.array([(v[0] + prior / 2) / (v[1] + 0.5) for v in levels])
    return np.array([v[i] for v in levels for i in (2, 3)]), np.repeat(np.maximum.accumulate(value), 2)


class Voters:
    """Examples, their index and the calibration: bounded by PER_CLASS and SPACE."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], prior: float, k: int = NEIGHBOURS):
        self.prior, self.k = prior, k
        ones = [e for e in examples if e[1]]
        share = len(ones) / len(examples)
        count = [np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(e[2] for e in examples if e[1] == y)]), minlength=SPACE) for y in (0, 1)]
        self.weights = np.where(count[0] + count[1] > 0, idf * relevance(count[1], count[0], share), 0).astype(np.float32)
        vectors = [(self.vector(at, n), y, id) for id, y, at, n in examples]
        blank = [y for v, y, _ in vectors if not len(v[0])]
        # neighbours in the index share their heaviest term; labels play no part in the order
        self.examples = sorted(((v, y, id) for v, y, id in vectors if len(v[0])), key=lambda x: (int(x[0][0][x[0][1].argmax()]), hash((x[2], 7))))
        self.index = BlockMaxIndex([v for v, _, _ in self.examples])
        self.of_class = (1 - prior) / max(1, len(examples) - len(ones)), prior / max(1, len(ones))  # weight of an example
        of_blank = [self.of_class[0] * (len(blank) - sum(blank)), self.of_class[1] * sum(blank)]
        self.blank = of_blank[1] / sum(of_blank) if sum(of_blank) else prior
        self.fit()
        self.examples = [(None, y, id) for _, y, id in self.examples]  # the index has the vectors

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, of length 1 together; none without a term that an example has."""
        w = (1 + np.log(n)) * self.weights[at]
        at, w = at[w > 0], w[w > 0]
        return at, w / math.sqrt((w * w).sum()) if len(w) else w

    def votes(self, near: list[tuple[float, int]]) -> float:
        """The log odds of the distance-weighted votes."""
        sums = [0.02, 0.02]
        for similarity, i in near:
            sums[self.examples[i][1]] += 1 / (1.05 - min(1.0, similarity))
        return round(math.log(sums[1] / sums[0]), 9)

    def fit(self) -> None:
        if not self.examples:
            self.line = np.zeros(1), np.array([self.prior])
            return
        found = self.index.search([v for v, _, _ in self.examples], self.k + 1)
        x = np.array([self.votes([e for e in near if e[1] != i][: self.k]) for i, near in enumerate(found)])
        y = np.array([e[1] for e in self.examples], dtype=np.float64)
        self.line = isotonic(x, y, np.array(self.of_class)[y.astype(int)] * len(y), self.prior)
        self.index.matrix = None  # workers make it again from the lists

    def score(self, texts: list[str]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score and evidence of each text: ids and similarities of its nearest examples."""
        vectors = [self.vector(*counts(t)) for t in texts]
        found = self.index.search(vectors, self.k)
        return [
            (float(np.interp(self.votes(near), *self.line)) if len(v[0]) else self.blank, [(self.examples[i][2], x) for x, i in near])
            for v, near in zip(vectors, found)
        ]


def _frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Number of documents with each term, over all documents, and the number of documents.

    A task sends its counts in rows of STRETCH numbers; the driver gets SPACE / STRETCH rows, whatever the input's size.
    """

    def run(batches):
        found = np.zeros(SPACE + STRETCH, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                found[list(set(numbers(list(set(words(value.as_py() or ""))))[0]))] += 1
            found[SPACE] += batch.num_rows
        parts = found.reshape(-1, STRETCH)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(STRETCH, dtype=np.int64)
        for value in rows["counts"]:
            total += np.frombuffer(value, dtype=np.int64)
        return pd.DataFrame({"part": rows["part"][:1], "counts": [total.tobytes()]})

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "part long, counts binary")
    # many tasks' rows of one stretch meet in two steps
    salted = counted.groupBy("part", F.spark_partition_id() % 64).applyInPandas(add, "part long, counts binary")
    out = np.zeros((SPACE // STRETCH + 1, STRETCH), dtype=np.int64)
    for r in salted.groupBy("part").applyInPandas(add, "part long, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out[:-1].reshape(-1), int(out[-1, 0])


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS, id: str = "doc_id", text: str = "text") -> Voters | float:
    """Voters from a bounded sample of rows that aren't held out; with one class or none, label 1's share (or 0)."""
    rows, of_class = sample(docs, labels, column, per_class, id, text)

    def run(batches):
        for batch in batches:
            found = [counts(t.as_py() or "") for t in batch.column(1)]
            arrays = [pa.array([f[i].astype(kind).tobytes() for f in found], pa.binary()) for i, kind in enumerate((np.int32, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=["doc_id", "y", "at", "n"])

    drawn = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, at binary, n binary").orderBy("doc_id", "y", "at", "n").collect()
    if len({r["y"] for r in drawn}) < 2:
        total = sum(of_class.values())
        return of_class.get(1, 0) / total if total else 0.0
    examples = [(r["doc_id"], r["y"], np.frombuffer(r["at"], dtype=np.int32).astype(np.int64), np.frombuffer(r["n"], dtype=np.float32)) for r in drawn]
    frequency, n = _frequencies(docs, text)
    return Voters(np.log((n + 1) / (frequency + 1)) + 0.05, examples, of_class[1] / (of_class[0] + of_class[1]))


def score_documents(docs: DataFrame, model: Voters | float, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), neighbours (ids of the nearest labelled examples), similarities of every row.

    Null text is empty. A text without any term that an example has has no neighbours; its score is the share of label 1
    among examples without one. Repeated rows are scored alike, rows with a null id like any other; an empty table gives
    an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        voters, answers = shared.value, {}
        for batch in batches:
            out: list = []
            for i in range(0, batch.num_rows, TOGETHER):
                texts = [t.as_py() or "" for t in batch.column(1)[i : i + TOGETHER]]
                if not isinstance(voters, Voters):
                    out += [(float(voters), [])] * len(texts)
                    continue
                of = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
                new = {d: t for d, t in zip(of, texts) if d not in answers}
                answers.update(zip(new, voters.score(list(new.values()))))
                out += [answers[d] for d in of]
                if len(answers) >= ANSWERS:
                    answers.clear()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([s for s, _ in out], pa.float64()),
                pa.array([[i for i, _ in e] for _, e in out], pa.list_(pa.int64())), pa.array([[x for _, x in e] for _, e in out], pa.list_(pa.float64())),
            ], names=["doc_id", "score", "neighbours", "similarities"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, neighbours array<long>, similarities array<double>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query 1: score_documents() over all documents, learnt from the labels that aren't held out; predicted from THRESHOLD."""
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    evidence = F.array_join(F.slice("neighbours", 1, 5).cast("array<string>"), ",")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), evidence.alias("evidence"))
