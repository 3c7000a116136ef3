"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs cost linear time, as
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

import re
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

#: Labelled documents of either class that are learned from, at most.
PER_CLASS = 3000
BUCKETS, RANK, BINS = 1 << 15, 8, 10
#: The one column of metadata that is a feature; documents may lack it.
METADATA = "n_chars"
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 12, 600, 64, 0.05, 1e-4, 7
#: Words whose bucket a worker remembers; most words of a large table come once.
REMEMBERED = 1 << 16

_ODD = re.compile(rb"[^0-9A-Za-z\x80-\xff\s.,;:!?'\"()-]")
_DIGIT = bytes.maketrans(b"123456789", b"000000000")
STATISTICS = ("characters", "words", "lines", "word_length", "distinct_words", "distinct_lines", "repeated_next", "top_word", "odd_characters", "odd_words", "capitals", "digits", "ends")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = at = zlib.crc32(word.lower().translate(_DIGIT)) % BUCKETS
        return at


def features(text: str, buckets: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the whole text's words, their values (of length 1 together), and STATISTICS."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    n, distinct = max(1, len(words)), len(counts)
    at = np.fromiter((buckets[w] for w in counts), dtype=np.int32, count=distinct)
    value = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=distinct))
    value /= np.sqrt((value**2).sum()) or 1.0
    odd = len(_ODD.findall(raw))
    statistics = np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / n, distinct / n, len(set(lines)) / max(1, len(lines)),
        sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values(), default=0) / n, odd / max(1, len(raw)), min(4.0, odd / n),
        sum(map(bytes.isupper, counts)) / max(1, distinct), sum(map(bytes.isdigit, counts)) / max(1, distinct), raw.count(b".") / n,
    ])
    return at, value, statistics


class Machine:
    """A fitted model: bounded by BUCKETS and the bins of STATISTICS and METADATA, whatever the input's size."""

    def __init__(self, edges: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray, metadata_edges: np.ndarray = np.zeros(0)):
        self.edges, self.bias, self.linear, self.factors, self.metadata_edges = edges, bias, linear, factors, metadata_edges

    def row(self, at, value, statistics, metadata: float = np.nan) -> tuple[np.ndarray, np.ndarray]:
        """metadata: the value of METADATA; none (NaN) has a bin of its own."""
        bins = BUCKETS + np.arange(len(STATISTICS)) * BINS + (self.edges < statistics[:, None]).sum(axis=1)
        own = BUCKETS + len(STATISTICS) * BINS + (BINS if np.isnan(metadata) else (self.metadata_edges < metadata).sum())
        bins = np.append(bins, own)
        return np.concatenate([at, bins]), np.concatenate([value, np.full(len(bins), 0.5)])

    def raw(self, at, x) -> float:
        v = self.factors[at]
        s = x @ v
        return float(self.bias + self.linear[at] @ x + 0.5 * ((s**2).sum() - ((v * x[:, None]) ** 2).sum()))

    def score(self, text: str, buckets: dict, metadata: float = np.nan) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.row(*features(text, buckets), metadata)), -40, 40))))


def fit(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], labels: np.ndarray, prior: float) -> Machine:
    """Fits by AdaGrad on the log loss, classes weighted alike, then moves the bias to the prior of label 1."""
    edges = np.quantile(np.array([e[2] for e in examples]), np.arange(1, BINS) / BINS, axis=0).T
    draw = np.random.default_rng(SEED)
    size = BUCKETS + len(STATISTICS) * BINS + BINS + 1
    given = np.array([e[3] for e in examples])
    given = given[~np.isnan(given)]
    metadata_edges = np.quantile(given, np.arange(1, BINS) / BINS) if len(given) else np.zeros(0)
    machine = Machine(edges, 0.0, np.zeros(size), draw.normal(0, 0.02, (size, RANK)), metadata_edges)
    rows = [machine.row(*e) for e in examples]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    seen_w, seen_v, seen_0 = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows)))):
        order = draw.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            at = np.concatenate([rows[i][0] for i in chosen])
            x = np.concatenate([rows[i][1] for i in chosen])
            starts = np.cumsum([0] + [len(rows[i][0]) for i in chosen[:-1]])
            of = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            vx = machine.factors[at] * x[:, None]
            s = np.add.reduceat(vx, starts)
            z = machine.bias + np.add.reduceat(machine.linear[at] * x, starts) + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[chosen]) * weight[chosen] / len(chosen)
            used, inverse = np.unique(at, return_inverse=True)
            gx = g[of] * x
            by = np.argsort(inverse, kind="stable")
            first = np.searchsorted(inverse[by], np.arange(len(used)))
            dw = np.add.reduceat(gx[by], first) + DECAY * machine.linear[used]
            dv = np.add.reduceat((gx[:, None] * (s[of] - vx))[by], first) + DECAY * machine.factors[used]
            seen_w[used] += dw**2
            seen_v[used] += dv**2
            seen_0 += g.sum() ** 2
            machine.linear[used] -= RATE * dw / np.sqrt(seen_w[used])
            machine.factors[used] -= RATE * dv / np.sqrt(seen_v[used])
            machine.bias -= RATE * g.sum() / np.sqrt(seen_0)
    machine.bias += float(np.log(prior / (1 - prior)))
    machine.linear, machine.factors = machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    return machine


def _metadata(docs: DataFrame):
    """The column METADATA as a double, null where it is null or not there."""
    return F.col(METADATA).cast("double") if METADATA in docs.columns else F.lit(None).cast("double")


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS, id: str = "doc_id", text: str = "text") -> Machine | float:
    """A machine fitted on a bounded sample of rows that aren't held out; with one class or none, label 1's share (or 0.5)."""
    rows, counts = sample(docs.withColumn(METADATA, _metadata(docs)), labels, column, per_class, id, text, [METADATA])

    def run(batches):
        buckets = _Buckets()
        for batch in batches:
            out = [features(t.as_py() or "", buckets) for t in batch.column(1)]
            arrays = [pa.array([o[i].tobytes() for o in out], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays, batch.column(3)], names=["doc_id", "y", "at", "value", "statistics", "metadata"])

    found = rows.select("doc_id", "text", "y", METADATA).mapInArrow(run, "doc_id long, y int, at binary, value binary, statistics binary, metadata double").orderBy("doc_id", "y").collect()
    y = np.array([r["y"] for r in found], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        total = sum(counts.values())
        return counts.get(1, 0) / total if total else 0.5
    examples = [(np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["value"]), np.frombuffer(r["statistics"]), np.nan if r["metadata"] is None else r["metadata"]) for r in found]
    return fit(examples, y, counts[1] / (counts[0] + counts[1]))


def with_score(docs: DataFrame, model: Machine | float, text: str = "text", score: str = "score") -> DataFrame:
    """docs plus the score (0 to 1) of each whole text and its METADATA; null text is empty. All columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        buckets, machine = _Buckets(), shared.value
        for texts, metadata in batches:
            yield pd.Series([machine if isinstance(machine, float) else machine.score(t or "", buckets, m) for t, m in zip(texts, metadata.astype("float64"))], dtype="float64")

    return docs.withColumn(score, scored(F.coalesce(F.col(text).cast("string"), F.lit("")), _metadata(docs)))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = with_score(docs.select("doc_id", "text", METADATA), learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
