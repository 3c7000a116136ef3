"""What a worker holds at once: bounded by words and bytes, whatever the rows look like."""

import importlib.util
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import quality, substrings
from kinfold.llm.common import BATCH_BYTES, in_small_batches

FOLDER = "/root/testdata/sf0.001"
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


class Caught:
    """Stands in for a DataFrame and keeps the function that its batches would go through."""

    def __getattr__(self, name):
        return lambda *a: self

    def mapInArrow(self, run, schema):
        self.run = run


def windows(n, window):
    """Rows of one window each, all different, route by route."""
    route = np.arange(n, dtype=np.int64)
    words = [b" ".join(b"%d.%d" % (i, j) for j in range(window)) for i in range(n)]
    return substrings._batch(substrings.SUFFIX, route, route, route, np.zeros(n), np.ones(n), np.zeros(n), words)


def test_trees_hold_words_not_windows(monkeypatch):
    held = []
    repeats = substrings.repeats
    monkeypatch.setattr(substrings, "repeats", lambda flat, *a: held.append(len(flat)) or repeats(flat, *a))
    caught, batch = Caught(), windows(6000, 20)
    substrings._grown(caught, 20, 10_000)
    out = list(caught.run(batch.slice(i, 100) for i in range(0, 6000, 100)))
    assert sum(held) >= 6000 * 20 and max(held) < 10_000 + 100 * 20
    assert not any(b.num_rows for b in out)


def test_words_of_held_rows_are_not_objects_all_at_once():
    n, rows = 20_000, substrings._Held(20)
    route, words = np.arange(n, dtype=np.int64), b" ".join(b"word%d" % j for j in range(20))
    rows.add(substrings._batch(substrings.SUFFIX, 0 * route, route, route, np.zeros(n), np.ones(n), np.zeros(n), [words] * n))
    tracemalloc.start()
    ranges, rest = rows.settle()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rest.words == [words] and ranges.num_rows == n - 1
    assert peak < n * 20 * 70, peak  # 47 bytes a word; 97 with all words as objects


def test_words_that_come_once_are_forgotten():
    buckets, numbers = quality._Buckets(), substrings.Numbers()
    words = [b"w%d" % i for i in range(1 << 18)]
    assert all(buckets[w] is not None for w in words) and len(buckets) <= 1 << 16
    for i in range(0, len(words), 1 << 14):
        assert len(set(numbers.numbers(words[i : i + (1 << 14)]).tolist())) == 1 << 14
        numbers.forget()
    assert len(numbers) <= 1 << 17


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir(FOLDER), reason="no pipeline or tables here")
def test_stages_hand_over_few_bytes_at_once(spark):
    import corpus_pipeline as p

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches], pa.int64())], names=["n"])

    long = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('ab cd ', 1500) AS text")
    for name, stage in p.STAGES:
        spark.conf.unset(LIMIT)
        stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").limit(50), FOLDER)
        if name != "exact_dedup":  # no Python there
            assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) <= BATCH_BYTES + 10_000, name
    spark.conf.set(LIMIT, "1m")
    in_small_batches(spark)
    assert spark.conf.get(LIMIT) == "1m"
    spark.conf.unset(LIMIT)


def test_written_tables_cost_the_driver_little(spark):
    from kinfold.sources.storage import written

    sc = spark.sparkContext
    df = spark.range(0, 10, 1, 2).selectExpr("id", "array(id) AS a", "struct(id AS x) AS s", "cast(id AS string) AS t")
    sc.setJobGroup("test_written", "")
    out = written(df, "t")
    jobs = len(sc.statusTracker().getJobIdsForGroup("test_written"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1  # the write alone
    assert out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
    assert not os.path.exists(f"{folder}/_SUCCESS")
