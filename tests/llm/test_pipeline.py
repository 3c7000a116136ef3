import importlib.util
import os

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir("/root/testdata/sf0.001"), reason="no pipeline or tables here")
FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    import corpus_pipeline as p
    from tests.llm.test_dedup import slow_repeats
    from tests.llm.test_near import slow_kept
    from tests.llm.test_tokens import check

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    good = stages["quality"](spark, docs, FOLDER)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    last = {}
    for i, t in texts.items():
        last[t] = max(last.get(t, i), i)
    unique = stages["exact_dedup"](spark, docs, FOLDER)
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == set(last.values())
    near = stages["near_dedup"](spark, docs, FOLDER)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == slow_kept(texts)
    cut = stages["substring_dedup"](spark, docs, FOLDER)
    expected = {i: k if gone else texts[i] for i, (_, gone, k) in slow_repeats(list(texts.items()), 20).items()}
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    check(stages["packing"](spark, docs, FOLDER).collect(), list(texts.items()))


def test_stages_take_odd_tables(spark):
    import corpus_pipeline as p

    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "x y z " * 5000, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS key", "2 AS _row", "3 AS score")
    for table in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, table, FOLDER)
            assert name == "packing" or out.columns == table.columns
            assert out.count() <= max(table.count(), 100)


def test_whole_run(spark):
    import corpus_pipeline as p

    assert p.run(spark, FOLDER).count() > 0
