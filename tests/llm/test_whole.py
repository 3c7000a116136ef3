"""Rows that share an id or have none, and features that a smaller job would leave out."""

import numpy as np
import pytest

from kinfold.llm import jaccard, quality, simhash, substrings

from .test_dedup import docs

SCHEMA = "doc_id long, text string, n_chars long"


@pytest.mark.parametrize("keep", [simhash.keep_one_of_each, jaccard.keep_one_of_each])
def test_components_that_share_an_id_or_have_none_all_stay(spark, keep):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = docs(spark, [(5, a), (5, b), (1, a.upper()), (None, c), (None, "d e f g h"), (None, b + " "), (5, b)])
    assert sorted((r["doc_id"] or -1, r["text"]) for r in keep(rows).collect()) == sorted([(1, a.upper()), (5, b), (-1, c), (-1, "d e f g h")])


def test_a_passage_goes_from_all_but_one_of_rows_with_one_id_or_none(spark):
    p, q = (" ".join(f"{x}{i}" for i in range(40)) for x in "pq")
    rows = docs(spark, [(None, f"{p} x"), (None, f"{p} y"), (7, f"{q} x"), (7, f"{q} y"), (7, f"{q} z")])
    found = sorted((r["row"]["doc_id"] or -1, r["n_removed"]) for r in substrings.remove_repeats(rows).collect())
    assert found == [(-1, 0), (-1, 40), (7, 0), (7, 40), (7, 40)]


def test_metadata_is_a_feature_of_quality(spark):
    rows = [(i, "same words here", 10 + i % 2 * 1000) for i in range(400)]
    table = spark.createDataFrame([*rows, (1000, "same words here", None)], SCHEMA)
    labels = spark.createDataFrame([(i, n > 100) for i, _, n in rows], "doc_id long, q boolean").selectExpr("doc_id", "int(q) AS quality")
    model = quality.learn(table, labels)
    score = {r["doc_id"]: r["score"] for r in quality.with_score(table, model).collect()}
    assert all((score[i] >= 0.5) == (i % 2 == 1) for i in range(400)) and 0 <= score[1000] <= 1
    plain = [r["score"] for r in quality.with_score(table.drop("n_chars"), model).collect()]
    assert np.ptp(plain) == 0
