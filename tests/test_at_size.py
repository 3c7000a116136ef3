import os
import random

import pytest

from kinfold.functions import similarity

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plan(spark, name):
    from kinfold.plans.queries import QUERIES

    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["policy_threshold", "policy_top11", "submission_matches", "merged_output", "run_metrics", "validate_contract", "f_half"])
def test_policy_never_works_out_scores_again(spark, name):
    assert "array_intersect" not in plan(spark, name)


@tables
@pytest.mark.parametrize(
    "name, functions",
    [("feat_ratio", {"ratios": 2}), ("feat_partial", {"partial_ratios": 1}), ("feat_token_set", {"token_set_ratios": 1}), ("feat_token_sort", {"token_sort_ratios": 2}), ("feat_translit", {"ratios": 1}),
     ("features_all", {"ratios": 3, "partial_ratios": 1, "token_set_ratios": 1, "token_sort_ratios": 2})],
)
def test_only_the_similarities_asked_for_are_made(spark, name, functions):
    import re

    made = set(re.findall(r"\b([a-z_]*ratios)\(([^)]*)\)#", plan(spark, name)))
    assert {f: sum(1 for g, _ in made if g == f) for f in {g for g, _ in made}} == functions


@tables
def test_costly_work_on_small_tables_is_dealt_out(spark):
    from kinfold.plans.queries import QUERIES

    assert QUERIES["candidate_union"](spark, FOLDER).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def slow_partial(a, b):
    if not a or not b:
        return float(a == b)
    both = [(a, b)] * (len(a) <= len(b)) + [(b, a)] * (len(b) <= len(a))
    return max(2 * similarity.lcs(x, w) / (len(x) + len(w)) for x, y in both for end in range(1, len(x) + len(y)) if (w := y[max(0, end - len(x)) : end]))


def test_batches_equal_pair_by_pair(monkeypatch):
    draw = random.Random(5)
    text = lambda most, letters: "".join(draw.choice(letters) for _ in range(draw.randint(0, most)))
    pairs = [(text(30, "ab c"), text(30, "ab c")) for _ in range(150)] + [(text(200, "abc éж😀"), text(90, "abc éж😀")) for _ in range(30)]
    pairs += [("a" * 600, "ab" * 20), ("x" * 64, "x" * 63 + "y"), ("x" * 128 + "q", "x" * 129), ("ab" * 3000, "ba" * 9), ("", ""), ("a", ""), pairs[0], pairs[0][::-1]]
    a, b = zip(*pairs)
    for lanes, cells in ((4096, 1 << 22), (7, 200)):
        monkeypatch.setattr(similarity, "LANES", lanes)
        monkeypatch.setattr(similarity, "CELLS", cells)
        expected = [similarity.lcs(x, y) for x, y in pairs]
        assert similarity.lcs_lengths(a, b).tolist() == expected
        assert similarity.ratios(a, b).tolist() == [2 * n / (len(x) + len(y)) if x or y else 1.0 for n, x, y in zip(expected, a, b)]
        assert similarity.partial_ratios(a, b).tolist() == [slow_partial(x, y) for x, y in pairs]
    assert similarity.ratios([], []).tolist() == [] == similarity.partial_ratios([], []).tolist()
