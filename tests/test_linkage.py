from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.config import DEFAULT, FEATURES
from kinfold.functions.trees import Trees, with_tree_scores
from kinfold.functions.translit import with_any_latin
from kinfold.operators import blocking, contract, features, metrics, policy, rare, scoring
from kinfold.plans.linkage import link
from kinfold.sources.entities import read_tsv, with_index
from kinfold.sources.output import publish, shards
from kinfold.streaming.linkage import link_batches

S1 = "row_pos long, s1_id string, n string, a string, c string"
T = "target_idx long, entity_id string, n string, a string, c string, source int"


def keys(spark, n, a, c):
    row = spark.createDataFrame([(n, a, c)], "n string, a string, c string").select(blocking.all_keys(F.col("n"), F.col("a"), F.col("c")).alias("k")).first()
    return sorted(row["k"])


def test_keys_of_each_route(spark):
    assert keys(spark, "", "", "x") == keys(spark, "abc", "123", "") == []
    assert keys(spark, "abc", "12", "x") == ["E|x|abc"]
    assert keys(spark, "ab cd", "", "x") == ["E|x|ab cd", "P4|x|abcd"]
    assert keys(spark, "the zeta alpha beta gamma inc", "7 123 456 123", "x") == [
        "AN|x|123", "AN|x|456", "E|x|the zeta alpha beta gamma inc", "P4|x|thez", "P6|x|thezet",
        "ST|x|alpha_beta", "ST|x|alpha_gamma", "ST|x|beta_gamma", "ST|x|beta_zeta", "ST|x|gamma_zeta", "W|x|alpha", "W|x|gamma",
    ]


def test_a_key_over_the_cap_goes_whole(spark):
    t = spark.createDataFrame([(i, f"S2-{i}", "acme", "", "x", 2) for i in range(4)], T)
    s1 = spark.createDataFrame([(0, "S1-0", "acme", "", "x")], S1)
    assert blocking.baseline(s1, t, replace(DEFAULT, posting_cap=4)).count() == 4
    assert blocking.baseline(s1, t, replace(DEFAULT, posting_cap=3)).count() == 0


@pytest.fixture(scope="module")
def streets(spark):
    """One entity, and targets that share its rare street words but no name."""
    s1 = spark.createDataFrame([(0, "S1-0", "acme", "north quarry lane 12", ""), (1, "S1-1", "other", "", "")], S1)
    t = spark.createDataFrame([(i, f"S2-{i}", f"firm{i}", "north quarry lane 12" if i % 2 else "north quarry lane 99", "", 2) for i in range(30)], T)
    return s1, t


def test_rare_route_without_country_and_its_caps(spark, streets):
    s1, t = streets
    base = blocking.baseline(s1, t)
    assert base.count() == 0  # no country, no keys
    assert {r["token"] for r in rare.chosen_tokens(s1, t).collect()} == {"lane", "north"}  # ties by token
    assert rare.eligible(s1, t).count() == 30
    assert rare.eligible(s1, t, replace(DEFAULT, eligible_cap=30)).count() == 30
    assert rare.eligible(s1, t, replace(DEFAULT, eligible_cap=29)).count() == 0
    best = rare.best_added(rare.added(rare.eligible(s1, t), base), s1, t).orderBy("rank").collect()
    assert [r["target_idx"] for r in best] == [*range(1, 30, 2), *range(0, 20, 2)]  # conflicting numbers last, then by index


def test_additions_are_what_the_baseline_lacks(spark, streets):
    s1, t = streets
    base = spark.createDataFrame([("S1-0", 1)], "s1_id string, target_idx long")
    found = rare.candidates(s1, t, base).collect()
    assert sorted((r["target_idx"], r["is_rare"]) for r in found)[:3] == [(0, 1), (1, 0), (2, 1)]


def test_numeric_overlap_alone_is_not_enough(spark):
    s1 = spark.createDataFrame([(0, "S1-0", "a", "111 222 main", "")], S1)
    t = spark.createDataFrame([(0, "S2-0", "b", "111 222 side", "", 2)], T)
    assert rare.pool(s1, t).count() == 1 and rare.eligible(s1, t).count() == 0


def features_of(spark, q, t, source=2, is_rare=0):
    s1 = spark.createDataFrame([(0, "S1-0", *q)], S1)
    targets = spark.createDataFrame([(0, "S2-0", *t, source)], T)
    pairs = spark.createDataFrame([("S1-0", 0, is_rare)], "s1_id string, target_idx long, is_rare int")
    return features.with_features(features.pair_records(pairs, s1, targets)).first()


def test_features_of_empty_records(spark):
    f = features_of(spark, ("", "", ""), ("", "", ""))
    assert (f["name_token_jaccard"], f["address_token_jaccard"], f["numeric_jaccard"]) == (1, 1, 1)
    assert (f["name_char_trigram_jaccard"], f["transliterated_token_jaccard"], f["name_exact"], f["country_equal"]) == (0, 0, 0, 0)
    assert (f["s1_address_missing"], f["target_address_missing"], f["name_is_short"], f["name_length_ratio"]) == (1, 1, 1, 0)
    assert set(FEATURES) <= set(f.asDict())


def test_features_across_scripts_and_numbers(spark):
    f = features_of(spark, ("москва", "1 a", "india west"), ("moskva", "2 a", "india west"), 3, 1)
    assert (f["name_script_mismatch"], f["transliterated_name_fuzz"], f["numeric_conflict"], f["is_india"], f["target_is_s2"]) == (1, 1, 1, 1, 0)
    assert f["route_agreement_count"] == f["original_route_count"] + 1


def test_a_wrong_source_fails(spark):
    with pytest.raises(Exception, match="2 or 3"):
        features_of(spark, ("a", "b", "c"), ("a", "b", "c"), source=4)


def test_transliteration(spark):
    names = ["北京市", "αθηνα", "bücher", "plain", "токио", "ミカン"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    found = {r["n"]: r["l"] for r in with_any_latin(rows, "n", "l").collect()}
    assert found == {"北京市": "bei jing shi", "αθηνα": "athena", "bücher": "bucher", "plain": "plain", "токио": "tokio", "ミカン": "mikan"}


def test_policy_thresholds_cap_and_ties(spark):
    near = float(np.nextafter(np.float32(0.98), np.float32(0)))
    rows = [("a", 0, 0.98, 0.0), ("a", 1, near, 0.0), ("a", 2, 0.985, 1.0), ("a", 3, 0.99, 1.0)] + [("b", i, 0.995, 0.0) for i in range(12)]
    scored = spark.createDataFrame(rows, "s1_id string, target_idx long, score float, numeric_conflict float")
    best = policy.best_matches(policy.accepted(scored))
    found = {s: [r["target_idx"] for r in best.where(F.col("s1_id") == s).orderBy("rank").collect()] for s in "ab"}
    assert found == {"a": [3, 0], "b": list(range(11, 0, -1))}
    for odd in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="score not finite: a 4"):
            policy.accepted(spark.createDataFrame([*rows, ("a", 4, odd, 0.0)], scored.schema)).collect()


def test_mean_is_added_in_32_bits(spark):
    p = [0.1, 0.7, 0.3333333, 0.9]
    row = scoring.with_mean(spark.createDataFrame([tuple(p)], "p0 float, p1 float, p2 float, p3 float")).first()
    a, b, c, d = map(np.float32, p)
    assert np.float32(row["score"]) == np.float32((((a + b) + c) + d) / np.float32(4))


def test_tree_scores(spark):
    dump = [{"nodeid": 0, "split": "name_exact", "split_condition": 0.5, "yes": 1, "no": 2, "missing": 2, "children": [{"nodeid": 1, "leaf": -1.0}, {"nodeid": 2, "leaf": 2.0}]}, {"leaf": 0.5}]
    trees = Trees.parse(dump)
    x = np.zeros((3, len(FEATURES)), dtype=np.float32)
    x[1, 0], x[2, 0] = 1, np.nan
    expected = 1 / (1 + np.exp(-np.array([-0.5, 2.5, 2.5], dtype=np.float32)))
    assert np.allclose(trees.predict(x), expected)
    rows = spark.createDataFrame(x[:2].tolist(), ", ".join(f"{f} float" for f in FEATURES))
    assert np.allclose(sorted(r["p0"] for r in with_tree_scores(rows, [trees]).collect()), expected[:2])


def lists(spark, rows):
    c = spark.createDataFrame([(i, s, x) for i, s, x, _ in rows], "row_pos long, source1_entity_id string, candidate_entity_ids string")
    m = spark.createDataFrame([(i, s, x) for i, s, _, x in rows], "row_pos long, source1_entity_id string, matched_entity_ids string")
    return c, m


def test_contract(spark):
    s1 = spark.createDataFrame([(i, f"S1-{i}", "", "", "") for i in range(7)] + [(7, "S1-0", "", "", "")], S1)
    many = ",".join(f"S2-{i}" for i in range(12))
    rows = [(0, "S1-0", "S2-a,S3-b", "S3-b"), (1, "S1-1", "S2-a,S2-a", ""), (2, "S1-2", many, many), (3, "S1-3", "S2-a", "S3-b"), (4, "S1-5", "", ""), (5, "S1-5", "S1-9", ""), (7, "S1-0", "", "")]
    found = {(r["rule"], r["source1_entity_id"]) for r in contract.violations(s1, *lists(spark, rows)).collect()}
    assert found == {
        ("repeated candidate", "S1-1"), ("too many matches", "S1-2"), ("match is no candidate", "S1-3"), ("entity missing or out of order", "S1-4"),
        ("wrong target id", "S1-5"), ("row counts differ", "S1-6"), ("repeated entity", "S1-0"),
    }
    with pytest.raises(ValueError, match="contract"):
        contract.check(s1, *lists(spark, rows))


def test_score_contract(spark):
    t = spark.createDataFrame([(0, "S2-0", "", "", "", 2), (1, "S2-1", "", "", "", 3)], T)
    scored = spark.createDataFrame([("a", 0, 0.5), ("a", 0, 0.5), ("a", 1, float("nan")), ("a", 9, 0.1)], "s1_id string, target_idx long, score float")
    assert sorted(r["rule"] for r in contract.score_violations(scored, t).collect()) == ["missing target", "repeated pair", "score not finite", "wrong source"]


def test_shards_with_fewer_rows_than_workers(spark):
    s1 = spark.createDataFrame([(i, f"S1-{i}", "", "", "") for i in range(5)], S1)
    ranges = contract.shard_ranges(shards(s1, 4)).orderBy("shard").collect()
    assert [(r["shard"], r["first_pos"], r["end_pos"]) for r in ranges] == [(0, 0, 2), (1, 2, 4), (2, 4, 5)]  # no empty shard
    assert all(r["contiguous"] for r in contract.gaps(contract.shard_ranges(shards(s1, 4))).collect())


def test_index_over_sparse_ids(spark):
    rows = spark.createDataFrame([(g, i) for g in (2, 3) for i in (-9000, 5, 6, 4096, 10**12)], "g int, i long")
    found = with_index(rows.repartition(5), ["g"], "i", "x").orderBy("x").collect()
    assert [(r["g"], r["i"]) for r in found] == sorted((r["g"], r["i"]) for r in rows.collect()) and [r["x"] for r in found] == list(range(10))


def test_tsv_in_and_out(spark, tmp_path):
    path = tmp_path / "s1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""q"" b"\t\tx\nS1-0\tc\td\t\n')
    rows = read_tsv(spark, str(path)).orderBy("row_pos").collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'a "q" b', "", "x", 0), ("S1-0", "c", "d", "", 1)]
    path.write_text("wrong\n")
    with pytest.raises(ValueError, match="header"):
        read_tsv(spark, str(path))
    s1 = spark.createDataFrame([(0, "S1-1", "", "", ""), (1, "S1-0", "", "", "")], S1)
    c, m = lists(spark, [(0, "S1-1", "S2-a,S3-b", "S3-b"), (1, "S1-0", "", "")])
    out = str(tmp_path / "out")
    publish(s1, c, m, out)
    assert [r[0] for r in spark.read.text(f"{out}/matching_results.tsv").collect()].count("S1-1\tS3-b") == 1
    with pytest.raises(FileExistsError):
        publish(s1, c, m, out)


def test_entities_without_pairs_stay(spark):
    s1 = spark.createDataFrame([(0, "S1-0", "acme works", "1 road", "x"), (1, "S1-1", "none", "", "")], S1)
    t = spark.createDataFrame([(0, "S2-0", "acme works", "1 road", "x", 2)], T)
    found = link(s1, t)
    assert [tuple(r) for r in found.candidate_lists.orderBy("row_pos").collect()] == [(0, "S1-0", "S2-0"), (1, "S1-1", "")]
    assert [tuple(r) for r in found.match_lists.orderBy("row_pos").collect()] == [(0, "S1-0", "S2-0"), (1, "S1-1", "")]


def test_figures(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, v double")
    b = spark.createDataFrame([(1, 0.25), (3, 0.0)], "k int, v double")
    assert tuple(metrics.largest_difference(a, b, ["k"], ["v"]).first()) == (1, 2, 0.25)
    assert tuple(metrics.f_half(a, b, ["k"]).first()) == (0.5, 0.5, 0.5)
    assert metrics.fingerprint(a, ["k", "v"]).first() == metrics.fingerprint(a.repartition(3), ["v", "k"][::-1]).first()


def test_a_stream_of_entities(spark, tmp_path):
    t = spark.createDataFrame([(0, "S2-0", "acme works", "1 road", "x", 2)], T)
    spark.createDataFrame([(0, "S1-0", "acme works", "1 road", "x")], S1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(S1).parquet(f"{tmp_path}/in")
    query = link_batches(stream, t, f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert [r["matched_entity_ids"] for r in spark.read.parquet(f"{tmp_path}/out/matches").collect()] == ["S2-0"]
