import os

import numpy as np
import pytest

from kinfold.llm import jaccard, simhash

from .test_dedup import TABLES, docs, slow_components

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


def slow_sets(text, shingle=5):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(shingle)))) or frozenset([tuple(words)])


def slow_kept(texts):
    """Least ids of the components of texts alike by 4/5 or more."""
    sets, up = {i: slow_sets(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {find(i) for i in texts}


def test_near_stage_drops_all_texts_alike_by_four_fifths(spark):
    import corpus_pipeline as p

    rows = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = {r["doc_id"] for r in p.near_dedup(spark, rows, TABLES).collect()}
    assert kept == slow_kept({r["doc_id"]: r["text"] for r in rows.collect()})


def test_similarities_around_the_limit(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    texts = {1: words, 2: words[:100], 3: words[:96], 4: words[20:], 5: words[10:110], 6: [*words[:60], "x", *words[61:]], 7: [*words[:30], "y", *words[31:90], "z", *words[91:]]}
    texts |= {20 + i: [*words[:50], f"u{i}", *words[50:]] for i in range(30)} | {60: ["a", "b"], 61: ["A", "b"], 62: ["a"], 63: [], 64: []}
    texts = {i: " ".join(t) for i, t in texts.items()}
    for rounds, budget, together in ((2, 3, 2048), (0, 0, 5)):  # min-hash keys alone find all pairs, too
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "TOGETHER", together)
        assert {r["doc_id"] for r in jaccard.keep_one_of_each(docs(spark, texts.items()), budget=budget).collect()} == slow_kept(texts)


def test_sketches_never_differ_more_than_the_sets():
    draw = np.random.default_rng(2)
    for n, m, shared in [(3, 3, 2), (100, 90, 85), (1000, 300, 300), (40, 7000, 0), (0, 5, 0)]:
        both = draw.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        a, b = both[:n], both[n - shared :]
        assert jaccard.sketches_differ(jaccard.sketch(a), jaccard.sketch(b)) <= n + m - 2 * shared
    others = draw.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    assert jaccard.sketches_differ(*map(jaccard.sketch, others)) > 500


def test_sketch_pairs_are_those_of_all_pairs():
    draw = np.random.default_rng(7)
    pool = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(draw.choice(pool[: int(draw.integers(20, 400))], int(draw.integers(10, 300)))) for _ in range(150)]
    sets += [s[: len(s) - len(s) // 12] for s in sets[:60]]
    n, root, part = np.array([len(s) for s in sets]), draw.integers(0, 100, len(sets)), draw.integers(0, 2, len(sets))
    sketches = [jaccard.sketch(s) for s in sets]
    for across in (False, True):
        found = {frozenset((int(i), int(j))) for a, b in jaccard.sketch_pairs(n, root, part, sketches, across) for i, j in zip(a, b)}
        for i in range(len(sets)):
            for j in range(i):
                if root[i] != root[j] and not (across and part[i] == part[j]):
                    near = 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and 9 * jaccard.sketches_differ(sketches[i], sketches[j]) <= n[i] + n[j]
                    assert (frozenset((i, j)) in found) == near
    assert len(found) > 20


def test_budgets_of_other_sizes_deal_every_pair(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 62, 50, dtype=np.int64)
    near = [int(x) ^ sum(1 << int(b) for b in draw.choice(62, k, replace=False)) for x in base for k in (3, 4)]
    fp = sorted({*base.tolist(), *near})
    edges = spark.createDataFrame([(f,) for f in fp], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(edges, 3)).collect()}
    expected = slow_components(dict(zip(fp, fp)), 3)
    assert found == {f: r for f, r in expected.items() if f != r}


def test_components_on_the_driver_are_those_by_stars(spark, monkeypatch):
    draw = np.random.default_rng(6)
    u, v = draw.integers(-(1 << 40), 1 << 40, 120)[draw.integers(0, 120, (2, 100))]
    edges = spark.createDataFrame([(int(max(a, b)), int(min(a, b))) for a, b in zip(u, v) if a != b], "u long, v long").distinct()
    found, written = [], []
    save = simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, name: written.append(name) or save(df, name))
    for few in (1 << 18, 0):
        monkeypatch.setattr(simhash, "FEW", few)
        found.append(sorted(map(tuple, simhash.components(edges).collect())))
        assert ("large-star" in written) == (few == 0)
    assert found[0] == found[1] and len(found[0]) > 50
