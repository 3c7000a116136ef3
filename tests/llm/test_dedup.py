import hashlib
import os

import numpy as np
import pytest
import xxhash

from kinfold.llm import exact_dedup, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], DOCS)


EDGE = [(5, None), (6, ""), (7, " \n"), (1, "a b"), (2, "a b"), (9, "A b"), (9, "A b"), (None, "a b"), (None, "only"), (3, "x " * 30_000), (4, "é ß  x")]


def test_exact_groups_of_edge_cases(spark):
    found = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs(spark, EDGE)).collect())
    assert found == sorted([
        (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True), (1, 2, 3, False), (2, 2, 3, True), (-1, 2, 3, False), (9, 9, 2, True), (9, 9, 2, False),
        (-1, -1, 1, True), (3, 3, 1, True), (4, 4, 1, True),
    ])


@pytest.mark.parametrize("bits", [4, 27])
def test_a_full_filter_changes_nothing(spark, bits):
    texts = [(i, f"text {i % 70}") for i in range(100)]
    rows = exact_dedup.exact_groups(docs(spark, texts), max_bits=bits).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == {i for i in range(100) if i >= 30} and len(rows) == 100
    kept = exact_dedup.drop_exact_copies(docs(spark, texts), max_bits=bits)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(100) if i >= 30} and kept.columns == docs(spark, texts).columns


def test_exact_dedup_with_a_hot_group_and_clashing_columns(spark):
    rows = docs(spark, [(i, "same" if i % 3 else f"t{i}") for i in range(3000)]).withColumnsRenamed({"lang": "h", "source": "sha"})
    out = exact_dedup.drop_exact_copies(rows)
    assert out.columns == rows.columns and out.count() == 1001
    assert sorted(r["group_size"] for r in exact_dedup.exact_groups(rows).select("group_size").distinct().collect()) == [1, 2000]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == 0
    assert simhash.near_components(none).count() == simhash.keep_one_of_each(none).count() == 0
    assert substrings.remove_repeats(none).count() == substrings.without_repeats(none).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def slow_components(prints, budget):
    up = {i: i for i in prints}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_of_edge_cases(spark):
    texts = [(i, t) for i, t in EDGE if i is not None][:-3] + [(3, "x " * 1000), (4, "é ß  x")]
    prints = {i: slow_fingerprint(t) for i, t in texts}
    expected = slow_components(prints, 2)
    found = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_components(docs(spark, texts)).collect()}
    assert found == {i: (prints[i], expected[i]) for i in prints}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_simhash_query_equals_brute_force(spark):
    from kinfold.llm.queries import QUERIES

    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    expected = slow_components(prints, 2)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash"](spark, TABLES).collect()}
    assert found == {i: (f"{p:016x}", expected[i]) for i, p in prints.items()}


def test_trie_finds_every_pair():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[draw.integers(0, 40, 400)] ^ (np.uint64(1) << draw.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 400, dtype=np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    found = {tuple(p) for i, j in simhash.trie_pairs(np.zeros(len(fp), dtype=np.int64), fp) for p in zip(i.tolist(), j.tolist())}
    distance = np.bitwise_count(fp[:, None] ^ fp[None, :])
    assert found == {(i, j) for i, j in zip(*np.where(distance <= 2)) if i < j}


def test_components_of_long_chains(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100, 99), (101, 99), (102, 99)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {100: 99, 101: 99, 102: 99}


def test_one_of_each_component_stays(spark):
    rows = docs(spark, [(1, "a b c d"), (2, "A b  c d"), (3, "other words here"), (3, "other words here"), (None, "a b c d"), (None, "lonely")])
    out = simhash.keep_one_of_each(rows)
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 3] and out.columns == rows.columns


def slow_repeats(texts, window):
    seen, out = {}, {}
    for i, text in sorted(texts):
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[s : s + window]), (i, s)) != (i, s):
                gone |= set(range(s, s + window))
        out[i] = (len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode())
    return out


def passages(seed, n):
    draw = np.random.default_rng(seed)
    shared = [" ".join(f"w{x}" for x in draw.integers(0, 50, draw.integers(20, 60))) for _ in range(4)]
    for i in range(n):
        own = [" ".join(f"w{x}" for x in draw.integers(0, 500, draw.integers(0, 40)))] + [shared[j] for j in draw.integers(0, 4, draw.integers(0, 3))]
        draw.shuffle(own)
        yield i, "  ".join(own)


def test_word_hashes_tell_words_apart():
    text = "a b a\tab\x0bba  é \u3000 " + " ".join(map(str, range(3000))) + " " + "ab" * 2000 + " " + "ba" * 2000
    words = text.encode().split()
    h = substrings.word_hashes(np.frombuffer(text.encode(), dtype=np.uint8)).tolist()
    assert len(h) == len(words) and len(set(h)) == len(set(words)) == len(set(zip(h, words)))
    assert len(substrings.word_hashes(np.zeros(0, dtype=np.uint8))) == 0
    draw = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    for width in (1, 2, 3, 15, 16):
        view = np.lib.stride_tricks.sliding_window_view(draw >> np.uint64(24), width)
        assert (substrings._first_least(draw, width) == view.argmin(axis=1) + np.arange(len(view))).all()


@pytest.mark.parametrize("held", [100, 1 << 20])
def test_a_hot_passage_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "HOT", 2)
    draw = np.random.default_rng(8)
    shared = " ".join(f"s{x}" for x in range(45))
    texts = [(i, " ".join([*(f"u{x}" for x in draw.integers(0, 9000, 8)), shared[: int(draw.integers(60, 250))], f"e{i % 3}", shared])) for i in range(80)]
    found = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs(spark, texts).repartition(40), held=held).collect()}
    assert found == slow_repeats(texts, 20)


@pytest.mark.parametrize("held", [60, 1 << 20])
def test_substrings_equal_brute_force(spark, held):
    texts = [*passages(1, 60), (100, None), (101, ""), (102, "a " * 300), (103, "a b " * 100), (104, " ".join(map(str, range(5000))))]
    rows = docs(spark, texts)
    found = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(rows.repartition(6), held=held).collect()}
    assert found == slow_repeats(texts, 20)


def test_repeated_rows_lose_the_same_words(spark):
    text = " ".join(map(str, range(40)))
    found = sorted((r["row"]["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(docs(spark, [(1, text), (1, text), (2, text)])).collect())
    assert found == [(1, 0), (1, 0), (2, 40)]


def test_texts_that_lose_nothing_stay_as_they_were(spark):
    text = " ".join(map(str, range(40)))
    rows = docs(spark, [(1, f"{text}\n end"), (2, f"mine  {text}\nrest")]).withColumnRenamed("lang", "key")
    out = substrings.without_repeats(rows)
    assert out.columns == rows.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{text}\n end", 2: "mine rest"}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_substring_query_equals_brute_force(spark):
    from kinfold.llm.queries import QUERIES

    expected = slow_repeats([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()], 20)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op3_substrings"](spark, TABLES).collect()}
    assert found == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in expected.items()}
