import hashlib
import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinfold.llm import chat, licenses, quality, topk, toxicity

TABLES = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
DOCS = "doc_id long, text string"


@given(st.text(alphabet="\\#</turn>: \nab", max_size=80), st.sampled_from(["user", "assistant", "system", "", "@x", "a: b\n###", "Assistant", "\\"]))
def test_chat_escapes_are_reversible(text, role):
    one, start, end = chat.format_turn(role, text)
    assert chat.unescape(one[start:end]) == text
    assert [t[:2] for t in chat.parse(one + one)] == [(role, text)] * 2


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_examples_of_edge_cases(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 5, "user", "left"),
        (2, 0, "user", "only"), (None, 0, "assistant", ""), (3, 7, None, "x"), (3, 7, None, "x"), (4, 0, "assistant", "### User: </turn>\n" * 3000),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    examples = sorted(((r["conv_id"] or -1), r["example"], chat.unescape(r["text"][r["loss_start"] : r["loss_end"]])) for r in chat.expand(turns).collect())
    assert examples[:6] == [(-1, 0, ""), (1, 0, "a"), (1, 1, "b"), (1, 2, ""), (2, 0, ""), (3, 0, "")]
    back = {r["conv_id"]: r for r in chat.read_back(chat.expand(turns)).collect()}
    for conv in (1, 2, 3, 4, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        learned = "".join(t for r, t in own if r == "assistant")
        assert back[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (back[conv]["n_turns"], back[conv]["loss_chars"], back[conv]["loss_sha256"]) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.expand(turns.limit(0)).count() == chat.read_back(chat.expand(turns.limit(0))).count() == 0


@here
def test_chat_query(spark):
    from kinfold.llm.queries import QUERIES

    rows = spark.read.parquet(f"{TABLES}/conversations.parquet").orderBy("conv_id", "turn").collect()
    found = {r["conv_id"]: r for r in QUERIES["op10_chat"](spark, TABLES).collect()}
    says = "\\### Assistant: </turn> ok"
    convs = {-7: [("user", says), ("assistant", says)]}
    for r in rows:
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(found) == set(convs)
    for c, own in convs.items():
        learned = "".join(t for r, t in own if r == "assistant")
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert found[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_licenses_of_edge_cases(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, None), (2, ""), (3, "...!"), (4, "MIT License and the Apache LICENSE; GNU General Public License"), (5, f"x {grant} y"), (5, f"x {grant} y"), (6, "mit éb license"),
        (7, "license " * 20_000 + "mit license"), (None, "licensed under CC BY-NC 4.0."), (8, "permission is hereby granted free of charge and nothing else of the notice"),
    ]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'a' AS w", "1 AS top", "2 AS hits")
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(docs).collect()}
    assert found[1] == found[2] == found[3] == (0, 0, None, None, "", "", 0.0)
    assert found[4] == (10, 3, 0, 7, "apache,gpl,mit", "apache,gpl,mit", 0.5)
    assert found[5][5:] == ("mit", 1.0) and found[5][1] == 0
    assert found[6][:2] == (3, 0) and found[7][1:4] == (1, 20_000, 20_000) and found[None][5:] == ("cc-by-nc", 1.0) and found[8][5:] == ("", 0.0)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def slow_top(rows, k=5, every=50):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out |= {(i, r): (j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("scale", [0.0, 1.0, 4.0])
def test_top_k_equals_brute_force(spark, scale):
    draw = np.random.default_rng(5)
    length = np.exp(scale * draw.normal(size=600))
    x = draw.normal(size=(600, 8)) * length[:, None]
    x[100:300] = x[100]  # copies tie
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(700, None), (750, [1.0, None]), (800, [float("nan")] * 8), (850, [float("inf")] * 8), (None, [1.0] * 8), (900, [0.0] * 8), (950, [1.0, 2.0]), (951, [3.0, -4.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table).collect()}
    assert found == slow_top(rows)


def test_top_k_of_repeated_rows(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(size=4)]) for i in range(120)]
    again = [rows[0], rows[0], rows[50], rows[7], rows[7], (9, [99.0] * 4), (9, [0.0] * 4)]
    least = {}
    for i, v in rows + again:
        q = np.floor(256 * np.array(v)).astype(np.int64).tobytes()
        least[i] = min(least.get(i, (q, v)), (q, v))
    table = spark.createDataFrame([(i, v, 0) for i, v in rows + again], VECTORS)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table).collect()}
    assert found == slow_top([(i, v) for i, (_, v) in least.items()])


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], VECTORS)
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_block_max_search_equals_brute_force(frequent):
    draw = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        v = {int(t): float(draw.choice([0.5, 1.0, 2.0])) for t in draw.choice(60, draw.integers(1, 8), replace=False)}
        length = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / length for t, w in sorted(v.items())})
    arrays = [(np.array(list(v), dtype=np.int64), np.array(list(v.values()), dtype=np.float64)) for v in [*vectors, {999: 1.0}, {}]]
    index = toxicity.BlockMaxIndex(arrays[:-2], 16, frequent)
    asked = [*range(50), 700, 701]
    for i, found in zip(asked, index.search([arrays[i] for i in asked], 10)):
        q = [*vectors, {999: 1.0}, {}][i]
        scored = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), j) for j, v in enumerate(vectors))
        assert [j for _, j in found] == [j for s, j in scored if s < 0][:10]
    assert toxicity.BlockMaxIndex([]).search(arrays[:2], 3) == [[], []]


@here
def test_toxicity_query_equals_brute_force(spark):
    """Neighbours by plain dictionaries over all pairs, and isotonic regression by its max-min formula."""
    import math
    import zlib
    from collections import Counter

    from kinfold.llm.queries import QUERIES

    def slow_terms(text):
        found = Counter()
        for w in "".join(c if c.isalnum() and c < "\x80" or c >= "\x80" else " " for c in text.lower()).encode().split():
            found[zlib.crc32(w) % (1 << 20)] += 1
            if len(w) > 5:
                found[zlib.crc32(w[:5] + b"*") % (1 << 20)] += 1
        return found

    counted = {r["doc_id"]: slow_terms(r["text"] or "") for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    known = sorted(i for i in toxic if i in counted and zlib.crc32(str(i).encode()) % 3 != 1)
    share = sum(toxic[i] for i in known) / len(known)
    df, one, zero = Counter(), Counter(), Counter()
    for i, c in counted.items():
        df.update(c.keys())
    for i in known:
        (one if toxic[i] else zero).update(counted[i].keys())
    weight = {}
    for t in {*one, *zero}:
        a, b = one[t] + 2 * share, zero[t] + 2 * (1 - share)
        z2 = (math.log(a / b) - math.log(share / (1 - share))) ** 2 / (1 / a + 1 / b)
        weight[t] = (math.log((len(counted) + 1) / (df[t] + 1)) + 0.05) * z2 / (z2 + 9)

    def vector(i):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in counted[i].items() if weight.get(t)}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    vectors = {i: vector(i) for i in counted}

    def near(i, but=None):
        scored = sorted(((sum(w * vectors[j].get(t, 0.0) for t, w in vectors[i].items()), j) for j in known if j != but), reverse=True)
        return [x for x in scored if x[0] > 1e-9][:9]

    def votes(found):
        sums = [0.02, 0.02]
        for s, j in found:
            sums[toxic[j]] += 1 / (1.05 - min(1.0, s))
        return math.log(sums[1] / sums[0])

    found = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, TABLES).collect()}
    assert set(found) == set(counted)
    x = sorted((votes(near(i, i)), toxic[i]) for i in known if vectors[i])
    n1 = sum(toxic[i] for i in known)
    of = {0: (1 - share) / (len(known) - n1) * len(x), 1: share / n1 * len(x)}

    def level(at):  # between two leave-one-out votes a score may be anything between their levels
        def mean(a, b):
            part = x[a : b + 1]
            return (sum(of[y] * y for _, y in part) + share / 2) / (sum(of[y] for _, y in part) + 0.5), sum(of[y] * y for _, y in part) / sum(of[y] for _, y in part)

        best = max(range(at + 1), key=lambda a: min(mean(a, b)[1] for b in range(at, len(x))))
        return mean(best, max(range(at, len(x)), key=lambda b: (-mean(best, b)[1], b)))[0]

    same = 0
    for i, r in found.items():
        slow = near(i)
        ids = [int(j) for j in r["evidence"].split(",") if j]
        # equal similarities may come in any order
        assert len(ids) == min(5, len(slow)) and all(abs(s - sum(w * vectors[j].get(t, 0.0) for t, w in vectors[i].items())) < 1e-5 for (s, _), j in zip(slow, ids))
        same += ids == [j for _, j in slow[:5]]
        if slow:
            v = votes(slow)
            low = [level(p) for p in range(len(x)) if x[p][0] <= v + 1e-6]
            high = [level(p) for p in range(len(x)) if x[p][0] >= v - 1e-6]
            assert max(low, default=0) - 0.05 <= r["score"] <= min(high, default=1) + 0.05
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert same >= 0.7 * len(found)


def labelled(spark, n=600):
    bad, good = "ugly nasty vile".split(), "fine kind calm mild".split()
    draw = np.random.default_rng(1)
    rows = [(i, " ".join([*draw.choice(good, 12), *(draw.choice(bad, 3) if i % 4 == 0 else [])])) for i in range(n)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, y int")


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_held_out_accuracy_and_edge_cases(spark, kind):
    docs, labels = labelled(spark)
    labels = labels.withColumns({"toxic": labels["y"], "quality": labels["y"]})
    rows = docs.union(spark.createDataFrame([(1000, None), (1001, ""), (None, "ugly nasty vile fine"), (1002, "vile " * 50_000)], DOCS)).selectExpr("*", "1 AS y", "'x' AS lang")
    if kind == "toxicity":
        scored = toxicity.score_documents(rows, toxicity.learn(docs, labels)).collect()
    else:
        scored = quality.with_score(rows, quality.learn(docs, labels)).collect()
    score = {r["doc_id"]: r["score"] for r in scored}
    assert len(scored) == 604 and all(0 <= s <= 1 for s in score.values())
    import zlib

    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((score[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held) and (kind == "quality" or score[None] > 0.5)


def test_without_labels(spark):
    docs, labels = labelled(spark, 10)
    none = labels.withColumns({"toxic": labels["y"], "quality": labels["y"]}).limit(0)
    assert toxicity.score_documents(docs, toxicity.learn(docs, none)).select("score").distinct().collect()[0][0] == 0.0
    assert quality.with_score(docs, quality.learn(docs, none)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.with_score(docs.limit(0), 0.5).count() == toxicity.score_documents(docs.limit(0), 0.5).count() == 0


def test_pairs_cost_linear_time():
    draw = np.random.default_rng(0)
    at, x = np.arange(6), draw.normal(size=6)
    m = quality.Machine(np.zeros((0, 0)), 0.3, draw.normal(size=10), draw.normal(size=(10, 4)))
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert m.raw(at, x) == pytest.approx(0.3 + m.linear[:6] @ x + pairs)
