import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from kinfold.llm import bpe, packing  # noqa: E402

RANKS, FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TABLES = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " "), (4, "a <|endoftext|> b"), (5, "naïve 北京 \U0001f600\u200d"), (5, "naïve 北京 \U0001f600\u200d"), (None, "x"), (6, "a" * 50_000), (7, " " * 30_000 + "b")]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(RANKS)


@given(st.text(alphabet="ab1 \n\t'.é\u3000s", max_size=60), st.integers(1, 5))
def test_cuts_are_safe(text, size):
    enc = bpe.encoding(RANKS)
    cut = [i for piece, one in bpe.safe_pieces(text, size) for i in (enc._encode_single_piece(piece) if one else enc.encode_ordinary(piece))]
    assert cut == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" + " " * 5000 + "y", "a  " + "\n" * 3000, " " * 1001, "word " * 20_000, " " * 400_000 + "x", "é" * 100_000 + " b"])
def test_long_texts(enc, text):
    ids = bpe.encode(enc, text)
    assert enc.decode_bytes(ids) == text.encode()
    if len(text) < 50_000:
        assert ids == enc.encode_ordinary(text)


def test_round_trip_of_edge_cases(spark, enc):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS bytes")
    encoded = bpe.encode_documents(rows, RANKS)
    assert sorted((r["doc_id"] or -1, bytes(r["bytes"])) for r in bpe.decode_documents(encoded, RANKS).collect()) == sorted((i or -1, (t or "").encode()) for i, t in EDGE)
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip_digests(rows, RANKS).collect()}
    for i, t in EDGE:
        ids = bpe.encode(enc, t or "")
        assert found[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip_digests(rows.limit(0), RANKS).count() == 0


def loaded():
    """The tokenizer as the file has it, not as the operator loads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def test_special_tokens_in_texts():
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext|", "北<|endoftext|>京"):
        assert packing.token_ids(text, FILE, RANKS) == loaded().encode(text, add_special_tokens=False).ids
    assert packing.token_ids("a <|endoftext|> b", FILE, RANKS) == [64, 220, 50256, 275]


def test_libraries_agree_on_the_fast_characters():
    own = loaded()
    for c in [*map(chr, range(1, 0x250)), *map(chr, range(0x2000, 0x2070))]:
        for text in (f"a{c}b", f" {c} {c}{c}", f"1{c}'s\n{c}"):
            assert packing.token_ids(text, FILE, RANKS) == own.encode(text, add_special_tokens=False).ids, hex(ord(c))


def check(pieces, texts, size=2048):
    by, own = {}, loaded()
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    for i, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at += p["length"]
        assert at == len(ids)
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return bins


def test_packing_of_edge_cases(spark):
    texts = [e for i, e in enumerate(EDGE) if i != 5]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS lot")
    check(packing.pack_documents(rows).collect(), texts)
    twice = packing.pack_documents(spark.createDataFrame([(5, "a b c")] * 3, "doc_id long, text string")).collect()
    assert len(twice) == 3 and packing.pack_documents(rows.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_bpe_query(spark):
    import tiktoken

    from kinfold.llm.queries import QUERIES

    import base64

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in QUERIES["op4_bpe"](spark, TABLES).collect()}
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids, own = plain.encode_ordinary(r["text"] or ""), found[r["doc_id"]]
        assert (own["n_tokens"], own["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert own["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_packing_query(spark):
    from kinfold.llm.queries import QUERIES

    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    bins = check(QUERIES["op5_packing"](spark, TABLES).collect(), texts)
    used = [sum(n for _, n in b) for b in bins.values()]
    assert sum(2048 - n for n in used) < 0.05 * 2048 * len(used)


@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_decreasing_equals_the_plain_one(lengths):
    where, offsets = packing.first_fit_decreasing(lengths, 50)
    room, expected = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((j for j, free in enumerate(room) if free >= lengths[i]), len(room))
        if b == len(room):
            room.append(50)
        expected[i] = (b, 50 - room[b])
        room[b] -= lengths[i]
    assert {i: (w, o) for i, (w, o) in enumerate(zip(where, offsets))} == expected
