"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters are cut at safe boundaries before encoding.
LONG = 20_000
#: Unicode's White_Space characters: fixed values, what \s of the pattern matches.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space that the pattern's look-ahead should not have to walk back through.
_RUN = re.compile(f"[{WHITE}]{{1000,}}")
#: A safe boundary: no match of the pattern has white space after another character.
_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(ranks_file: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG):
    """Cuts of text that tokenise by themselves as they do together: (piece, whether it is one match of the pattern)."""
    at = 0
    for run in [*_RUN.finditer(text), None]:
        end = run.start() if run else len(text)
        while at < end:
            cut = _SAFE.search(text, at + size, end) if end - at > size else None
            to = cut.start() if cut else end
            yield text[at:to], False
            at = to
        if run:  # the last white-space character belongs to what follows, if anything does
            at = run.end() - (run.end() < len(text))
            yield text[run.start() : at], True


def encode(enc, text: str) -> list[int]:
    """Ids of any text, as encode_ordinary() gives them; long texts go piece by piece."""
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, single in safe_pieces(text):
        ids += enc._encode_single_piece(piece) if single else enc.encode_ordinary(piece)
    return ids


def encode_documents(docs: DataFrame, ranks_file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every text's token ids (null: none). Rows keep their number and may repeat."""

    def run(batches):
        enc = encoding(ranks_file)
        for batch in batches:
            ids = [encode(enc, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, n_tokens, bytes binary: the raw bytes that the ids of each row stand for (they need not be valid UTF-8)."""

    def run(batches):
        enc = encoding(ranks_file)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r or []) for r in rows], pa.int64()), pa.array([enc.decode_bytes(r or []) for r in rows], pa.binary())], names=["doc_id", "n_tokens", "bytes"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, bytes binary")


def round_trip_digests(docs: DataFrame, ranks_file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass over the texts.

    Null and empty texts have no tokens. Ids stay in the worker: only digests leave it, a row at a time.
    """

    def run(batches):
        enc = encoding(ranks_file)
        names = [str(i) for i in range(enc.n_vocab)]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(1):
                ids = encode(enc, value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(sha(" ".join([names[i] for i in ids]).encode()))
                of_bytes.append(sha(enc.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
