"""Packing token sequences by first-fit decreasing with a tournament tree, in randomised groups of documents."""


import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode, encoding
from .common import saved, table

#: Documents in a group, on average. Groups are packed apart from each other, so this bounds a task's memory.
GROUP = 8192
#: Characters on which the two libraries' classes of letters, numbers and white space agree (tests compare them all);
#: texts with others take the tokenizers library itself.
_OTHER = re.compile("[^\x00-\u024f\u2000-\u206f]")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def added_strings(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer file takes out of a text before its byte pairs, such as those of special tokens."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def token_ids(text: str, tokenizer_file: str, ranks_file: str | None) -> list[int]:
    """Ids of the tokenizers library. With a rank file of the same vocabulary, the faster library where both agree."""
    if ranks_file and not _OTHER.search(text) and not any(s in text for s in added_strings(tokenizer_file)):
        return encode(encoding(ranks_file), text)
    return tokenizer(tokenizer_file).encode(text, add_special_tokens=False).ids


def cut_documents(docs: DataFrame, size: int, tokenizer_file: str, ranks_file: str | None = None, end: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises every row and cuts its ids (with `end` after them) into pieces of `size` and a rest; see PIECES.

    Null and empty texts have the end id alone. lot: a number drawn from id and place, which deals rows to groups, so
    repeated rows with one id don't gather in one group.
    """

    def run(batches):
        import xxhash

        for batch in batches:
            out: list[tuple] = []
            for i, (doc, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                ids = np.array([*token_ids(value.as_py() or "", tokenizer_file, ranks_file), end], dtype="<u4")
                lot = xxhash.xxh64_intdigest(f"{doc}:{i}", 7) >> 1
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), lot))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


class Bins:
    """Free room of bins in a tournament tree: the first bin with room for an item is found from the root down."""

    def __init__(self, size: int, most: int):
        self.size, self.leaves = size, 1 << max(0, (most - 1).bit_length())
        self.free = [size] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset there)."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        offset, found = self.size - free[at], at - self.leaves
        free[at] -= length
        while at > 1:
            at //= 2
            best = free[2 * at] if free[2 * at] > free[2 * at + 1] else free[2 * at + 1]
            if free[at] == best:
                break
            free[at] = best
        return found, offset


def first_fit_decreasing(lengths, size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length (1 to size): the longest first, each in the first bin with room."""
    order = np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable").tolist()
    bins, where, offsets = Bins(size, max(1, len(order))), [0] * len(order), [0] * len(order)
    for i in order:
        where[i], offsets[i] = bins.put(int(lengths[i]))
    return where, offsets


def pack(pieces: DataFrame, size: int, group: int = GROUP) -> DataFrame:
    """pieces (see PIECES) plus sequence_id and offset. pieces should be written: it is counted first, then read again.

    Groups hold about `group` documents drawn at random and are packed independently, so tasks stay the same size as
    the input grows. Sequence ids are unique, not dense. An empty input gives an empty result.
    """
    documents = pieces.where("start = 0").count()
    groups = max(1, -(-documents // group))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lot", "doc_id", "start"], kind="stable", ignore_index=True)
        where, offsets = first_fit_decreasing(rows["length"].to_numpy(), size)
        rows["sequence_id"] = (int(key[0]) << 32) + np.array(where, dtype=np.int64)
        rows["offset"] = np.array(offsets, dtype=np.int64)
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = pieces.withColumn("part", F.col("lot") % groups)
    return dealt.groupBy("part").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer_file: str | None = None, ranks_file: str | None = None, end: int = 1) -> DataFrame:
    """Every row of docs in pieces packed into sequences of at most `size` ids: one row per piece.

    doc_id, start (ids of the row before the piece), length, ids_crc32, doc_tokens, sequence_id, offset. Rows with a
    null id are packed like any other, repeated rows each. Strings of special tokens become those tokens, as the
    tokenizers library does with a file as loaded. An empty table gives an empty result; other columns are not read.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file, ranks_file = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(saved(cut_documents(docs, size, tokenizer_file, ranks_file, end), "pieces"), size)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Query 5: pack_documents() of all documents into sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
