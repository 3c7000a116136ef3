"""Substring deduplication with prefix-partitioned suffix trees.

A window of WINDOW words is removed if the same words also start earlier. Of each window, the PREFIX words with the least
hash are its anchor, so equal windows have equal anchors at equal offsets, and only about an eighth of all places are
anchors. The work goes in four steps:

1. Places whose anchor prefix occurs nowhere else can't be under a deep internal node and are left out. Each ANCHORS places
   of a task send one row per prefix that they have more than once to the count; their other places are known to repeat.
2. What is left are anchored suffixes, each with the words of its windows, dealt by prefix. Within a batch, trees
   already find repeats, so a passage that a third of all documents share sends a few rows a batch.
3. A task takes as many prefixes as fit in memory, sorts their suffixes, and the longest common prefixes of neighbours
   are the internal nodes of the subtree; nodes deep enough, split by what stands to the left of the anchor, are the
   repeats. The suffixes of a prefix that very many batches have meet in SALTS parts first. What is left of the parts, and
   of a prefix with too many different suffixes, gets a longer prefix: its windows are dealt again by all their words.
4. Ranges of repeated windows meet their text again, by row, and the covered words go.

Texts move once: both joins read the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

WINDOW, PREFIX = 20, 6
#: Words that a task's trees hold at once, with those that windows share counted in each row.
HELD = 1 << 20
#: Anchors that are counted together before they leave a task, rows that lose their words together, and rows made longer together.
ANCHORS, PIECE, LONGER = 1 << 19, 1 << 10, 1 << 12
#: A prefix that more batches have is hot; so many of them, the most frequent, are split, by so many salts. Only tasks' sizes depend on it.
HOT, MOST_HOT, SALTS = 32, 1 << 16, 16
#: Words that a worker remembers; most words of a large table come once, so many more would cost memory and find little.
REMEMBERED = 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def forget(self) -> None:
        """To be called where numbers given out are no longer in use."""
        if len(self) > REMEMBERED:
            self.clear()


class Words(Numbers):
    """Numbers words as they come; hashes has their hashes by number."""

    def __init__(self):
        self._found: list[int] = []
        self._table = np.zeros(0, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self._found.append(xxhash.xxh64_intdigest(word))
        return super().__missing__(word)

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        if self._found:
            self._table, self._found = np.concatenate([self._table, np.array(self._found, dtype=np.uint64)]), []
        return self._table[numbers]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[4])
#: Powers of an odd number and of its inverse, as far as a text has needed them.
_POWERS = [np.ones(1, dtype=np.uint64)] * 2


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of a text, given as bytes; equal words have equal hashes."""
    if len(raw) >= len(_POWERS[0]):
        size = 1 << len(raw).bit_length()
        for i, factor in enumerate((int(_ODD[0]), pow(int(_ODD[0]), -1, 1 << 64))):
            powers = np.full(size, factor, dtype=np.uint64)
            powers[0] = 1
            _POWERS[i] = np.multiply.accumulate(powers)
    edges = np.flatnonzero(np.diff(_WHITE[raw], prepend=True, append=True))
    start, end = edges[::2], edges[1::2]
    upto = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _POWERS[0][: len(raw)], out=upto[1:])
    return _mix((upto[end] - upto[start]) * _POWERS[1][start])


def _bytes_of(value) -> np.ndarray:
    """A text's bytes; none for a null."""
    return np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.is_valid else np.zeros(0, dtype=np.uint8)


def _first_least(h: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` neighbours, the place of the first with the least leading bits."""
    if len(h) >= 1 << 24:
        return np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(len(h) - width + 1)
    low = np.uint64((1 << 24) - 1)
    least, reach = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if reach < width:
        least = np.minimum(least[: len(h) - width + 1], least[width - reach :])
    return (least & low).astype(np.int64)


def runs_of(codes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one anchor: first start, number of windows, the anchor's place and hash."""
    if len(codes) < window:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    grams = len(codes) - PREFIX + 1
    h = np.zeros(grams, dtype=np.uint64)
    for j in range(PREFIX):
        h += codes[j : j + grams] * _ODD[j]
    h = _mix(h)
    place = _first_least(h, window - PREFIX + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return first, np.diff(np.append(first, len(place))), place[first], h[place[first]]


def repeats(flat: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Suffix trees of anchored suffixes: which windows' words also start in a smaller document, or before in the same.

    Row r has n[r] windows from word `at[r]` of flat (word numbers) on; they are those from word start[r] of document
    doc[r] on, and their anchor is anchor[r] words further. The answer has the rows' windows end to end.
    """
    base = np.cumsum(n) - n
    flags = np.zeros(int(n.sum()), dtype=bool)
    if len(flags) < 2:
        return flags
    # the suffixes, from the anchor on, padded past what the row's windows need
    places = (at + anchor)[:, None] + np.arange(window)
    suffix = np.where(places < (at + n + window - 1)[:, None], flat[np.minimum(places, len(flat) - 1)], -1)
    packed = np.ascontiguousarray(((suffix[:, 0::2] << 32) | (suffix[:, 1::2] & 0xFFFFFFFF)).T) if window % 2 == 0 else suffix.T
    order = np.lexsort(packed[::-1])
    differ = suffix[order][1:] != suffix[order][:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    del suffix, packed, differ
    left, size = np.zeros(len(n), dtype=np.int64), int(flat.max()) + 2
    rank = np.empty(len(n), dtype=np.int64)
    rank[np.lexsort((start, doc))] = np.arange(len(n))
    for a in range(int(anchor.max()) + 1):
        if a:  # one word further to the left of the anchor
            word = np.where(anchor >= a, flat[np.maximum(at + anchor - a, 0)], -1)
            left = np.unique(left * size + word + 1, return_inverse=True)[1]
        has = np.flatnonzero((a <= anchor) & (a > anchor - n))
        if len(has) < 2:
            continue
        node = np.empty(len(n), dtype=np.int64)  # internal nodes of depth window - a, numbered along the suffix array
        node[order] = np.concatenate([[0], np.cumsum(common < window - a)])
        group = node[has] * (int(left.max()) + 1) + left[has]
        by = np.lexsort((rank[has], group))
        rows, groups = has[by], group[by]
        new = np.concatenate([[True], groups[1:] != groups[:-1]])
        if new.all():
            continue
        head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        place = start + anchor - a
        later = (doc[rows] != doc[head]) | (place[rows] != place[head])
        flags[base[rows[later]] + anchor[rows[later]] - a] = True
    return flags


def _documents(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers of documents in the order of doc, then key: rows with one id or none but other texts are other documents."""
    order = np.lexsort((key, doc))
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (np.diff(doc[order]) != 0) | (np.diff(key[order]) != 0)])[: len(doc)])
    return out


def _stretches(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches where rows stay the same and values go up by one."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1] + 1)]))
    return first, np.diff(np.append(first, len(rows)))


_ROWS = "kind int, route long, key long, doc long, start int, n int, anchor int, words string"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
_NAMES = ["kind", "route", "key", "doc", "start", "n", "anchor", "words"]
#: Kinds of rows: anchored suffixes still to compare, ranges of repeated windows, and suffixes of a hot prefix's part.
SUFFIX, RANGE, PART = 0, 1, 2


def _batch(kind, route, key, doc, start, n, anchor, words) -> pa.RecordBatch:
    arrays = [np.full(len(key), kind, dtype=np.int32) if isinstance(kind, int) else kind.astype(np.int32), route, key, doc, start.astype(np.int32), n.astype(np.int32), anchor.astype(np.int32)]
    last = pa.nulls(len(key), pa.string()) if words is None else pa.array(words, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), last], names=_NAMES)


def _ranges(flags, rows, starts, key, doc) -> pa.RecordBatch:
    """The marked windows as ranges; rows, starts: of each window, its row and start."""
    marked = np.flatnonzero(flags)
    first, n = _stretches(key[rows[marked]], starts[marked])
    row, start = rows[marked[first]], starts[marked[first]]
    route = _mix(key[row].astype(np.uint64) + start.astype(np.uint64)).view(np.int64)
    return _batch(RANGE, route, key[row], doc[row], start, n, np.zeros_like(n), None)


def _places(docs: DataFrame, window: int) -> tuple[DataFrame, np.ndarray]:
    """Step 1: (key, places) of the anchors whose prefix occurs more than once, and the hot prefixes, at most MOST_HOT."""

    def run(batches):
        keys, places, grams = [], [], []

        def flush():
            key, place, gram = map(np.concatenate, (keys, places, grams))
            for held in (keys, places, grams):
                held.clear()
            _, first, inverse, count = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
            known = count[inverse] > 1
            alone = _mix(key.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            route = np.where(known & (first[inverse] != np.arange(len(gram))), alone, gram)
            return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(key), pa.array(place), pa.array(known)], names=["route", "key", "place", "known"])

        size = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, place, gram = runs_of(word_hashes(_bytes_of(value)), window)
                if len(place):
                    keys.append(np.full(len(place), key, dtype=np.int64))
                    places.append(place.astype(np.int32))
                    grams.append(gram)
                    size += len(place)
                if size >= ANCHORS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    found = docs.select("key", "text").mapInArrow(run, "route long, key long, place int, known boolean").repartition("route")
    repeated = saved(found.withColumn("n", F.count("*").over(Window.partitionBy("route"))).where("known OR n > 1"), "repeated")
    hot = repeated.where(F.col("n") > HOT).groupBy("route").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "route").limit(MOST_HOT).collect()
    routes = np.sort(np.array([r["route"] for r in hot], dtype=np.int64).view(np.uint64))
    return repeated.groupBy("key").agg(F.collect_set("place").alias("places")), routes


def _suffixes(docs: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """Step 2: anchored suffixes that no other of the same batch repeats, and ranges of those that do."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        known_words = Numbers()
        held: list[tuple] = []

        def flush():
            texts, flats, sizes, ats, firsts, ns, anchors, grams, keys, docs_of = [], [], [], [], [], [], [], [], [], []
            base = 0
            for key, doc, joined, numbers, lengths, raw, places in held:
                first, n, place, gram = runs_of(word_hashes(raw), window)
                here = np.isin(place, places)
                first, n, place, gram = first[here], n[here], place[here], gram[here]
                texts.append(joined)
                flats.append(numbers)
                sizes.append(lengths)
                ats.append(first + base)
                firsts.append(first)
                ns.append(n)
                anchors.append(place - first)
                grams.append(gram)
                keys.append(np.full(len(first), key, dtype=np.int64))
                docs_of.append(np.full(len(first), doc, dtype=np.int64))
                base += len(numbers)
            held.clear()
            flat, at, start, n, anchor, gram, key, doc = map(np.concatenate, (flats, ats, firsts, ns, anchors, grams, keys, docs_of))
            flags = repeats(flat, at, n, anchor, _documents(doc, key), start, window)
            rows = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            yield _ranges(flags, rows, start[rows] + inner, key, doc)
            rest = np.flatnonzero(~flags)
            first, m = _stretches(rows[rest], inner[rest])
            row, off = rows[rest[first]], inner[rest[first]]
            blob = b" ".join(texts)
            ends = np.cumsum(np.concatenate(sizes) + 1)
            begin, end = np.where(at[row] + off > 0, ends[at[row] + off - 1], 0), ends[at[row] + off + m + window - 2] - 1
            # parts of a hot prefix differ in the last bits of their route, which only say who meets whom
            is_hot = np.isin(gram, shared.value)
            salt = (_mix(key.astype(np.uint64)) % np.uint64(SALTS))[is_hot]
            gram[is_hot] = gram[is_hot] & ~np.uint64(SALTS - 1) | salt
            for i in range(0, len(row), LONGER):
                r, o, part = (x[i : i + LONGER] for x in (row, off, m))
                words = [blob[b:e] for b, e in zip(begin[i : i + LONGER].tolist(), end[i : i + LONGER].tolist())]
                yield _batch(np.where(is_hot[r], PART, SUFFIX), gram[r].view(np.int64), key[r], doc[r], start[r] + o, part, anchor[r] - o, words)

        size = 0
        for batch in batches:
            for key, doc, value, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = _bytes_of(value)
                words = raw.tobytes().split()
                lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                held.append((key, doc, b" ".join(words), known_words.numbers(words), lengths, raw, places.values.to_numpy()))
                size += len(words)
                if size >= HELD:
                    yield from flush()
                    known_words.forget()
                    size = 0
        if held:
            yield from flush()

    return docs.select("key", "doc", "text", "places", "row").mapInArrow(run, _ROWS)  # row: the same columns as the last join, so that the exchange is shared


class _Held:
    """Suffix rows that a task has read and not yet compared."""

    def __init__(self, window: int):
        self.window, self.numbers, self.words = window, np.zeros((7, 0), dtype=np.int64), []

    def add(self, rows: pa.RecordBatch) -> None:
        columns = [rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (*range(1, 7), 0)]
        self.numbers = np.concatenate([self.numbers, np.stack(columns)], axis=1)
        self.words += rows.column(7).cast(pa.binary()).to_pylist()

    def size(self) -> int:
        """Words of all rows: a row of one window has as many as a window."""
        return int(self.numbers[4].sum()) + (self.window - 1) * self.numbers.shape[1]

    def split(self, route: int) -> "_Held":
        """Takes out all rows but those of a route, which is the last."""
        at = int(np.searchsorted(self.numbers[0], route))
        out = _Held(self.window)
        out.numbers, self.numbers = self.numbers[:, :at], self.numbers[:, at:]
        out.words, self.words = self.words[:at], self.words[at:]
        return out

    def settle(self) -> tuple[pa.RecordBatch, "_Held"]:
        """Ranges of the windows that repeat, and rows of the others."""
        route, key, doc, start, n, anchor, kind = self.numbers
        lengths = n + self.window - 1
        # words are objects one row at a time: all at once they would take ten times the memory of their texts
        flat = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(w.split(b" ") for w in self.words)), dtype=np.int64, count=int(lengths.sum()))
        flags = repeats(flat, np.cumsum(lengths) - lengths, n, anchor, _documents(doc, key), start, self.window)
        rows = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        rest = _Held(self.window)
        left = np.flatnonzero(~flags)
        first, m = _stretches(rows[left], inner[left])
        row, off = rows[left[first]], inner[left[first]]
        rest.numbers = np.stack([route[row], key[row], doc[row], start[row] + off, m, anchor[row] - off, kind[row]])
        rest.words = [self.words[r] if whole else b" ".join(self.words[r].split(b" ")[o : o + k]) for r, o, k, whole in zip(row.tolist(), off.tolist(), (m + self.window - 1).tolist(), (m == n[row]).tolist())]
        return _ranges(flags, rows, start[rows] + inner, key, doc), rest

    def parts(self) -> Iterator[pa.RecordBatch]:
        """What is left of hot prefixes' parts, made longer: no part can know how crowded the others are."""
        at = np.flatnonzero(self.numbers[6] == PART)
        out = _Held(self.window)
        out.numbers, out.words = self.numbers[:, at], [self.words[i] for i in at.tolist()]
        return out.longer()

    def longer(self) -> Iterator[pa.RecordBatch]:
        """Each window as a row of its own, dealt by all its words: the prefix made as long as the window."""
        import xxhash

        for at in range(0, len(self.words), LONGER):
            _, key, doc, start, n, _, _ = self.numbers[:, at : at + LONGER]
            rows = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            words = [b" ".join(split[i : i + self.window]) for split, k in zip((w.split(b" ") for w in self.words[at : at + LONGER]), n.tolist()) for i in range(k)]
            route = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)
            yield _batch(SUFFIX, route, key[rows], doc[rows], start[rows] + inner, np.ones(len(rows)), np.zeros(len(rows)), words)


def _grown(rows: DataFrame, window: int, most: int) -> DataFrame:
    """Step 3: ranges of the suffixes that repeat, prefix by prefix; suffixes of crowded prefixes, with longer ones, and of parts."""

    def run(batches):
        held, crowded = _Held(window), None
        for batch in batches:
            ranges = pc.equal(batch.column(0), RANGE)
            yield batch.filter(ranges)
            batch = batch.filter(pc.invert(ranges))
            if crowded is not None and batch.num_rows:
                same = pc.equal(batch.column(1), crowded)
                part = _Held(window)
                part.add(batch.filter(same))
                yield from part.longer()
                batch = batch.filter(pc.invert(same))
                crowded = None if batch.num_rows else crowded
            if batch.num_rows:
                held.add(batch)
            if held.size() >= most:
                last = int(held.numbers[0, -1])
                whole = held.split(last)
                if whole.words:
                    yield from settled(whole)
                if held.size() >= most:
                    single = not (held.numbers[4] > 1).any() and not held.numbers[5].any()
                    out, held = held.settle()
                    yield out
                    if 2 * held.size() > most and not single:
                        yield from held.longer()
                        held, crowded = _Held(window), last
        if held.words:
            yield from settled(held)

    def settled(held):
        out, rest = held.settle()
        yield out
        yield from rest.parts()

    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(run, _ROWS)


def _removed(joined: DataFrame, window: int, as_they_were: bool) -> DataFrame:
    """Step 4: every row with its words counted and the kept ones joined by one space."""

    def run(batches):
        for batch in chain.from_iterable((b.slice(at, PIECE) for at in range(0, b.num_rows, PIECE)) for b in batches):
            counts, gone, kept = [], [], []
            for value, ranges in zip(batch.column(1), batch.column(2).to_pylist()):
                words = (value.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, dtype=np.int32)
                for r in ranges or ():
                    cover[r["start"]] += 1
                    cover[min(len(words), r["start"] + r["n"] + window - 1)] -= 1
                left = [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist()) if not c] if ranges else words
                counts.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(value.as_py() if as_they_were and len(left) == len(words) else b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, held: int = HELD, id: str = "doc_id", text: str = "text", as_they_were: bool = False) -> DataFrame:
    """row (docs' other columns and the id, as a struct), n_words, n_removed, kept_text for every row.

    Words covered by a window whose words also start in a row with a smaller id (null is the smallest), or before in the
    same row, are removed. Rows with one id (or none) come in the order of a hash of their texts. Rows with one id and one
    text are one document, so repeated rows lose the same words. Null texts have no words; an empty table gives an empty
    result. A row is known by its id if no other has it, so no two are mixed up; in tables where ids are missing or
    repeat, by a 64-bit hash of id and text.
    """
    columns = [c for c in docs.columns if c != text]
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(F.col(id).cast("long").alias("doc")).groupBy("doc").agg(F.count("*").alias("n"))
    unique = ids.where("n > 1 OR doc IS NULL").isEmpty()
    key = (order if unique else F.xxhash64(order, value)).alias("key")
    keyed = docs.select(key, order.alias("doc"), value.alias("text"), F.struct(*columns).alias("row")).repartition("key")
    places, hot = _places(docs.select(key, value.alias("text")), window)
    suffixes = _suffixes(keyed.join(places.hint("shuffle_hash"), "key"), window, hot)
    found = _grown(_grown(suffixes, window, held), window, held).where(F.col("kind") == RANGE)
    ranges = found.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    return _removed(keyed.join(ranges.hint("shuffle_hash"), "key", "left").select("row", "text", "ranges", "key", "doc"), window, as_they_were)


def without_repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the kept words as text, joined by one space; texts that lose nothing, and other columns, as they were."""
    out = remove_repeats(docs, window, HELD, id, text, as_they_were=True)
    return out.select(*[F.col("kept_text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """Query 3: remove_repeats() of all documents, with a digest of the kept words."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER s AS words, count(*) OVER s AS n FROM p
      WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
f AS (SELECT doc_id, i, word, n = {WINDOW} AND row_number() OVER (PARTITION BY words, n ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
