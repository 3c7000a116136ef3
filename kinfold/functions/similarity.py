"""Edit-style similarities. All are built on the longest common subsequence, counted bit-parallel for all pairs of a batch at once."""

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: Pairs that are counted together (places of windows, for the best window), and characters of the shorter text up to which they are.
LANES, LONGEST = 4096, 512
#: Characters of the longer text up to which pairs are padded to one length, and the most cells of a table of masks.
WIDEST, CELLS = 4096, 1 << 22


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: each bit of the state is a place in a that isn't matched yet."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        if hit := state & places.get(c, 0):
            state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """A row of numbers for each text, filled up with the number of different characters, which comes last; and lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    there = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
    there[codes] = True
    number = np.cumsum(there) - 1
    symbols = int(number[-1]) + 1
    rows = np.full((len(texts), int(lengths.max(initial=0))), symbols, dtype=np.int64)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = number[codes]
    return rows, lengths, symbols


def _masks(short: np.ndarray, symbols: int) -> np.ndarray:
    """words x (pairs * (symbols + 1)): the places of each symbol in each pair's text, as bits; none of the filling."""
    pairs, longest = short.shape
    found = np.zeros((max(1, -(-longest // 64)), pairs * (symbols + 1)), dtype=np.uint64)
    base = np.arange(pairs) * (symbols + 1)
    for i in range(longest):
        found[i // 64, base + short[:, i]] |= np.uint64(1 << i % 64)
    found[:, base + symbols] = 0
    return found


def _step(state: list[np.ndarray], masks: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The states after one more character each; additions carry from word to word."""
    out, carry = [], None
    for word, mask in zip(state, masks):
        hit = word & mask[at]
        total = word + hit
        over = total < word
        if carry is not None:
            total += carry
            over |= carry & (total == 0)
        out.append(total | (word ^ hit))
        carry = over
    return out


def _matched(state: list[np.ndarray]) -> np.ndarray:
    return sum(64 - np.bitwise_count(word).astype(np.int64) for word in state)


def _lengths(texts: Iterable[str]) -> np.ndarray:
    return np.array(list(map(len, texts)), dtype=np.int64)


def _batches(short: np.ndarray, long: np.ndarray, lanes: np.ndarray) -> list[np.ndarray]:
    """Places of the pairs, of such lengths, in parts of texts about as long, of about LANES lanes in all."""
    order = np.lexsort((long, -(-short // 64)))
    part = (np.cumsum(lanes[order]) - 1) // LANES
    return np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []


def _tables(pairs: list[tuple[str, str]], windows: bool):
    """Of each batch: places of its pairs (shorter text first), rows of numbers of the shorter texts and then of the longer ones, lengths, symbols, masks."""
    short, long = _lengths(p[0] for p in pairs), _lengths(p[1] for p in pairs)
    parts = _batches(short, long, long if windows else np.ones_like(long))
    while parts:
        part = parts.pop()
        n, words, at = len(part), -(-int(short[part].max()) // 64), part.tolist()
        if n == 1 or n * int(long[part].max()) <= CELLS:
            rows, lengths, symbols = _symbols([pairs[i][0] for i in at] + [pairs[i][1] for i in at])
            if n == 1 or n * (symbols + 1) * words <= CELLS:
                yield part, rows, lengths, symbols, _masks(rows[:n, : int(short[part].max())], symbols)
                continue
        parts += [part[: n // 2], part[n // 2 :]]  # very long texts, or many scripts


def _ordered(a: str, b: str) -> tuple[str, str]:
    return (a, b) if len(a) <= len(b) else (b, a)


def _each(a: Iterable[str], b: Iterable[str], of: Callable[[list[tuple[str, str]]], list]) -> np.ndarray:
    """of() of every pair; equal pairs are worked out once."""
    pairs = list(zip(a, b))
    known = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
    found = np.asarray(of(list(known)))
    return found[np.fromiter((known[p] for p in pairs), dtype=np.int64, count=len(pairs))] if pairs else found


def _lcs_of(pairs: list[tuple[str, str]]) -> np.ndarray:
    pairs = [p if len(p[0]) <= len(p[1]) else p[::-1] for p in pairs]
    out, few = np.zeros(len(pairs), dtype=np.int64), []
    for i, (short, long) in enumerate(pairs):
        if len(long) > WIDEST or len(short) > LONGEST:
            out[i] = lcs(short, long)
        elif short:
            few.append(i)
    few = np.array(few, dtype=np.int64)
    for part, rows, _, symbols, masks in _tables([pairs[i] for i in few.tolist()], False):
        n = len(part)
        long = rows[n:].T + np.arange(n) * (symbols + 1)
        state = [np.full(n, ~np.uint64(0)) for _ in masks]
        for at in long:
            state = _step(state, masks, at)
        out[few[part]] = _matched(state)
    return out


def lcs_lengths(a: Iterable[str], b: Iterable[str]) -> np.ndarray:
    """lcs() of every pair."""
    return _each(a, b, _lcs_of)


def _ratio_of(pairs: list[tuple[str, str]]) -> np.ndarray:
    both = _lengths(p[0] for p in pairs) + _lengths(p[1] for p in pairs)
    return np.where(both > 0, 2 * _lcs_of(pairs) / np.maximum(both, 1), 1.0)


def ratios(a: Iterable[str], b: Iterable[str]) -> np.ndarray:
    """Twice the common subsequence over both lengths; 1 if both are empty."""
    return _each(a, b, _ratio_of)


def _sorted(texts: Iterable[str]) -> list[str]:
    known: dict[str, str] = {}
    return [known[t] if t in known else known.setdefault(t, " ".join(sorted(t.split()))) for t in texts]


def token_sort_ratios(a: Iterable[str], b: Iterable[str]) -> np.ndarray:
    return ratios(_sorted(a), _sorted(b))


def _token_set_of(pairs: list[tuple[str, str]]) -> np.ndarray:
    out, least, of, rest = np.zeros(len(pairs)), [], [], []
    words: dict[str, set[str]] = {}
    for i, (a, b) in enumerate(pairs):
        one, two = (words[t] if t in words else words.setdefault(t, set(t.split())) for t in (a, b))
        if not one or not two:
            continue
        both = one & two
        if both and (len(both) == len(one) or len(both) == len(two)):
            out[i] = 1.0
            continue
        common = sorted(both)
        with_a, with_b = " ".join(common + sorted(one - both)), " ".join(common + sorted(two - both))
        base = len(" ".join(common))  # the common tokens begin the longer texts, so all of them are matched
        least.append(max(2 * base / (base + len(with_a)), 2 * base / (base + len(with_b))) if common else 0.0)
        of.append(i)
        rest.append((with_a, with_b))
    if of:
        out[of] = np.maximum(least, _ratio_of(rest))
    return out


def token_set_ratios(a: Iterable[str], b: Iterable[str]) -> np.ndarray:
    """Best ratio among the common tokens and the common tokens with either side's rest; 0 if a side is empty."""
    return _each(a, b, _token_set_of)


def _best_window(short: str, long: str) -> float:
    """Best ratio of short with any stretch of long of its length, or less at either end.

    A stretch whose last character isn't in short loses nothing if it moves on, so those are passed over.
    """
    m, n, letters, best = len(short), len(long), set(short), 0.0
    if short in long:
        return 1.0
    for end in range(1, n + m):
        start, stop = max(0, end - m), min(n, end)
        if end <= n and long[end - 1] not in letters or end > n and long[start] not in letters:
            continue
        if 2 * min(m, stop - start) / (m + stop - start) > best:
            best = max(best, 2 * lcs(short, long[start:stop]) / (m + stop - start))
    return best


def _best_windows(pairs: list[tuple[str, str]]) -> np.ndarray:
    """_best_window() of pairs (shorter text first, not empty): a lane for each place of the longer text where a stretch begins."""
    out, few = np.zeros(len(pairs)), []
    for i, (short, long) in enumerate(pairs):
        if short in long:
            out[i] = 1.0
        elif len(short) > LONGEST or len(long) > WIDEST:
            out[i] = _best_window(short, long)
        else:
            few.append(i)
    few = np.array(few, dtype=np.int64)
    for part, rows, lengths, symbols, masks in _tables([pairs[i] for i in few.tolist()], True):
        n = len(part)
        m, size = lengths[:n], lengths[n:]
        pair = np.repeat(np.arange(n), size)
        start = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        flat = np.concatenate([rows[n:], np.full((n, int(m.max())), symbols)], axis=1)
        width, flat = flat.shape[1], flat.ravel()
        base, place = pair * (symbols + 1), pair * width + start
        length = np.minimum(m[pair], size[pair] - start)
        first = np.flatnonzero(start == 0)
        state = [np.full(len(pair), ~np.uint64(0)) for _ in masks]
        best = np.zeros(n)
        for k in range(int(m.max())):
            moved = _step(state, masks, base + flat[place + k])
            state = [np.where(k < length, new, old) for new, old in zip(moved, state)]
            if k + 1 < m.max():  # a stretch from the beginning, shorter than the shorter text
                head = 2 * _matched([word[first] for word in state]) / (m + np.minimum(k + 1, length[first]))
                best = np.maximum(best, head)
        np.maximum.at(best, pair, 2 * _matched(state) / (m[pair] + length))
        out[few[part]] = best
    return out


def _partial_of(pairs: list[tuple[str, str]]) -> np.ndarray:
    out = np.array([float(a == b) for a, b in pairs])
    at = [i for i, (a, b) in enumerate(pairs) if a and b and a != b]
    out[at] = _best_windows([_ordered(*pairs[i]) for i in at])
    even = [i for i in at if len(pairs[i][0]) == len(pairs[i][1])]
    if even:
        out[even] = np.maximum(out[even], _best_windows([pairs[i][::-1] for i in even]))
    return out


def partial_ratios(a: Iterable[str], b: Iterable[str]) -> np.ndarray:
    """Best ratio of the shorter text with a stretch of the longer; 1 if both are empty, 0 if one is."""
    return _each(a, b, _partial_of)


def ratio(a: str, b: str) -> float:
    return float(ratios([a], [b])[0])


def token_sort_ratio(a: str, b: str) -> float:
    return float(token_sort_ratios([a], [b])[0])


def token_set_ratio(a: str, b: str) -> float:
    return float(token_set_ratios([a], [b])[0])


def partial_ratio(a: str, b: str) -> float:
    return float(partial_ratios([a], [b])[0])


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common subsequence lengths; null where a side is."""
    there = (a.notna() & b.notna()).to_numpy()
    out = pd.Series([None] * len(a), dtype="Int64")
    out[there] = lcs_lengths(a[there], b[there])
    return out


def _column(of: Callable[[Iterable[str], Iterable[str]], np.ndarray]):
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(of(a, b), dtype="float64")

    similarity.__name__ = of.__name__
    return F.pandas_udf(similarity, DoubleType())


#: Columns, each of a function of its own: those that a query doesn't ask for aren't made, the others are one trip to Python.
ratio_column, sort_column, set_column, partial_column = map(_column, (ratios, token_sort_ratios, token_set_ratios, partial_ratios))
