"""The two measures of string pairs that Spark has no function for, and the scores built on them.

Scores run from 0 to 100. ``ratio`` is 100 * (1 - d / (m + n)) with d the number
of insertions and deletions between the strings, which is m + n - 2 * LCS. LCS
lengths of a batch, and of all windows of the longer strings, come from
bit-parallel passes in numpy; word forms and the rest are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of the combined score.
TOKEN_SCALE = 0.95
PARTIAL_SCALE = 0.9
FAR_PARTIAL_SCALE = 0.6
PARTIAL_FROM = 1.5
FAR_FROM = 8.0
SCORERS = ("ratio", "partial", "token_sort", "token_set", "weighted_ratio", "quick_ratio")
_CHUNK = 4096
_CELLS = 1 << 19


def _lcs_long(a: str, b: str) -> int:
    """LCS length with Python integers as bit vectors, for any length."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _codes(strings: list[str]) -> np.ndarray:
    """Code points of each string in one row, padded with zeros."""
    width = max(1, max(map(len, strings), default=1))
    return np.array(strings, dtype=f"U{width}").view(np.uint32).reshape(len(strings), width)


def _lcs_chunk(short: list[str], long: list[str]) -> np.ndarray:
    sizes = np.array([len(s) for s in short], dtype=np.uint64)
    a, b = _codes(short), _codes(long)
    alphabet = np.unique(np.concatenate([a.ravel(), b.ravel(), np.zeros(1, dtype=np.uint32)]))
    a, b = np.searchsorted(alphabet, a), np.searchsorted(alphabet, b)
    pad = 0  # the zero code sorts first
    rows = np.arange(len(short))
    masks = np.zeros((len(short), len(alphabet)), dtype=np.uint64)
    for i in range(a.shape[1]):
        masks[rows, a[:, i]] |= np.uint64(1 << i)
    masks[:, pad] = 0
    state = np.full(len(short), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(b.shape[1]):
        hit = state & masks[rows, b[:, j]]
        state = (state + hit) | (state - hit)
    used = np.where(sizes >= 64, np.iinfo(np.uint64).max, (np.uint64(1) << (sizes % np.uint64(64))) - np.uint64(1))
    return np.bitwise_count(~state & used.astype(np.uint64)).astype(np.int64)


def lcs(a: list[str], b: list[str]) -> np.ndarray:
    """LCS length of each pair."""
    out = np.zeros(len(a), dtype=np.int64)
    order = []
    for i, (x, y) in enumerate(zip(a, b)):
        if min(len(x), len(y)) > 64 or "\0" in x or "\0" in y:
            out[i] = _lcs_long(x, y)
        elif x and y:
            order.append(i)
    # Pairs of similar length share a chunk, so that little padding is scanned.
    order.sort(key=lambda i: max(len(a[i]), len(b[i])))
    for start in range(0, len(order), _CHUNK):
        part = order[start : start + _CHUNK]
        short = [a[i] if len(a[i]) <= len(b[i]) else b[i] for i in part]
        long = [b[i] if len(a[i]) <= len(b[i]) else a[i] for i in part]
        out[part] = _lcs_chunk(short, long)
    return out


def _window_chunk(short: np.ndarray, long: np.ndarray, sizes: np.ndarray, alphabet: int) -> np.ndarray:
    """Best ratio of each short string against the windows of its long one; short strings are of one length.

    One pass carries the states of all windows: step j feeds character j of every
    window, so nothing is listed or copied. ``long`` is padded with code 0, which no
    short string holds and which leaves a state as it is.
    """
    rows, m = short.shape
    words = -(-m // 64)
    masks = np.zeros((words, rows, alphabet), dtype=np.uint64)
    every = np.arange(rows)
    for i in range(m):
        masks[i // 64, every, short[:, i]] |= np.uint64(1 << (i % 64))
    masks[:, :, 0] = 0
    starts = long.shape[1] + m - 1
    padded = np.zeros((rows, starts + m - 1), dtype=long.dtype)
    padded[:, m - 1 : m - 1 + long.shape[1]] = long
    best = np.zeros(rows)
    step = max(1, _CELLS // (rows * words))
    for begin in range(0, starts, step):
        count = min(step, starts - begin)
        state = np.full((words, rows, count), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j in range(m):
            letters = padded[:, begin + j : begin + j + count]
            carry = None
            for w in range(words):
                old = state[w]
                hit = old & masks[w][every[:, None], letters]
                total = old + hit
                over = total < old
                if carry is not None:
                    total += carry
                    over |= total < carry
                state[w] = total | (old - hit)
                carry = over.astype(np.uint64)
        left = m % 64
        if left:
            state[-1] |= ~np.uint64((1 << left) - 1)
        common = np.bitwise_count(~state).sum(axis=0, dtype=np.int64)
        first = np.arange(begin, begin + count) - (m - 1)
        length = np.minimum(first + m, sizes[:, None]) - np.maximum(first, 0)
        score = np.where(length > 0, (1.0 - (m + length - 2.0 * common) / np.maximum(m + length, 1)) * 100.0, 0.0)
        best = np.maximum(best, score.max(axis=1))
    return best


def window_ratios(a: list[str], b: list[str], cutoff: float = 0.0) -> np.ndarray:
    """Best ratio of the shorter string against windows of its length in the longer one, also cut off at both ends.

    Strings of equal length are tried both ways. Two empty strings score 100, one
    empty string 0. Pairs that cannot reach ``cutoff`` score 0 without a look at the
    windows: no window has more in common with the short string than the whole long one.
    Memory is bounded: pairs and windows go by ``_CELLS`` at once.
    """
    out = np.zeros(len(a))
    sizes = np.array([min(len(x), len(y)) for x, y in zip(a, b)], dtype=np.float64)
    common = lcs(a, b)
    hopeful = (common > 0) & (200.0 * common / np.maximum(sizes + common, 1.0) >= cutoff - 1e-9)
    turns: dict[int, list[tuple[int, str, str]]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if not short:
            out[i] = 0.0 if long else 100.0
        elif short in long:
            out[i] = 100.0
        elif hopeful[i]:
            turns.setdefault(len(short), []).append((i, short, long))
            if len(short) == len(long):
                turns[len(short)].append((i, long, short))
    for m, part in turns.items():
        part.sort(key=lambda t: len(t[2]))
        at = 0
        while at < len(part):
            stop = at + 1
            while stop < len(part) and stop - at < _CHUNK and (stop - at + 1) * (len(part[stop][2]) + m) <= _CELLS:
                stop += 1
            some = part[at:stop]
            short, long = _codes([s for _, s, _ in some]), _codes([t for _, _, t in some])
            ends = np.array([len(t) for _, _, t in some])
            # Numbers of characters from 1; 0 is what lies outside of a string.
            alphabet = np.unique(np.concatenate([short.ravel(), long.ravel()]))
            inside = np.arange(long.shape[1]) < ends[:, None]
            long = np.where(inside, np.searchsorted(alphabet, long) + 1, 0)
            scores = _window_chunk(np.searchsorted(alphabet, short) + 1, long, ends, len(alphabet) + 1)
            np.maximum.at(out, np.array([i for i, _, _ in some]), scores)
            at = stop
    return out


def _known(a: pd.Series, b: pd.Series, measure, kind) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.zeros(len(a), dtype=kind)
    if known.any():
        out[known] = measure(a[known].tolist(), b[known].tolist())
    return pd.Series(out).where(known)


def common_letters(a: Column, b: Column) -> Column:
    """LCS length of two strings; null where one is null, at no cost."""

    @F.pandas_udf(T.DoubleType())
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return _known(a, b, lcs, np.float64)

    return measure(a, b)


def best_window(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    """``window_ratios`` of two strings; null where one is null, at no cost."""

    @F.pandas_udf(T.DoubleType())
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return _known(a, b, lambda x, y: window_ratios(x, y, cutoff), np.float64)

    return measure(a, b)


def ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    apart = (total - 2.0 * common_letters(a, b)) / F.when(total == 0, 1).otherwise(total)
    return F.when(total == 0, F.when(a.isNotNull() & b.isNotNull(), 100.0)).otherwise((1.0 - apart) * 100.0)


def quick_ratio(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(ratio(a, b))


def split_words(v: Column) -> Column:
    return F.filter(F.split(v, r"(?U)\s+"), lambda w: w != "")


#: Word forms of a value, made once per distinct value: sorted words, and different words sorted.
FORMS = ("sorted", "unique")


def forms(v: Column) -> list[Column]:
    words = split_words(v)
    return [F.array_sort(words).alias("sorted"), F.array_sort(F.array_distinct(words)).alias("unique")]


def token_set(wl: Column, wr: Column, when: Column | None = None) -> Column:
    """Best of three ratios between the shared words and the two word sets, given as sorted arrays."""
    both = F.array_intersect(wl, wr)
    shared, some = F.size(both), (F.size(wl) > 0) & (F.size(wr) > 0)
    inside = (shared > 0) & ((shared == F.size(wl)) | (shared == F.size(wr)))
    open_ = some & ~inside if when is None else when & some & ~inside
    dl, dr = (F.when(open_, F.array_join(F.array_except(w, both), " ")) for w in (wl, wr))
    s = F.when(shared > 0, F.length(F.array_join(both, " "))).otherwise(0)
    gap = F.when(shared > 0, 1).otherwise(0)
    lx, ly = F.length(dl), F.length(dr)
    x, y = s + gap + lx, s + gap + ly
    apart = 100.0 - 100.0 * (lx + ly - 2 * common_letters(dl, dr)) / (x + y)
    parts = F.when(shared > 0, F.greatest(100.0 - 100.0 * (gap + lx) / (s + x), 100.0 - 100.0 * (gap + ly) / (s + y))).otherwise(0.0)
    return F.when(~some, 0.0).when(inside, 100.0).otherwise(F.greatest(apart, parts))


def score(scorer: str, cutoff: float, vl: Column, vr: Column, sl: Column, sr: Column, ul: Column, ur: Column) -> Column:
    """Score of two values with their word forms (see ``forms``); scores below ``cutoff`` need not be exact.

    Word forms are columns and every part is a column expression over LCS lengths.
    The combined score takes token scores for similar lengths, window scores otherwise.
    """
    joined = lambda w: F.array_join(w, " ")
    if scorer == "ratio":
        return ratio(vl, vr)
    if scorer == "quick_ratio":
        return quick_ratio(vl, vr)
    if scorer == "token_sort":
        return ratio(joined(sl), joined(sr))
    if scorer == "token_set":
        return token_set(ul, ur)
    if scorer == "partial":
        return best_window(vl, vr, cutoff)
    if scorer != "weighted_ratio":
        raise ValueError(f"unknown scorer {scorer!r}, use one of {SCORERS}")
    m, n = F.length(vl), F.length(vr)
    filled = (m > 0) & (n > 0)
    spread = F.greatest(m, n) / F.greatest(F.least(m, n), F.lit(1))
    near, far = filled & (spread < PARTIAL_FROM), filled & (spread >= PARTIAL_FROM)
    scale = F.when(spread <= FAR_FROM, PARTIAL_SCALE).otherwise(FAR_PARTIAL_SCALE)
    only = lambda test, c: F.when(test, c)
    whole = ratio(only(filled, vl), only(filled, vr))
    turned = ratio(only(near, joined(sl)), only(near, joined(sr)))
    tokens = F.greatest(turned, token_set(ul, ur, near)) * TOKEN_SCALE
    window = best_window(only(far, vl), only(far, vr), cutoff / PARTIAL_SCALE) * scale
    apart = far & (F.size(F.array_intersect(ul, ur)) == 0)
    least = cutoff / (TOKEN_SCALE * PARTIAL_SCALE)
    words = F.when(apart, F.greatest(best_window(only(apart, joined(sl)), only(apart, joined(sr)), least), best_window(only(apart, joined(ul)), only(apart, joined(ur)), least))).otherwise(100.0)
    return F.when(vl.isNull() | vr.isNull(), F.lit(None).cast("double")).when(~filled, 0.0).when(near, F.greatest(whole, tokens)).otherwise(F.greatest(whole, window, words * TOKEN_SCALE * scale))
