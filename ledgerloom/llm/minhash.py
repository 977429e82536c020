"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import Block, mix, ragged

BINS, ROWS = 128, 5
BANDS = BINS // ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one text after another, and each text's offset in them.

    A shingle is ``size`` words; a text of fewer words is one shingle of them all.
    """
    starts, ends, doc = block.words()
    words = block.hashes(starts, ends)
    count = np.bincount(doc, minlength=block.n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at, off = ragged(first, n)
    length = np.repeat(np.minimum(count, size), n)
    h = mix(length.astype(np.uint64) * _MULTIPLIER)
    for j in range(size):
        inside = length > j
        if inside.all():
            h = mix((h ^ words[at + j]) * _MULTIPLIER + np.uint64(j))
        elif inside.any():
            h[inside] = mix((h[inside] ^ words[at[inside] + j]) * _MULTIPLIER + np.uint64(j))
    out, sizes = [], np.zeros(block.n, np.int64)
    for i in range(block.n):
        if n[i]:
            own = np.sort(h[off[i] : off[i + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            out.append(own)
            sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketch(members: np.ndarray, off: np.ndarray, bins: int = BINS, seed: int = 7) -> np.ndarray:
    """A sketch of ``bins`` coordinates for each set; two sets agree in each with the probability of their similarity.

    In each of the first ``bins`` rounds every member falls into a hashed bin with
    a hashed value, and values of an earlier round are smaller than those of a
    later one. A set is done once all of its bins are filled, mostly after a few
    rounds; what then still is empty is filled by ``bins`` more rounds, in each
    of which all members fall into that round's bin.
    """
    sets = len(off) - 1
    out = np.full(sets * bins, _EMPTY)
    left = np.flatnonzero(np.diff(off) > 0)
    at, own = ragged(off[left], np.diff(off)[left])
    values, base = members[at], np.repeat(left, np.diff(own)) * bins
    for turn in range(2 * bins):
        if not len(left):
            break
        x = mix(values ^ mix(np.array([turn * 2654435761 + seed], np.uint64)))
        place = (x % np.uint64(bins)).astype(np.int64) if turn < bins else np.full(len(x), turn - bins)
        np.minimum.at(out, base + place, (np.uint64(turn) << np.uint64(56)) | (x >> np.uint64(8)))
        open_ = (out.reshape(sets, bins)[left] == _EMPTY).any(axis=1)
        if not open_.all():
            keep = np.repeat(open_, np.diff(off)[left])
            values, base, left = values[keep], base[keep], left[open_]
    return out.reshape(sets, bins)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of ``rows`` coordinates."""
    count = sketches.shape[1] // rows
    key = np.tile(mix(np.arange(1, count + 1, dtype=np.uint64)), (len(sketches), 1))
    for j in range(rows):
        key = mix((key ^ sketches[:, j : count * rows : rows]) * _MULTIPLIER)
    return key.view(np.int64)


def digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()
