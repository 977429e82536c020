"""Texts cut where byte-level BPE cannot merge across, so that each distinct unit is encoded once."""

from __future__ import annotations

import os

import numpy as np

from .common import Block, ragged, spans_to_strings

_ENDS_UNIT = np.zeros(256, dtype=bool)
_ENDS_UNIT[[0x20, 0x0A]] = True
_SOLID = np.ones(256, dtype=bool)
_SOLID[: 0x21] = False
_SOLID[0x7F] = False
ENCODE_AT_ONCE = 16384
KEPT_UNITS = 1 << 20
_CODERS: dict = {}


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each unit; together they cover the texts.

    A unit begins at a text's start, or at a single space or line feed between
    two other characters. The pattern of byte-level BPE never lets a token reach
    over such a place. Where both neighbours are non-ASCII either may be white
    space of its own kind, so those places are left uncut.
    """
    d, n = block.data, block.size
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        cut[1:-1] = _ENDS_UNIT[d[1 : n - 1]] & _SOLID[d[: n - 2]] & _SOLID[d[2:n]] & ((d[: n - 2] & d[2:n]) < 0x80)
    first, last = block.off[:-1], block.off[1:] - 1
    filled = last >= first
    cut[last[filled]] = False
    cut[first[filled]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends[: len(starts)], np.searchsorted(block.off, starts, side="right") - 1


class UnitCoder:
    """Token ids of distinct units, kept by hash for as long as the worker lives (a bounded number of them)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def at(cls, path: str) -> UnitCoder:
        if path not in _CODERS:
            _CODERS[path] = cls(path)
        return _CODERS[path]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each unit of the block its text number and its place in ``counts`` and ``starts``."""
        starts, ends, doc = units(block)
        distinct, first, inverse = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KEPT_UNITS:
            self._forget()
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        self._learn(block, distinct[~known], starts[first[~known]], ends[first[~known]])
        return doc, np.searchsorted(self.hashes, distinct)[inverse]

    def _learn(self, block: Block, hashes, starts, ends):
        if not len(hashes):
            return
        texts = spans_to_strings(block.data, starts, ends).to_pylist()
        got, counts = [], []
        for i in range(0, len(texts), ENCODE_AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + ENCODE_AT_ONCE], add_special_tokens=False):
                ids = e.ids
                counts.append(len(ids))
                got.extend(ids)
        counts = np.array(counts, np.int64)
        begin = len(self.ids) + np.cumsum(counts) - counts
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.starts = np.concatenate([self.starts, begin])[order]
        self.ids = np.concatenate([self.ids, np.array(got, np.uint32)])

    def ids_of(self, places: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.starts[places], self.counts[places])[0]]
