"""Encoding of many distinct units in few calls: units are joined where no token can reach over, and told apart by token widths."""

from __future__ import annotations

import os
import sys
import types

import numpy as np

from .common import Block, ragged
from .units import UnitCoder

JOIN_BYTES = 2048
AT_ONCE = 256


def worker_cache() -> dict:
    """What is kept as long as the Python worker lives.

    Functions of this package travel by value, so their module's own names begin
    anew in each task; a module registered under a name of its own does not.
    """
    return vars(sys.modules.setdefault("_ledgerloom_worker", types.ModuleType("_ledgerloom_worker"))).setdefault("cache", {})


def joinable(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Units that may stand behind and before any other such unit.

    They begin with one space or line feed and then a character that is not white
    space, and end with such a character: ASCII above the space, or of two bytes
    with a lead of 0xC3 to 0xDF, a range that holds no white space.
    """
    d, long = block.data, ends - starts >= 2
    s, e = starts, np.maximum(ends, 2)
    head = np.isin(d[s], (0x20, 0x0A)) & (((d[s + 1] > 0x20) & (d[s + 1] < 0x7F)) | ((d[s + 1] >= 0xC3) & (d[s + 1] <= 0xDF)))
    last, before = d[e - 1], d[e - 2]
    tail = ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (before >= 0xC3) & (before <= 0xDF))
    return long & head & tail


def encode_spans(block: Block, starts: np.ndarray, ends: np.ndarray, encode, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each span, and all ids one after another in the order of the spans.

    ``encode`` takes texts and gives a list of ids for each; ``widths`` holds the
    bytes of every id. Joined spans whose ends are not all ends of tokens are
    encoded one by one instead.
    """
    fits = joinable(block, starts, ends)
    order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
    n_fit = int(fits.sum())
    s, e = starts[order], ends[order]
    flat, off = ragged(s, e - s)
    raw = block.data[flat].tobytes()
    cuts, at = [0], 0
    while at < n_fit:
        at = min(n_fit, max(at + 1, int(np.searchsorted(off, off[at] + JOIN_BYTES, side="right")) - 1))
        cuts.append(at)
    cuts.extend(range(n_fit + 1, len(order) + 1))
    counts, parts = np.zeros(len(order), np.int64), []
    for i in range(0, len(cuts) - 1, AT_ONCE):
        bounds = cuts[i : i + AT_ONCE + 1]
        texts = [raw[off[a] : off[b]].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        for a, b, ids in zip(bounds, bounds[1:], encode(texts)):
            ids = np.array(ids, np.uint32)
            if b - a > 1:
                ends_of = np.cumsum(widths[ids])
                inner = np.searchsorted(ends_of, off[a + 1 : b + 1] - off[a], side="right")
                if np.array_equal(ends_of[inner - 1], off[a + 1 : b + 1] - off[a]):
                    counts[a:b] = np.diff(inner, prepend=0)
                    parts.append(ids)
                    continue
                single = [np.array(x, np.uint32) for x in encode([raw[off[j] : off[j + 1]].decode("utf-8", "replace") for j in range(a, b)])]
                counts[a:b] = [len(x) for x in single]
                parts.extend(single)
            else:
                counts[a] = len(ids)
                parts.append(ids)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    begins = np.cumsum(counts) - counts
    back = np.argsort(order, kind="stable")
    return counts[back], ids[ragged(begins[back], counts[back])[0]]


class JoinedCoder(UnitCoder):
    """A unit coder that learns new units many at a time."""

    def __init__(self, path: str):
        super().__init__(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.widths[i] = len(name)  # a character of a byte-level name stands for one byte

    @classmethod
    def at(cls, path: str) -> JoinedCoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache()
        if ("joined", path) not in cache:
            cache["joined", path] = cls(path)
        return cache["joined", path]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, block: Block, hashes, starts, ends):
        if not len(hashes):
            return
        counts, ids = encode_spans(block, starts, ends, self._encode, self.widths)
        begin = len(self.ids) + np.cumsum(counts) - counts
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.starts = np.concatenate([self.starts, begin])[order]
        self.ids = np.concatenate([self.ids, ids])
