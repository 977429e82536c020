"""Alignment of two tokenizers' tokens: divide and conquer at the byte offsets where tokens of both end."""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, ragged, settle, small_batches
from .joined import encode_spans, worker_cache

SPACE = "▁"
KEPT_UNITS = 1 << 19
_SOLID = np.ones(256, dtype=bool)
_SOLID[:0x21] = False
_SOLID[0x7F] = False


def cut_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Numbers of tokens (of a, of b) up to the end of each group; the last ends of both must be the same.

    An interval is divided at a common end near its middle: from the middle token of
    ``a`` outwards each end is looked up among those of ``b`` by bisection. Both
    halves are divided on; an interval without a common end inside is a group.
    """
    out, stack = [], [(0, len(ends_a), 0, len(ends_b))] if ends_a else []
    while stack:
        a0, a1, b0, b1 = stack.pop()
        cut = None
        if a1 - a0 > 1 and b1 - b0 > 1:
            middle = (a0 + a1 - 2) // 2
            for away in range(max(middle - a0, a1 - 2 - middle) + 1):
                for i in (middle - away, middle + away) if away else (middle,):
                    if a0 <= i < a1 - 1:
                        j = bisect_left(ends_b, ends_a[i], b0, b1 - 1)
                        if j < b1 - 1 and ends_b[j] == ends_a[i]:
                            cut = (i + 1, j + 1)
                            break
                if cut:
                    break
        if cut is None:
            out.append((a1, b1))
        else:
            stack += [(cut[0], a1, cut[1], b1), (a0, cut[0], b0, cut[1])]
    return out


def space_units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each unit of texts that begin with the added space.

    A unit begins at its text, or at a single space between two other characters of
    which one at least is ASCII. There a byte-level token ends before the space, and
    so does a piece, as no piece holds a space sign behind another character. So
    every unit's end is an end of tokens of both, and units are encoded alone.
    """
    d, n = block.data, block.size
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        cut[1:-1] = (d[1 : n - 1] == 0x20) & _SOLID[d[: n - 2]] & _SOLID[d[2:n]] & ((d[: n - 2] & d[2:n]) < 0x80)
    first, last = block.off[:-1], block.off[1:] - 1
    filled = last >= first
    cut[last[filled]] = False
    cut[first[filled]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(block.off, starts, side="right") - 1


class Aligner:
    """Both tokenizers, the id pairs that can be linked, and the distinct units met so far (a bounded number of them)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: bytes([i]) for i, c in _byte_letters(pre_tokenizers)}
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a: list = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = b"".join(letters.get(c, c.encode()) for c in name)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} reaches over a space, so texts can't be cut there")
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Tokens that end together: the bytes of one are the end of the other's. So their number is at most the bytes of
        # both vocabularies (times ids of the same bytes), whatever the texts.
        by_a, by_b = {}, {}
        for by, table in ((by_a, self.bytes_a), (by_b, self.bytes_b)):
            for i, raw in enumerate(table):
                by.setdefault(raw, []).append(i)
        keys = {(a << 32) | b for b, raw in enumerate(self.bytes_b) for k in range(len(raw)) for a in by_a.get(raw[k:], ())}
        keys |= {(a << 32) | b for a, raw in enumerate(self.bytes_a) for k in range(len(raw)) for b in by_b.get(raw[k:], ())}
        self.pairs = np.array(sorted(keys), np.int64)
        self._forget()

    @classmethod
    def at(cls, path_a: str, path_b: str) -> Aligner:
        cache, key = worker_cache(), ("aligner", path_a, path_b)
        if key not in cache:
            cache[key] = cls(path_a, path_b)
        return cache[key]

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        self.at_row = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begins, self.links = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.written: list[str | None] = []

    def place(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each unit in the tables of units; new ones are encoded and aligned."""
        distinct, first, inverse = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KEPT_UNITS:
            self._forget()
        found = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[found] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        if not known.all():
            self._learn(block, distinct[~known], starts[first[~known]], ends[first[~known]])
        return self.at_row[np.searchsorted(self.hashes, distinct)][inverse]

    def _learn(self, block: Block, hashes, starts, ends):
        n_a, ids_a = encode_spans(block, starts, ends, lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.width_a)
        n_b, ids_b = encode_spans(block, starts, ends, lambda texts: self.b.encode([t[1:] for t in texts], num_threads=1), self.width_b)
        off_a, off_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        end_a, end_b = np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b])
        list_a, list_b = ids_a.tolist(), ids_b.tolist()
        raw, n_links, linked = block.data.tobytes(), np.zeros(len(starts), np.int64), []
        text_a, text_b = list(map(str, list_a)), list(map(str, list_b))
        for u, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            a0, a1, b0, b1 = int(off_a[u]), int(off_a[u + 1]), int(off_b[u]), int(off_b[u + 1])
            unit = raw[start:end]
            if b"".join([self.bytes_b[i] for i in list_b[b0:b1]]) != unit or b"".join([self.bytes_a[i] for i in list_a[a0:a1]]) != unit:
                self.written.append(None)
                continue
            base_a, base_b = (int(end_a[a0 - 1]) if a0 else 0), (int(end_b[b0 - 1]) if b0 else 0)
            groups = [(1, b1 - b0)] if a1 - a0 == 1 else [(a1 - a0, 1)] if b1 - b0 == 1 else cut_groups((end_a[a0:a1] - base_a).tolist(), (end_b[b0:b1] - base_b).tolist())
            parts, i, j = [], a0, b0
            for to_a, to_b in groups:
                to_a, to_b = a0 + to_a, b0 + to_b
                parts.append(f"{','.join(text_a[i:to_a])}|{','.join(text_b[j:to_b])}")
                linked.append((list_a[to_a - 1] << 32) | list_b[to_b - 1])
                i, j = to_a, to_b
            n_links[u] = len(groups)
            self.written.append(";".join(parts))
        codes = np.searchsorted(self.pairs, np.array(linked, np.int64)).astype(np.uint32)
        row = len(self.n_a) + np.arange(len(hashes))
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.at_row = np.concatenate([self.at_row, row])[order]
        self.begins = np.concatenate([self.begins, len(self.links) + np.cumsum(n_links) - n_links])
        self.n_a, self.n_b, self.n_links = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b]), np.concatenate([self.n_links, n_links])
        self.links = np.concatenate([self.links, codes])


def _byte_letters(pre_tokenizers):
    """Byte and letter of the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [i for i in range(256) if i not in set(plain)]
    pairs = [(i, chr(i)) for i in plain] + [(i, chr(256 + k)) for k, i in enumerate(other)]
    assert sorted(c for _, c in pairs) == sorted(pre_tokenizers.ByteLevel.alphabet())
    return pairs


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pair long, n long"


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """Align the tokens of a byte-level tokenizer (of space + text) with a sentencepiece model's (which adds the space).

    Texts are cut at spaces that both tokenizers must end a token at; each distinct
    unit is encoded and divided into groups once per worker, by ``cut_groups``. Every
    task adds up its links by id pair; tokens that end together have bytes of which
    one ends the other, so the pairs are bounded by the two vocabularies, and their
    counts (half a million numbers here) go to every task. A document's links are
    written once in between, as pair numbers; texts are never shuffled.

    One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    count is the highest of their B id in all documents), count_sum (counts over its
    links), groups (``a1,a2|b1;a3|b2,b3``; its SHA-256 if ``keep_groups`` is false,
    and then '' without tokens). A text that is null, empty or not given back by the
    tokens of both (as one with U+2581) has no tokens and counts nowhere. Repeated
    rows count as often as they come; ids may be null; no rows give no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    schema = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (part.split() for part in _DOC.split(", "))])

    def first(batches):
        aligner = Aligner.at(path_a, path_b)
        total = np.zeros(len(aligner.pairs), np.int64)
        for table in blocks(batches):
            texts = pc.fill_null(table["text"].combine_chunks().cast(pa.large_string()), "")
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
            block = Block(texts)
            starts, ends, doc = space_units(block)
            rows = aligner.place(block, starts, ends)
            off = np.searchsorted(doc, np.arange(block.n + 1))
            row_list, written = rows.tolist(), aligner.written
            groups = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                parts = [written[r] for r in row_list[a:b]]
                groups.append("" if None in parts else ";".join(parts))
            whole = np.array([bool(g) for g in groups], bool)
            number = lambda values: (np.bincount(doc, weights=values[rows], minlength=block.n).astype(np.int64)) * whole
            counts = aligner.n_links[rows] * whole[doc]
            links = aligner.links[ragged(aligner.begins[rows], counts)[0]]
            total += np.bincount(links, minlength=len(total))
            n_links = number(aligner.n_links)
            offsets = np.concatenate([[0], np.cumsum(n_links) * 4]).astype(np.int32)
            if not keep_groups:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            none = pa.nulls(block.n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(number(aligner.n_a)), pa.array(number(aligner.n_b)), pa.array(n_links), pa.array(n_links), pa.array(groups, pa.string()),
                 pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer(offsets), pa.py_buffer(links.astype("<u4"))]), none, none], schema=schema)
        hit = np.flatnonzero(total)
        if len(hit):
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 5 + [pa.nulls(len(hit), pa.string()), pa.nulls(len(hit), pa.binary()), pa.array(hit), pa.array(total[hit])], schema=schema)

    rows = settle(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first, _DOC), "aligned")
    counted = rows.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = Aligner(path_a, path_b).pairs
    counts = np.zeros(len(pairs), np.int64)
    counts[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    of_b = (pairs & 0xFFFFFFFF).astype(np.int64)
    most = np.zeros(int(of_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, of_b, counts)
    shared = spark.sparkContext.broadcast((counts, counts == most[of_b]))

    def second(batches):
        counts, best = shared.value
        for batch in batches:
            raw = batch["links"]
            ids = np.frombuffer(raw.buffers()[2] or b"", "<u4")
            off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] // 4
            ids = ids[off[0] : off[-1]]
            add = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[ids].astype(np.int64))])[off - off[0]])
            kept = [batch[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(add(best)), pa.array(add(counts)), batch["groups"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    docs = rows.where("pair is null").drop("pair", "n")
    return docs.mapInArrow(second, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
