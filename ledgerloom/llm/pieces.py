"""SentencePiece encoding and decoding by a weighted transducer and its shortest path in the tropical semiring."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, ragged, small_batches, spans_to_strings, to_arrow

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_NEVER = float("inf")
FALLBACK_WEIGHT = 100.0
KEPT_UNITS, KEPT_PAIRS = 1 << 20, 1 << 20


def _fields(message: bytes):
    """Number and value of each field of a serialized message: an int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, message[at : at + size]
            at += size


class Transducer:
    """The composition of three machines, as tables.

    The normaliser writes the space sign for each space and one in front. The
    lexicon reads characters and writes pieces; a character that is no piece is
    written as its bytes, at a high weight. For a unigram model a piece weighs its
    negative log probability. A merge model has no weights of that kind; there a
    third machine, whose state is the last piece, lets two pieces follow each
    other only where no merge would have joined across them, and a piece weighs
    one. Then the cheapest path is what the merges give.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = dict(_fields(sp.serialized_model_proto()))
        trainer, normalizer = dict(_fields(proto[2])), dict(_fields(proto[3]))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models without character rules and without removal of white space are compiled")
        self.merges = trainer.get(3, 1) == 2
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = sp.unk_id()
        ids = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.out = [b"" for _ in ids]
        for i in plain:
            self.out[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])
        self.rank = {p: -s for p, s in score.items()}
        self.weight = {p: 1.0 if self.merges else -s for p, s in score.items()}
        self.spines: dict[str, tuple[list, list]] = {}
        if self.merges:
            for piece in list(self.ids):
                edges = self._edges(piece)
                if edges is None:
                    del self.weight[piece]  # no merges lead to it
                else:
                    self.spines[piece] = edges
        self.index()

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """How the piece's last, and its first, character grows by merges: each stage and the rank at which it ends."""
        symbols = [(c, None) for c in piece]
        while len(symbols) > 1:
            ranks = [self.rank.get(symbols[i][0] + symbols[i + 1][0], _NEVER) for i in range(len(symbols) - 1)]
            best = min(ranks)
            if best == _NEVER:
                return None
            i = ranks.index(best)
            symbols[i : i + 2] = [(symbols[i][0] + symbols[i + 1][0], (symbols[i], symbols[i + 1], best))]

        def spine(side: int) -> list:
            node, out, until = symbols[0], [], _NEVER
            while True:
                out.append((node[0], until))
                if node[1] is None:
                    return out[::-1]
                until, node = node[1][2], node[1][side]

        return spine(1), spine(0)

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merges would leave ``left`` and ``right`` side by side: at no stage is joining the two ends due first."""
        a = self.spines[left][0] if left in self.spines else [(left, _NEVER)]
        b = self.spines[right][1] if right in self.spines else [(right, _NEVER)]
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = a[i], b[j]
            across = self.rank.get(x + y, _NEVER)
            if across < until_x and across <= until_y:
                return False
            if until_x == until_y == _NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def shortest(self, text: str, pairs: dict) -> list[int]:
        """Ids of the cheapest path that reads the whole normalised ``text``.

        Places are taken from the left; from each that a path has reached, the
        lexicon's tree is followed as far as the text goes. ``pairs`` keeps what
        ``may_follow`` said.
        """
        n, merges, tree, costs = len(text), self.merges, self.tree, self.costs
        best, before, last = [0.0] + [_NEVER] * n, [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            reached = best[start]
            if reached == _NEVER:
                continue
            node, end, left = tree, start, last[start]
            while end < n:
                found = node.get(text[end])
                end += 1
                if found is None:
                    if end > start + 1:
                        break
                    piece, cost = -ord(text[start]) - 1, reached + FALLBACK_WEIGHT
                else:
                    node, piece = found
                    if piece is not None:
                        cost = reached + costs[piece]
                    elif end == start + 1:
                        piece, cost = -ord(text[start]) - 1, reached + FALLBACK_WEIGHT
                    else:
                        continue
                if cost < best[end]:
                    if merges and start:
                        key = (left << 32) ^ piece
                        fits = pairs.get(key)
                        if fits is None:
                            fits = pairs[key] = self.may_follow(self._string(left), self._string(piece))
                        if not fits:
                            if found is None:
                                break
                            continue
                    best[end], before[end], last[end] = cost, start, piece
                if found is None:
                    break
        path = []
        while n:
            path.append(last[n])
            n = before[n]
        if min(path, default=0) >= 0:
            return path[::-1]
        return [i for piece in reversed(path) for i in self._written(piece)]

    def index(self) -> None:
        """The lexicon as a tree of characters, from the weights of its pieces."""
        self.tree, self.costs = {}, {self.ids[p]: w for p, w in self.weight.items()}
        self.names = {i: p for p, i in self.ids.items()}
        for piece in self.weight:
            node = self.tree
            for c in piece[:-1]:
                node = node.setdefault(c, [{}, None])[0]
            node.setdefault(piece[-1], [{}, None])[1] = self.ids[piece]

    def _string(self, piece: int) -> str:
        return self.names[piece] if piece >= 0 else chr(-piece - 1)

    def _written(self, piece: int) -> list[int]:
        if piece >= 0:
            return [piece]
        return [self.bytes[b] for b in chr(-piece - 1).encode()] if self.bytes else [self.unknown]


class PieceCoder:
    """Applies a transducer to blocks of texts. Distinct units are composed with it once and kept, a bounded number of them."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.pairs: dict = {}
        self._forget()

    def _forget(self):
        self.hashes, self.starts, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids one after another. A unit begins at each first space of several:
        no piece has a space sign after another character."""
        texts = pc.fill_null(texts, "")
        if self.t.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        block = Block(texts)
        d, n = block.data, block.size
        cut = np.zeros(n, bool)
        cut[1:] = (d[1:n] == 0x20) & (d[: max(n - 1, 0)] != 0x20)
        if n > 3:
            cut[3:] &= ~((d[: n - 3] == _SPACE_BYTES[0]) & (d[1 : n - 2] == _SPACE_BYTES[1]) & (d[2 : n - 1] == _SPACE_BYTES[2]))
        cut[block.off[:-1][np.diff(block.off) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)[: len(starts)]
        doc = np.searchsorted(block.off, starts, side="right") - 1
        distinct, first, inverse = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KEPT_UNITS:
            self._forget()
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        raw, got, sizes = d.tobytes(), [], []
        for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True):
            ids = self.t.shortest(raw[a:b].decode("utf-8", "replace").replace(" ", SPACE), self.pairs)
            sizes.append(len(ids))
            got.extend(ids)
        counts = np.array(sizes, np.int64)
        order = np.argsort(np.concatenate([self.hashes, distinct[new]]))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])[order]
        self.hashes, self.counts = np.concatenate([self.hashes, distinct[new]])[order], np.concatenate([self.counts, counts])[order]
        self.ids = np.concatenate([self.ids, np.array(got, np.uint32)])
        place = np.searchsorted(self.hashes, distinct)[inverse]
        counts = self.counts[place]
        flat, _ = ragged(self.starts[place], counts)
        return np.bincount(doc, weights=counts, minlength=block.n).astype(np.int64), self.ids[flat]

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The inverse machine: each piece's text, the space sign as a space, without the one in front; bad bytes are replaced."""
        lengths = np.array([len(o) for o in self.t.out], np.int64)
        data = np.frombuffer(b"".join(self.t.out), np.uint8)
        flat, off = ragged((np.cumsum(lengths) - lengths)[ids], lengths[ids])
        text = data[flat]
        ends = off[np.cumsum(counts)]
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        if self.t.prefix and len(text):
            starts = starts + ((ends > starts) & (text[np.minimum(starts, len(text) - 1)] == 0x20))
        raw = spans_to_strings(text, starts, ends, binary=True)
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.large_string())


_CODERS: dict = {}


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Piece ids of every whole text, and the text that they decode to.

    The machine is compiled once, on the driver, and sent to the workers; its size
    is the model's. One row per input row, any id: doc_id, n_pieces, ids_crc32
    (of little-endian unsigned 32-bit ids), ids and decoded unless ``keep_ids`` is
    false, and round_trip: whether decoding gave the text back (the space sign
    itself reads as a space). A null or empty text has no pieces; no rows give
    no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    machine = spark.sparkContext.broadcast(Transducer(model_path))
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())]
    fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if keep_ids else []
    schema = pa.schema(fields)

    def run(batches):
        if model_path not in _CODERS:
            _CODERS[model_path] = PieceCoder(machine.value)
        coder = _CODERS[model_path]
        for table in blocks(batches):
            texts = pc.fill_null(table["text"].combine_chunks(), "")
            counts, ids = coder.encode(texts)
            decoded = coder.decode(counts, ids)
            off = np.concatenate([[0], np.cumsum(counts)])
            raw = ids.astype("<u4").tobytes()
            same = pc.equal(decoded, pc.replace_substring(texts, SPACE, " ").cast(pa.large_string()))
            out = {"doc_id": table["doc_id"].combine_chunks(), "n_pieces": counts, "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1], off[1:], strict=True)], "round_trip": same}
            if keep_ids:
                out |= {"ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int64))), "decoded": decoded}
            yield to_arrow(schema, out)

    kinds = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<long>, decoded string" if keep_ids else "")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)
