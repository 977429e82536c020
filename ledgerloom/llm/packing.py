"""Packing: bounded-space online best fit into fixed windows, leftovers merged at the end."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import Block, blocks, settle, small_batches
from .units import UnitCoder

FAN_IN = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"
HELD = "doc_id array<long>, start array<long>, length array<long>, doc_tokens array<long>, ids binary"
_PIECE_ARROW = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("ids", pa.binary())]
_HELD_ARROW = [("doc_id", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("ids", pa.binary())]


class Packer:
    """At most ``most_open`` unfinished windows. A piece goes where the least room is left after it; when none
    has room, it tops up the fullest one, which is emitted, and what is left of it begins a window."""

    def __init__(self, size: int, most_open: int, first_id: int, keep_ids: bool):
        self.size, self.most_open, self.next_id, self.keep_ids = size, most_open, first_id, keep_ids
        self.open: list[list] = []  # [room, pieces]
        self.out: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.size:
            self._emit([(doc_id, start, ids[: self.size], doc_tokens)])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        fits = [w for w in self.open if w[0] >= len(ids)]
        if fits:
            window = min(fits, key=lambda w: w[0])
            window[0] -= len(ids)
            window[1].append((doc_id, start, ids, doc_tokens))
            if not window[0]:
                self.open.remove(window)
                self._emit(window[1])
            return
        if len(self.open) >= self.most_open:
            window = min(self.open, key=lambda w: w[0])
            self.open.remove(window)
            room = window[0]
            self._emit([*window[1], (doc_id, start, ids[:room], doc_tokens)])
            start, ids = start + room, ids[room:]
        self.open.append([self.size - len(ids), [(doc_id, start, ids, doc_tokens)]])

    def close(self) -> None:
        """Merge what is left over: the open windows' pieces fill one window after another."""
        left, self.open, self.most_open = self.held(), [], 1
        for piece in left:
            self.add(*piece)
        for _, pieces in self.open:
            self._emit(pieces)
        self.open = []

    def held(self) -> list[tuple]:
        return [p for _, pieces in self.open for p in pieces]

    def _emit(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(len(p[2]) for p in pieces)
        for doc_id, start, ids, doc_tokens in pieces:
            raw = ids.astype("<u4").tobytes()
            self.out.append((doc_id, start, len(ids), zlib.crc32(raw), doc_tokens, self.next_id, offset, total, raw if self.keep_ids else None))
            offset += len(ids)
        self.next_id += 1

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(pieces: list[tuple], held: list[tuple] | None, group: int) -> pa.RecordBatch:
    """Rows of finished pieces, and if given one row with everything that still is open."""
    n, extra = len(pieces), int(held is not None)
    columns = list(zip(*pieces, strict=True)) if n else [()] * len(_PIECE_ARROW)
    arrays = [pa.array([*c, *[None] * extra], type=t) for c, (_, t) in zip(columns, _PIECE_ARROW, strict=True)]
    row = [None] * n
    if extra:
        row.append({"doc_id": [p[0] for p in held], "start": [p[1] for p in held], "length": [len(p[2]) for p in held], "doc_tokens": [p[3] for p in held], "ids": np.concatenate([p[2] for p in held] or [np.zeros(0)]).astype("<u4").tobytes()})
    arrays += [pa.array(row, type=pa.struct(_HELD_ARROW)), pa.array([group] * (n + extra), type=pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*(k for k, _ in _PIECE_ARROW), "held", "of"])


def _merger(size: int, most_open: int, level: int, last: bool, keep_ids: bool):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = Packer(size, most_open, (level << 58) + (group << 32), keep_ids)
        for row in table.sort_by([("ids", "ascending")]).to_pylist():
            ids, begin = np.frombuffer(row["ids"], dtype="<u4"), 0
            for doc_id, start, length, doc_tokens in zip(row["doc_id"], row["start"], row["length"], row["doc_tokens"], strict=True):
                packer.add(doc_id, start, ids[begin : begin + length], doc_tokens)
                begin += length
        if last:
            packer.close()
        return pa.Table.from_batches([_batch(packer.taken(), packer.held() if packer.open else None, group)])

    return merge


def pack(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, most_open: int = 8, end_id: int = 0, keep_ids: bool = True,
) -> DataFrame:
    """Pack the token ids of all documents, each followed by ``end_id``, into sequences of ``size`` ids.

    Every partition packs its own documents with a fixed number of open windows.
    The windows that are still open at its end travel as one row; rows of 64
    partitions meet and are packed on, again with few windows left open, until
    one such row remains. So the largest group is 64 partitions' open windows,
    at any input size, and only the last windows of all are padded.

    A row per piece: doc_id, start, length, ids (unless ``keep_ids`` is false),
    ids_crc32 (over little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset, sequence_length, padded_length (the length itself at a power of two,
    else ``size``). A null or empty text is just its end id; repeated rows are
    packed as often as they come; no rows give no rows. Ids may be null.
    """
    spark = df.sparkSession
    small_batches(spark)

    def first(batches):
        coder, group = UnitCoder.at(tokenizer_path), TaskContext.get().partitionId()
        packer = Packer(size, most_open, group << 32, keep_ids)
        for table in blocks(batches):
            block = Block(table["text"])
            doc, place = coder.encode(block)
            ids = coder.ids_of(place)
            ends = np.cumsum(np.bincount(doc, weights=coder.counts[place], minlength=block.n).astype(np.int64))
            begin = 0
            for doc_id, end in zip(table["doc_id"].to_pylist(), ends.tolist(), strict=True):
                packer.add(doc_id, 0, np.append(ids[begin:end], np.uint32(end_id)), end - begin + 1)
                begin = end
            yield _batch(packer.taken(), None, group)
        if packer.open:
            yield _batch(packer.taken(), packer.held(), group)

    schema = f"{PIECE}, held struct<{HELD.replace(' array', ':array').replace('ids binary', 'ids:binary')}>, of long"
    rounds = [settle(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first, schema), "packed")]
    while True:
        left = rounds[-1].where("held is not null")
        groups = (left.agg(F.max("of")).head()[0] or 0) + 1
        last, level = groups <= FAN_IN, len(rounds)
        more = left.select("held.*", (F.col("of") / FAN_IN).cast("long").alias("of"))

        merged = more.groupBy("of").applyInArrow(_merger(size, most_open, level, last, keep_ids), schema)
        rounds.append(merged if last else settle(merged, f"merged{level}"))
        if last:
            break
    out = rounds[0].where("held is null")
    for more in rounds[1:]:
        out = out.union(more.where("held is null"))
    power = F.col("sequence_length").bitwiseAND(F.col("sequence_length") - 1) == 0
    out = out.drop("held", "of").withColumn("padded_length", F.when(power, F.col("sequence_length")).otherwise(F.lit(size).cast("long")))
    return out if keep_ids else out.drop("ids")
