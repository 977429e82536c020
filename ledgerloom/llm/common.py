"""Shared by the operators here: settled tables, byte-bounded Arrow blocks, word spans and span hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
BLOCK_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPAN_STEPS = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exact(name: str) -> Column:
    """The column of exactly this name, which may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it from there.

    All executors share that folder, so the rows outlive any of them, two
    branches see the same rows, and the lineage ends here.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}-{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of few rows, since one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some whole texts as one byte array; ``off`` holds where each text starts, and the end."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        texts = texts.fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.size = len(raw)
        self.data = np.zeros(self.size + 8, dtype=np.uint8)  # eight bytes more, for reads of whole machine words
        self.data[: self.size] = TO_LOWER[raw] if lower else raw
        self.n = n

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each run of bytes other than white space."""
        solid = ~IS_SPACE[self.data[: self.size]]
        before, after = np.zeros(self.size, bool), np.zeros(self.size, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = self.off[1:-1]
        before[edges[edges < self.size]] = False
        after[edges[(edges > 0)] - 1] = False
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(self.off, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hash of each span; spans of up to eight bytes never collide with one another."""
        length = (ends - starts).astype(np.int64)
        eight = np.ndarray((max(self.size, 1),), dtype="<u8", buffer=self.data, strides=(1,)) if self.size else np.zeros(1, np.uint64)
        h = mix(length.astype(np.uint64) * _GOLDEN + np.uint64(seed))
        active = np.arange(len(starts))
        for step in range(_SPAN_STEPS):
            left = length[active] - 8 * step
            if step:
                active, left = active[left > 0], left[left > 0]
            else:
                left = np.maximum(left, 0)
            if not len(active):
                return h
            at = np.minimum(starts[active] + 8 * step, max(self.size - 1, 0))
            part = np.where(left >= 8, eight[at], eight[at] & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)))
            h[active] = mix((h[active] ^ part) * _GOLDEN + np.uint64(step + 1))
        for i in np.flatnonzero(length > 8 * _SPAN_STEPS):
            digest = hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            h[i] = np.frombuffer(digest, dtype="<u8")[0]
        return h


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches so that each table holds about ``most`` bytes of text, or one longer text."""
    held, size = [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        lengths = np.nan_to_num(np.asarray(_byte_lengths(batch.column(column)), dtype=np.float64)).astype(np.int64)
        start, ends = 0, np.cumsum(lengths)
        while start < len(lengths):
            done = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, done + most - size, side="right"))
            if stop == start:
                if held:
                    yield pa.concat_tables(held)
                    held, size = [], 0
                    continue
                stop = start + 1
            held.append(table.slice(start, stop - start))
            size += int(ends[stop - 1] - done)
            start = stop
            if size >= most:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[pa.Table]:
    """Regroup Arrow batches that are sorted by ``keys`` so that no group is cut; about ``least`` rows a table, or one larger group."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(len(table), bool)
        for key in keys:
            column = table[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
            new[0] |= bool(held) and held[-1][key][-1].as_py() != column[0]
        starts = np.flatnonzero(new)
        if len(starts) and size + starts[-1] >= least:
            held.append(table.slice(0, starts[-1]))
            yield pa.concat_tables(held)
            table = table.slice(starts[-1])
            held, size = [], 0
        held.append(table)
        size += len(table)
    if held:
        yield pa.concat_tables(held)


def _byte_lengths(texts: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def spans_to_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, binary: bool = False) -> pa.Array:
    """An Arrow array of the bytes of each span, gathered at once."""
    flat, off = ragged(starts, ends - starts)
    kind = pa.large_binary() if binary else pa.large_string()
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[flat]))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all members of the ranges, one after another, and each range's offset in them."""
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.arange(off[-1], dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - off[:-1], lengths)
    return flat, off


def to_arrow(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def crc_mod(column, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
