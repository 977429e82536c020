"""Token ids in binary files of fixed-width bit packing, as a Spark data source with random access.

A shard file holds, little-endian:

    magic    8 bytes
    blocks   the ids, ``bits`` bits each, lowest bit first, in 64-bit words; 64 ids fill ``bits`` words
    footer   unsigned 64-bit places of the blocks and of their end, unsigned 32-bit crc32 of each block,
             unsigned 64-bit first id of each document and the number of ids, 64-bit document ids, a byte each: 1 for a null id
    trailer  unsigned 64-bit: bits, ids a block, ids, documents, blocks, place of the footer; then the magic again

``manifest.json`` beside the shards names those that belong to the table, in order, with the ids before each.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.taskcontext import TaskContext

from .common import Block, blocks, small_batches
from .joined import JoinedCoder

MAGIC = b"LLOOMID1"
FORMAT = "packed_ids"
GROUP = 64
BLOCK_IDS = 8192
#: Largest shard: so many ids or documents, then the task begins another one.
SHARD_IDS, SHARD_DOCS = 1 << 28, 1 << 22
#: Ids that one reading task is given, and ids unpacked at once.
SPLIT_IDS, CHUNK_IDS = 1 << 24, 1 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_TRAILER = 6 * 8 + len(MAGIC)
_SAMPLE = " Ab \n\tÉ\u3000漢"


def bits_for(vocab_size: int) -> int:
    """The least number of bits that holds every id of a vocabulary."""
    return max(1, (int(vocab_size) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits an id in 64-bit words; the ids are filled up to whole groups of 64 with zeros."""
    rows = -(-len(ids) // GROUP)
    padded = np.zeros(rows * GROUP, np.uint64)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(rows, GROUP).T)
    words = np.zeros((bits, rows), np.uint64)
    for i in range(GROUP):
        word, shift = divmod(i * bits, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack_bits(raw: bytes, bits: int) -> np.ndarray:
    """All ids of whole groups."""
    words = np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, bits).T)
    out = np.empty((GROUP, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(GROUP):
        word, shift = divmod(i * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        out[i] = value & mask
    return np.ascontiguousarray(out.T).reshape(-1)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it; a path without a scheme is a shared mounted folder."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Shard:
    """Writes one shard; holds one chunk of ids and the footer."""

    def __init__(self, fs: pafs.FileSystem, path: str, bits: int, vocab_size: int):
        self.path, self.bits, self.vocab_size = path, bits, vocab_size
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.places, self.sums, self.starts, self.docs, self.nulls = [len(MAGIC)], [], [0], [], []
        self.held, self.n_held, self.n_ids = [], 0, 0

    def add(self, doc_id, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        if len(ids) and int(ids.max()) >= self.vocab_size:
            raise ValueError(f"id {int(ids.max())} of document {doc_id} is outside of a vocabulary of {self.vocab_size}")
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        if self.n_held >= CHUNK_IDS:
            self._write(self.n_held // BLOCK_IDS * BLOCK_IDS)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        raw, step = memoryview(pack_bits(ids[:n], self.bits)), BLOCK_IDS * self.bits // 8
        for at in range(0, len(raw), step):
            block = raw[at : at + step]
            self.sums.append(zlib.crc32(block))
            self.places.append(self.places[-1] + len(block))
        self.out.write(raw)
        self.held, self.n_held = [ids[n:]], self.n_held - n

    def close(self) -> dict:
        if self.n_held:
            self._write(self.n_held)
        for values, kind in ((self.places, "<u8"), (self.sums, "<u4"), (self.starts, "<u8"), (self.docs, "<i8"), (self.nulls, "u1")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(np.array([self.bits, BLOCK_IDS, self.n_ids, len(self.docs), len(self.sums), self.places[-1]], "<u8").tobytes() + MAGIC)
        self.out.close()
        return {"file": self.path.rsplit("/", 1)[-1], "ids": self.n_ids, "documents": len(self.docs)}


class ShardFile:
    """One shard, read in parts: its trailer, then only what is asked for."""

    def __init__(self, folder: str, name: str):
        fs, base = _store(folder)
        self.path, self._places = f"{base}/{name}", None
        self.file = fs.open_input_file(self.path)
        size = self.file.size()
        if size < len(MAGIC) + _TRAILER or self.file.read_at(len(MAGIC), size - len(MAGIC)) != MAGIC:
            raise OSError(f"{self.path} is not a whole shard")
        self.bits, self.block_ids, self.n_ids, self.n_docs, self.n_blocks, self.footer = self._part(size - _TRAILER, 6, "<u8").tolist()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _part(self, at: int, n: int, kind: str) -> np.ndarray:
        raw = self.file.read_at(n * np.dtype(kind).itemsize, at)
        if len(raw) != n * np.dtype(kind).itemsize:
            raise OSError(f"{self.path} is cut short")
        return np.frombuffer(raw, kind)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id of each document and the end, document ids, which of them are null."""
        at = self.footer + (self.n_blocks + 1) * 8 + self.n_blocks * 4
        starts = self._part(at, self.n_docs + 1, "<u8").astype(np.int64)
        at += (self.n_docs + 1) * 8
        return starts, self._part(at, self.n_docs, "<i8"), self._part(at + self.n_docs * 8, self.n_docs, "u1").astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop`` of this shard; reads the blocks they lie in and tests their sums."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        if self._places is None:
            self._places = self._part(self.footer, self.n_blocks + 1, "<u8").astype(np.int64)
            self._sums = self._part(self.footer + (self.n_blocks + 1) * 8, self.n_blocks, "<u4")
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        begin, end = int(self._places[first]), int(self._places[last])
        raw = memoryview(self.file.read_at(end - begin, begin))
        for b in range(first, last):
            block = raw[int(self._places[b]) - begin : int(self._places[b + 1]) - begin]
            if zlib.crc32(block) != int(self._sums[b]):
                raise OSError(f"block {b} of {self.path} is damaged")
        return unpack_bits(raw, self.bits)[start - first * self.block_ids : stop - first * self.block_ids]


def manifest(folder: str) -> list[dict]:
    fs, base = _store(folder)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        return json.loads(f.read())["shards"]


class PackedTable:
    """Random access without Spark: ids of a range of the whole table, touching only the blocks they lie in."""

    def __init__(self, folder: str):
        self.folder, self.shards = folder, manifest(folder)
        self.bases = [s["base"] for s in self.shards]
        self.n_ids = self.bases[-1] + self.shards[-1]["ids"] if self.shards else 0

    def ids(self, start: int, stop: int) -> np.ndarray:
        stop, parts = min(stop, self.n_ids), []
        at = max(0, bisect.bisect_right(self.bases, start) - 1)
        while start < stop:
            base, n = self.bases[at], self.shards[at]["ids"]
            with ShardFile(self.folder, self.shards[at]["file"]) as shard:
                parts.append(shard.ids(start - base, min(stop - base, n)))
            start, at = min(stop, base + n), at + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class _Written(WriterCommitMessage):
    def __init__(self, task: int, shards: list[dict]):
        self.task, self.shards = task, shards


class _Writer(DataSourceArrowWriter):
    """Every attempt of a task writes files of its own name; only those of the attempt that counts get into the manifest."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.vocab_size, self.overwrite, self.job = options["path"], int(options["vocab_size"]), overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, base = _store(self.folder)
        fs.create_dir(base, recursive=True)
        done, shard = [], None
        for batch in iterator:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard and (shard.n_ids >= SHARD_IDS or len(shard.docs) >= SHARD_DOCS):
                    done.append(shard.close())
                    shard = None
                if not shard:
                    shard = _Shard(fs, f"{base}/{self.job}-{task:06d}-{attempt}-{len(done):04d}.ids", bits_for(self.vocab_size), self.vocab_size)
                shard.add(doc_id, raw or b"")
        if shard:
            done.append(shard.close())
        return _Written(task, done)

    def commit(self, messages: list) -> None:
        fs, base = _store(self.folder)
        fs.create_dir(base, recursive=True)
        old = [] if self.overwrite or not fs.get_file_info(f"{base}/manifest.json").is_file else manifest(self.folder)
        total = old[-1]["base"] + old[-1]["ids"] if old else 0
        for message in sorted((m for m in messages if m), key=lambda m: m.task):
            for shard in message.shards:
                old.append(shard | {"base": total})
                total += shard["ids"]
        with fs.open_output_stream(f"{base}/manifest.{self.job}") as out:
            out.write(json.dumps({"shards": old}).encode())
        fs.move(f"{base}/manifest.{self.job}", f"{base}/manifest.json")
        self._clear(fs, base, {s["file"] for s in old})

    def abort(self, messages: list) -> None:
        fs, base = _store(self.folder)
        self._clear(fs, base, set())

    def _clear(self, fs, base: str, kept: set) -> None:
        """Files of attempts of this job that don't count, and when overwriting those of earlier tables."""
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            name = info.base_name
            mine = name.startswith(self.job) or (kept and self.overwrite)
            if mine and name.endswith(".ids") and name not in kept:
                fs.delete_file(info.path)


class _Split(InputPartition):
    def __init__(self, entry: dict, start: int, stop: int):
        super().__init__((entry["file"], start))
        self.entry, self.start, self.stop = entry, start, stop


class _Reader(DataSourceReader):
    """A task takes the documents that begin in its range of a shard's ids."""

    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("split_ids", SPLIT_IDS))

    def partitions(self) -> list:
        return [_Split(s, at, at + self.split) for s in manifest(self.folder) for at in range(0, max(1, s["ids"]), self.split)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        if partition is None or not hasattr(partition, "entry"):
            return
        with ShardFile(self.folder, partition.entry["file"]) as shard:
            starts, docs, nulls = shard.documents()
            last = shard.n_docs if partition.stop >= shard.n_ids else int(np.searchsorted(starts[:-1], partition.stop))
            first = int(np.searchsorted(starts[:-1], partition.start)) if partition.start else 0
            while first < last:
                stop = min(last, max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_IDS, side="right")) - 1))
                raw = shard.ids(int(starts[first]), int(starts[stop])).astype("<u4").tobytes()
                offsets = ((starts[first : stop + 1] - starts[first]) * 4).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), stop - first, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[first:stop], mask=nulls[first:stop]), pa.array(starts[first:stop] + partition.entry["base"]), pa.array(np.diff(starts[first : stop + 1])), ids], schema=schema)
                first = stop


class PackedIds(DataSource):
    """``packed_ids``: rows (doc_id, ids as little-endian unsigned 32-bit) in, rows of ``SCHEMA`` out, in the order written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def write_token_ids(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every whole text, add ``end_id``, and write the ids in ascending order of document ids.

    Rows are dealt by ranges of (id, hash of the text) and sorted, so shards follow
    each other in order and the ids before each follow from their numbers alone.
    Texts are shuffled once; ids go straight into the shards. Null ids come first;
    rows of one id are ordered by a hash of their text; a null or empty text is
    its end id; no rows give a table without shards. Other columns are not looked
    at. A value is stored in the least number of bits of the vocabulary.
    """
    from tokenizers import Tokenizer

    spark = df.sparkSession
    small_batches(spark)
    spark.dataSource.register(PackedIds)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    if tokenizer.decode(tokenizer.encode(_SAMPLE, add_special_tokens=False).ids) != _SAMPLE:
        raise ValueError(f"{tokenizer_path} is not a byte-level tokenizer, which this coder needs")
    vocab_size = tokenizer.get_vocab_size()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")

    def run(batches):
        coder = JoinedCoder.at(tokenizer_path)
        for table in blocks(batches):
            block = Block(table["text"])
            doc, place = coder.encode(block)
            counts = np.bincount(doc, weights=coder.counts[place], minlength=block.n).astype(np.int64)
            out = np.full(int(counts.sum()) + block.n, end_id, "<u4")
            ends = np.cumsum(counts + 1)
            body = np.ones(len(out), bool)
            body[ends - 1] = False
            out[body] = coder.ids_of(place)
            offsets = np.concatenate([[0], ends * 4])
            if offsets[-1] < 1 << 31:
                ids = pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
            else:
                ids = pa.Array.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), ids], names=["doc_id", "ids"])

    encoded = ordered.mapInArrow(run, "doc_id long, ids binary")
    encoded.write.format(FORMAT).mode("overwrite").option("vocab_size", vocab_size).save(folder)


def read_token_ids(spark: SparkSession, folder: str, split_ids: int = SPLIT_IDS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of a written table."""
    spark.dataSource.register(PackedIds)
    if not manifest(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format(FORMAT).option("split_ids", split_ids).load(folder)
