"""Substring deduplication: runs of windows that share a minimiser travel together and are counted exactly where they meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Block, blocks, exact, mix, ragged, small_batches, spans_to_strings, to_arrow, whole_groups

GRAM = 4
BUCKET_BYTES = 8 << 20
FILTER_BITS = 1 << 27
HOT_BLOCKS = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _runs_hash(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(starts), np.uint64(length))
    for j in range(length):
        h = mix((h ^ words[starts + j]) * _MULTIPLIER + np.uint64(j))
    return h


class SuperKmers:
    """The runs of consecutive windows of one block that have the same minimiser: the least hash of the window's ``GRAM``-word runs."""

    def __init__(self, block: Block, window: int):
        self.starts, self.ends, self.word_doc = block.words()
        self.words = block.hashes(self.starts, self.ends)
        count = np.bincount(self.word_doc, minlength=block.n)
        self.first_word = np.concatenate([[0], np.cumsum(count)])
        at, _ = ragged(self.first_word[:-1], np.maximum(count - window + 1, 0))  # the first word of each window
        gram = min(GRAM, window)
        grams = np.zeros(len(self.words), np.uint64)
        inner = np.arange(max(len(self.words) - gram + 1, 0))
        grams[: len(inner)] = _runs_hash(self.words, inner, gram)
        least = grams[at] if len(at) else np.zeros(0, np.uint64)
        for j in range(1, window - gram + 1):
            least = np.minimum(least, grams[at + j])
        doc = self.word_doc[at] if len(at) else np.zeros(0, np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        self.minimiser, self.doc, self.at = least[begin], doc[begin], at[begin]
        self.windows = np.diff(np.append(begin, len(at)))


def _bit(minimiser: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each minimiser, and its bit in that bucket's own part of the filter."""
    h = mix(minimiser ^ np.uint64(0xA5A5))
    return (h % np.uint64(buckets)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _shared(docs: DataFrame, window: int, buckets: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every bucket two bit maps of minimisers: those of two documents or more, and those of very many blocks.

    A block sends a minimiser with the least and the greatest id that it has there, so one that a third of
    all documents hold comes twice from a block at most. The maps' size is fixed, whatever the input's.
    """
    sent = pa.schema([("bucket", pa.int64()), ("minimisers", pa.binary()), ("ids", pa.binary())])

    def send(batches):
        codec = pa.Codec("zstd")
        for table in blocks(batches):
            runs = SuperKmers(Block(table["text"]), window)
            ids = table["doc_id"].to_numpy()[runs.doc] if len(runs.doc) else np.zeros(0, np.int64)
            order = np.lexsort((ids, runs.minimiser))
            minimiser, ids = runs.minimiser[order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = minimiser[1:] != minimiser[:-1]
            last = np.append(new[1:], True) if len(new) else new
            last &= ~(new & last)
            last[1:] &= ids[1:] != ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))][1:]
            minimiser, ids = minimiser[new | last], ids[new | last]
            bucket, _ = _bit(minimiser, buckets, bits)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            minimiser, ids = minimiser[order], ids[order]
            filled = np.flatnonzero(np.diff(edges))
            yield to_arrow(sent, {
                "bucket": filled, "minimisers": [minimiser[edges[b] : edges[b + 1]].tobytes() for b in filled], "ids": [codec.compress(ids[edges[b] : edges[b + 1]].tobytes(), asbytes=True) for b in filled],
            })

    def decide(batches):
        codec = pa.Codec("zstd")
        for table in whole_groups(batches, ["bucket"], 1):
            buckets_here = table["bucket"].to_numpy()
            for bucket in np.unique(buckets_here):
                own = table.filter(pa.array(buckets_here == bucket))
                minimiser = np.frombuffer(b"".join(own["minimisers"].to_pylist()), np.uint64)
                sizes = [len(m) for m in own["minimisers"].to_pylist()]  # as many bytes of ids
                ids = np.frombuffer(b"".join(codec.decompress(p, n, asbytes=True) for p, n in zip(own["ids"].to_pylist(), sizes, strict=True)), np.int64)
                order = np.argsort(minimiser)
                minimiser, ids = minimiser[order], ids[order]
                first = np.flatnonzero(np.append(True, minimiser[1:] != minimiser[:-1]))
                shared = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
                maps = []
                for chosen in (shared, shared & (np.diff(np.append(first, len(ids))) > HOT_BLOCKS)):
                    _, at = _bit(minimiser[first[chosen]], buckets, bits)
                    on = np.zeros(bits, np.uint8)
                    on[at] = 1
                    maps.append(np.packbits(on, bitorder="little").tobytes())
                yield to_arrow(decided, {"bucket": [bucket], "shared": maps[:1], "hot": maps[1:]})

    decided = pa.schema([("bucket", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())])
    met = docs.select("doc_id", "text").mapInArrow(send, "bucket long, minimisers binary, ids binary").repartition("bucket").sortWithinPartitions("bucket")
    empty = np.zeros(bits // 8, np.uint8)
    maps = [(empty, empty)] * buckets
    for row in met.mapInArrow(decide, "bucket long, shared binary, hot binary").collect():  # FILTER_BITS twice, at any size
        maps[row.bucket] = np.frombuffer(row.shared, np.uint8), np.frombuffer(row.hot, np.uint8)
    return maps


def _candidates(block: Block, window: int, shared, hot, buckets: int, bits: int):
    """The runs of a block whose minimiser may be another document's too, each as one packed string; of very
    frequent minimisers each window alone. Returns where they go, whose they are, and two hashes of each."""
    def on(maps, minimiser):
        if maps.value is None:
            return np.zeros(len(minimiser), bool)
        bucket, at = _bit(minimiser, buckets, bits)
        place = bucket * bits + at
        return (maps.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0

    runs = SuperKmers(block, window)
    chosen = on(shared, runs.minimiser)
    key, doc, at, windows = runs.minimiser[chosen], runs.doc[chosen], runs.at[chosen], runs.windows[chosen]
    alone = on(hot, key)
    if alone.any():
        single, _ = ragged(at[alone], windows[alone])
        key = np.concatenate([key[~alone], _runs_hash(runs.words, single, window)])
        doc = np.concatenate([doc[~alone], np.repeat(doc[alone], windows[alone])])
        at, windows = np.concatenate([at[~alone], single]), np.concatenate([windows[~alone], np.ones(len(single), np.int64)])
    packed, starts, ends = _packed(block, runs, at, at + windows + window - 2)
    s1, s2 = (packed.hashes(starts, ends, seed) for seed in (1, 2))
    return _bit(key, buckets, bits)[0], doc, at - runs.first_word[doc], packed, starts, ends, s1, s2


def _strings(docs: DataFrame, window: int, shared, hot, buckets: int, bits: int) -> DataFrame:
    """The packed strings of each block for each bucket, compressed together, with the least id that has each; equal ones once."""
    schema = pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("bytes", pa.int64()), ("low", pa.binary()), ("count", pa.int64())])

    def run(batches):
        codec = pa.Codec("zstd")
        for table in blocks(batches):
            bucket, doc, _, packed, starts, ends, s1, s2 = _candidates(Block(table["text"]), window, shared, hot, buckets, bits)
            if not len(doc):
                continue
            ids = table["doc_id"].to_numpy()[doc]
            order = np.lexsort((ids, s2, s1))
            new = np.append(True, (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1]))
            sender = order[new]
            sender = sender[np.argsort(bucket[sender], kind="stable")]
            edges = np.searchsorted(bucket[sender], np.arange(buckets + 1))
            out: dict[str, list] = {"bucket": [], "packed": [], "bytes": [], "low": [], "count": []}
            for b in np.flatnonzero(np.diff(edges)):
                own = sender[edges[b] : edges[b + 1]]
                data, _, _ = joined(packed.data, starts[own], ends[own], 0x0A)
                out["bucket"].append(b)
                out["packed"].append(codec.compress(data.tobytes(), asbytes=True))
                out["bytes"].append(len(data))
                out["low"].append(codec.compress(ids[own].tobytes(), asbytes=True))
                out["count"].append(len(own))
            yield to_arrow(schema, out)

    return docs.mapInArrow(run, "bucket long, packed binary, bytes long, low binary, count long")


def _occurrences(docs: DataFrame, window: int, shared, hot, buckets: int, bits: int) -> DataFrame:
    """Where each packed string occurs: its two hashes, document and first word."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for table in blocks(batches):
            _, doc, at, _, _, _, s1, s2 = _candidates(Block(table["text"]), window, shared, hot, buckets, bits)
            if len(doc):
                yield to_arrow(schema, {
                    "s1": s1.view(np.int64), "s2": s2.view(np.int64), "doc_id": table["doc_id"].to_numpy()[doc], "text_hash": table["text_hash"].to_numpy()[doc], "start": at.astype(np.int32),
                })

    return docs.mapInArrow(run, "s1 long, s2 long, doc_id long, text_hash long, start int")


def _packed(block: Block, runs: SuperKmers, first: np.ndarray, last: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray]:
    """The words of each run joined by single spaces, as one array and each run's span in it."""
    words, off = ragged(first, last - first + 1)
    data, _, word_ends = joined(block.data, runs.starts[words], runs.ends[words])
    ends = word_ends[off[1:] - 1] if len(first) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(first)]
    out = Block(pa.array([], pa.string()))
    out.data, out.size = np.concatenate([data, np.zeros(8, np.uint8)]), len(data)
    return out, starts.astype(np.int64), ends.astype(np.int64)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: int = 0x20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans copied one after another, a space (or another byte) after each, with where each begins and ends there."""
    length = ends - starts
    flat, off = ragged(starts, length + 1)
    out = data[np.minimum(flat, len(data) - 1)]
    out[off[1:] - 1] = after
    return out, off[:-1], off[1:] - 1


def _least_ids(strings: DataFrame, window: int) -> DataFrame:
    """For every distinct packed string the least id that has each of its windows: windows of a bucket are sorted and met exactly."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("least", pa.list_(pa.int64()))])

    def run(batches):
        codec = pa.Codec("zstd")
        for table in whole_groups(batches, ["bucket"], 1):
            of = table["bucket"].to_numpy()
            for bucket in np.unique(of):
                rows = table.filter(pa.array(of == bucket))
                raw = b"".join(codec.decompress(p, n, asbytes=True) for p, n in zip(rows["packed"].to_pylist(), rows["bytes"].to_pylist(), strict=True))
                low = np.frombuffer(b"".join(codec.decompress(p, 8 * n, asbytes=True) for p, n in zip(rows["low"].to_pylist(), rows["count"].to_pylist(), strict=True)), np.int64)
                block = Block(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)))
                starts, ends, _ = block.words()
                line_ends = np.flatnonzero(block.data[: block.size] == 0x0A)
                count = np.bincount(np.searchsorted(line_ends, starts), minlength=len(low))
                first = np.concatenate([[0], np.cumsum(count)])[:-1]
                at, off = ragged(first, count - window + 1)
                one, two = (_runs_hash(block.hashes(starts, ends, seed), at, window) for seed in (0, 5))
                ids = np.repeat(low, count - window + 1)
                order = np.lexsort((two, one))
                one, two = one[order], two[order]
                new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
                least = np.empty(len(ids), np.int64)
                least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
                s1, s2 = (block.hashes(np.append(0, line_ends[:-1] + 1), line_ends, seed) for seed in (1, 2))
                order = np.lexsort((s2, s1))
                chosen = order[np.append(True, (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1]))]
                flat, own = ragged(off[chosen], np.diff(off)[chosen])
                yield to_arrow(schema, {
                    "s1": s1[chosen].view(np.int64), "s2": s2[chosen].view(np.int64), "least": pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(least[flat])),
                })

    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "s1 long, s2 long, least array<long>")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Take out every word that lies in a run of ``window`` words which also starts in a document of a smaller id.

    Three passes. (1) Blocks tell buckets which minimisers they have; those of one
    document cannot belong to a repeated window and are left out by bit maps of
    fixed size, in which a chance hit costs some work and no more. (2) Runs of
    windows with the other minimisers travel as packed strings, equal ones of a
    block once; in their bucket windows are sorted, and each gets the least id
    that has it, which occurrences learn in a join. (3) Texts meet the windows that a smaller id has, and lose
    their words. Windows are judged on the input, not on what is left.

    Returns the columns of ``df`` with the text rewritten (kept words joined by
    single spaces; null and empty texts: empty), and n_words and n_removed, which
    replace columns of these names in any case; other columns may have any name
    and type. One row per input row; rows of the same id do
    not remove from each other; a null id neither loses words nor costs another
    document any; texts shorter than a window lose nothing; no rows give no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.where(exact(id_col).isNotNull() & exact(text_col).isNotNull()).select(exact(id_col).cast("long").alias("doc_id"), exact(text_col).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    bits = max(8, min(FILTER_BITS, total // 4 + (1 << 16)) // buckets // 8 * 8)
    maps = _shared(docs, window, buckets, bits)
    shared, hot = (np.concatenate([m[i] for m in maps]) for i in (0, 1))
    shared, hot = (spark.sparkContext.broadcast(m if m.any() else None) for m in (shared, hot))
    least = _least_ids(_strings(docs, window, shared, hot, buckets, bits), window)
    met = _occurrences(docs, window, shared, hot, buckets, bits).join(least, ["s1", "s2"])
    places = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    lost = met.select("doc_id", "text_hash", places.alias("places")).where(F.size("places") > 0).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("places")).alias("places"))

    columns = [c for c in df.columns if c.lower() not in ("n_words", "n_removed")]
    others = F.struct(*[exact(c) for c in columns if c != text_col])  # one column, so that no name of it can meet one of ours
    rows = df.select(exact(id_col).cast("long").alias("id"), F.xxhash64(exact(text_col)).alias("hash"), exact(text_col).alias("text"), others.alias("others")).alias("r")
    rows = rows.join(lost.alias("l").hint("shuffle_hash"), (F.col("r.id") == F.col("l.doc_id")) & (F.col("r.hash") == F.col("l.text_hash")), "left").select("r.text", "r.others", "l.places")

    def rewrite(batches):
        for table in blocks(batches):
            block = Block(table["text"])
            starts, ends, doc = block.words()
            count = np.bincount(doc, minlength=block.n)
            first = np.concatenate([[0], np.cumsum(count)])
            lists = table["places"].combine_chunks()
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            at = np.asarray(lists.flatten()).astype(np.int64) + np.repeat(first[:-1], sizes)
            depth = np.bincount(at, minlength=len(starts) + 1) - np.bincount(at + window, minlength=len(starts) + 1)[: len(starts) + 1]
            keep = np.cumsum(depth)[: len(starts)] == 0
            data, _, word_ends = joined(block.data, starts[keep], ends[keep])
            kept = np.bincount(doc[keep], minlength=block.n)
            after = np.cumsum(kept)
            text_ends = np.where(kept > 0, word_ends[np.maximum(after - 1, 0)], 0) if len(word_ends) else np.zeros(block.n, np.int64)
            text_starts = np.where(after - kept > 0, word_ends[np.maximum(after - kept - 1, 0)] + 1, 0) if len(word_ends) else np.zeros(block.n, np.int64)
            texts = spans_to_strings(data, np.where(kept > 0, text_starts, 0), np.where(kept > 0, text_ends, 0))
            new = [texts.cast(pa.string()), table["others"].combine_chunks(), pa.array(count.astype(np.int64)), pa.array((count - kept).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(new, names=["text", "others", "n_words", "n_removed"])

    schema = StructType([StructField("text", StringType()), rows.schema["others"], StructField("n_words", LongType()), StructField("n_removed", LongType())])
    out = rows.mapInArrow(rewrite, schema)
    return out.select(*[(F.col("text") if c == text_col else F.col("others").getField(c)).alias(c) for c in columns], "n_words", "n_removed")
