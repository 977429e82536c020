"""The Spark side of near-duplicate detection: classes of equal sets, buckets, blocks, verified links, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, settle, small_batches, to_arrow, whole_groups
from .components import components
from .minhash import BINS, bands, digest, shingles, sketch

BUCKET_BLOCK = 512
_MISS, _DEVIATIONS = 1e-6, 6.0


def band_rows(similarity: float) -> int:
    """The most rows a band may have for a pair of just this similarity to miss all bands less than once in a million."""
    return max(r for r in range(1, 9) if r == 1 or (1 - similarity**r) ** (BINS // r) < _MISS)


def least_agreement(similarity: float) -> int:
    """Coordinates that agree in any pair of this similarity, but for six standard deviations."""
    return int(BINS * similarity - _DEVIATIONS * np.sqrt(BINS * similarity * (1 - similarity)))


def _sketches(df: DataFrame, size: int, rows: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for table in blocks(batches):
            block = Block(table["text"], lower=True)
            members, off = shingles(block, size)
            coordinates = sketch(members, off)
            n, low, key = np.diff(off), (coordinates & np.uint64(255)).astype(np.uint8), bands(coordinates, rows)
            yield to_arrow(schema, {
                "doc_id": table["doc_id"].combine_chunks(), "text_hash": table["text_hash"].combine_chunks(), "n_shingles": n,
                "digest": [digest(members[off[i] : off[i + 1]]) if n[i] else None for i in range(block.n)],
                "sketch": [low[i].tobytes() if n[i] else None for i in range(block.n)], "bands": [key[i] if n[i] else None for i in range(block.n)],
            })

    return df.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary, bands array<long>")


def _plausible(bucket: pa.Table, percent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one block of a bucket that may be similar enough, as places in it, judged by sizes and sketches.

    A pair is left to the first band whose key it shares, so no pair is looked at twice.
    ``before`` has each member's keys of all earlier bands: coordinates of the sketch
    may agree by chance in a band where the pair never met.
    """
    n, own, band = (bucket[c].to_numpy() for c in ("n", "own", "band"))
    s = np.frombuffer(b"".join(bucket["sketch"].to_pylist()), np.uint8).reshape(len(n), BINS)
    before = pc.list_flatten(bucket["before"]).to_numpy().reshape(len(n), int(band[0]))
    left, right = [], []
    for i in range(len(n)):
        other = np.flatnonzero((own[i] != own[i + 1 :]) | (bucket["i"][0].as_py() == bucket["j"][0].as_py())) + i + 1
        other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
        if not len(other):
            continue
        same = s[other] == s[i]
        fits = same.sum(axis=1) >= least
        fits &= ~(before[other] == before[i]).any(axis=1)
        left.append(np.full(int(fits.sum()), i))
        right.append(other[fits])
    return (np.concatenate(left), np.concatenate(right), n) if left else (np.zeros(0, int), np.zeros(0, int), n)


def _links(sets: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs those whose full sets are similar enough; a pair that others have already joined is left out."""
    root, out = list(range(len(off) - 1)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.unique(left).tolist():
        partners = right[left == i]
        partners = partners[[find(p) != find(i) for p in partners.tolist()]]
        if not len(partners):
            continue
        mine = sets[off[i] : off[i + 1]]
        sizes = off[partners + 1] - off[partners]
        flat = np.concatenate([sets[off[p] : off[p + 1]] for p in partners.tolist()])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        for p in partners[100 * shared >= percent * (sizes + len(mine) - shared)].tolist():
            if find(p) != find(i):
                root[find(p)] = find(i)
                out.append((i, p))
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """Documents linked by ``100 * intersection >= percent * union`` of their distinct ``size``-word shingles, and what they reach.

    Documents of equal sets are one class from the start, however many they are.
    Each class has a sketch, whose bands deal it into buckets. A bucket of many
    classes is cut into blocks, and each pair of blocks is a task of bounded size.
    There, sizes and sketches leave the pairs that may qualify; these are checked
    on their full sets, and a task returns no more links than a forest needs. So
    no pairs of a group are written out, and none of its links is capped.

    A row per input row: doc_id, n_shingles, component_id (smallest id reachable),
    kept. Null and empty texts, or texts without words, have no shingles, are
    linked with nothing and kept. Repeated rows are copies of one another; a null
    id is never the smallest one unless no other is reachable. No rows give no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows, least = band_rows(percent / 100), least_agreement(percent / 100)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketched = settle(_sketches(docs, size, rows).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    classes = settle(sketched.where("n_shingles > 0").groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("low")), "classes")
    nodes = sketched.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")
    dealt = nodes.select("uid", F.posexplode("bands").alias("band", "key"))
    shared = dealt.groupBy("key", "band").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / BUCKET_BLOCK).cast("int")
    members = dealt.join(shared, ["key", "band"]).join(nodes.select("uid", F.col("n_shingles").alias("n"), "sketch", "bands"), "uid")
    members = members.withColumn("before", F.slice("bands", F.lit(1), F.col("band")))
    members = members.withColumn("own", F.pmod(F.xxhash64("uid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    members = members.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "n", "sketch", "before")
    task = ["key", "band", "i", "j"]

    def compare(batches):
        schema = pa.schema([("task", pa.int64()), ("nodes", pa.list_(pa.int64())), ("pairs", pa.binary())])
        for table in whole_groups(batches, task):
            edges = _group_edges(table, task)
            out: dict[str, list] = {"task": [], "nodes": [], "pairs": []}
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                bucket = table.slice(begin, end - begin)
                left, right, _ = _plausible(bucket, percent, least)
                if len(left):
                    used, places = np.unique(np.concatenate([left, right]), return_inverse=True)
                    out["task"].append(0)
                    out["nodes"].append(bucket["uid"].to_numpy()[used])
                    out["pairs"].append(places.astype("<i4").tobytes())
            yield to_arrow(schema, out)

    compared = members.repartition(*task).sortWithinPartitions(*task, "uid").mapInArrow(compare, "task long, nodes array<long>, pairs binary")
    compared = settle(compared.withColumn("task", F.monotonically_increasing_id()), "pairs")
    asked = compared.select("task", F.posexplode("nodes").alias("place", "node"))
    wanted = sketched.join(asked.select(F.col("node").alias("uid")).distinct(), "uid", "left_semi").select(F.col("uid").alias("node"), "doc_id", "text_hash")
    texts = wanted.alias("w").join(docs.alias("d"), (F.col("w.text_hash") == F.col("d.text_hash")) & F.col("w.doc_id").eqNullSafe(F.col("d.doc_id")))
    texts = texts.select("node", "text").dropDuplicates(["node"])

    def full_sets(batches):
        schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])
        for table in blocks(batches):
            block = Block(table["text"], lower=True)
            sets, off = shingles(block, size)
            yield to_arrow(schema, {"node": table["node"].combine_chunks(), "members": [sets[off[i] : off[i + 1]].tobytes() for i in range(block.n)]})

    sets = texts.mapInArrow(full_sets, "node long, members binary")
    work = asked.join(sets, "node").select("task", "place", "node", "members")
    work = work.union(compared.select("task", F.lit(-1), F.lit(None).cast("long"), "pairs"))

    def verify(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for table in whole_groups(batches, ["task"], 256):
            edges = _group_edges(table, ["task"])
            found: list[tuple[int, int]] = []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                group = table.slice(begin, end - begin)
                raw = group["members"].to_pylist()
                left, right = np.frombuffer(raw[0], "<i4").reshape(2, -1)
                off = np.concatenate([[0], np.cumsum([len(m) // 8 for m in raw[1:]])])
                ids = group["node"].slice(1).to_pylist()
                found += [(ids[a], ids[b]) for a, b in _links(np.frombuffer(b"".join(raw[1:]), np.uint64), off, left, right, percent)]
            yield to_arrow(schema, {"a": [f[0] for f in found], "b": [f[1] for f in found]})

    links = work.repartition("task").sortWithinPartitions("task", "place").mapInArrow(verify, "a long, b long")
    reached = components(links)
    rooted = classes.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = reached.join(classes, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root", "left").select("digest", F.coalesce("component_id", "low").alias("component_id"), F.lit(True).alias("member"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("member"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _group_edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for key in keys:
        column = table[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), len(table))
