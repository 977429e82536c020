import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import minhash, near
from ledgerloom.llm.common import WORD, Block, whole_groups
from ledgerloom.llm.components import components


def lowered(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def shingle_set(text, size):
    w = re.findall(WORD, lowered(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(lowest.get(find(i)) if sets[i] else d), d == (lowest.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(8):
        base = rng.choices(words, k=rng.choice([12, 60, 200]))
        for _ in range(n // 8):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own).capitalize())
    chain = rng.choices(words, k=100)
    for i in range(12):
        rows.append(" ".join([*chain[i * 2 :], *[f"x{k}" for k in range(i * 2)]]))
    rows += ["", None, " \t", "one", "One", "one two", "one two", "Ünique É", "ünique É", "the word " * 4000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 3, "x") for d, t in rows], "doc_id long, text string, digest string, node int, kept string").repartition(4)


def results(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


@pytest.mark.parametrize(("seed", "size", "percent", "block"), [(1, 3, 85, 512), (2, 5, 80, 512), (3, 3, 85, 3)])
def test_against_brute_force(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(near, "BUCKET_BLOCK", block)
    rows = corpus(seed)
    assert results(near.near_duplicates(frame(spark, rows), size=size, percent=percent)) == brute(rows, size, percent)


def test_repeated_and_null_ids_and_no_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "A b c d"), (None, "solo text here now"), (None, ""), (7, None)]
    assert results(near.near_duplicates(frame(spark, rows))) == brute(rows, 3, 85)
    assert near.near_duplicates(frame(spark, [])).count() == 0


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(0)
    sets, pairs = [], []
    for size in (1, 2, 5, 40, 300, 3000):
        for part in (0.0, 0.5, 0.9):
            a = rng.integers(1, 2**63, size).astype(np.uint64)
            b = np.concatenate([a[: int(size * part)], rng.integers(1, 2**63, size - int(size * part)).astype(np.uint64)])
            pairs.append((len(sets), len(sets) + 1, int(size * part) / (2 * size - int(size * part))))
            sets += [np.sort(a), np.sort(b)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = minhash.sketch(np.concatenate(sets), off)
    assert (s != minhash._EMPTY).all()
    for a, b, similarity in pairs:
        assert abs((s[a] == s[b]).mean() - similarity) < 0.2
    alone = [minhash.sketch(x, np.array([0, len(x)]))[0] for x in sets]
    assert all((alone[i] == s[i]).all() for i in range(len(sets)))


def test_shingles_are_the_distinct_word_runs():
    texts = [t for _, t in corpus(4)]
    members, off = minhash.shingles(Block(pa.array(texts), lower=True), 3)
    assert np.diff(off).tolist() == [len(shingle_set(t, 3)) for t in texts]


def test_bands_miss_less_than_one_in_a_million():
    assert [near.band_rows(p) for p in (0.8, 0.85, 0.95)] == [4, 5, 8]
    assert near.least_agreement(0.85) == 84


def test_pairs_at_the_threshold_are_compared_where_they_first_meet():
    rng, percent, rows, misses, again = np.random.default_rng(5), 85, near.band_rows(0.85), 0, 0
    least = near.least_agreement(0.85)
    for _ in range(10):
        a = rng.integers(0, 2**63, (20_000, minhash.BINS)).astype(np.uint64)
        b = np.where(rng.random(a.shape) < percent / 100, a, rng.integers(0, 2**63, a.shape).astype(np.uint64))
        keys = np.stack([minhash.bands(a, rows), minhash.bands(b, rows)], axis=1)
        low = np.stack([a, b], axis=1).astype(np.uint8)
        met = keys[:, 0] == keys[:, 1]
        first = np.where(met.any(axis=1), met.argmax(axis=1), -1)
        misses += int((first < 0).sum())

        def found(pairs, band):
            n = 2 * len(pairs)
            bucket = pa.table({
                "n": np.full(n, 100), "own": np.zeros(n, np.int32), "i": np.zeros(n, np.int32), "j": np.zeros(n, np.int32), "band": np.full(n, band, np.int32),
                "sketch": [x.tobytes() for x in low[pairs].reshape(n, -1)],  # noqa: B023
                "before": pa.array(list(keys[pairs][:, :, :band].reshape(n, band)), pa.list_(pa.int64())),  # noqa: B023
            })
            left, right, _ = near._plausible(bucket, percent, least)
            assert (left // 2 == right // 2).all()
            return len(left)

        for band in range(keys.shape[2]):
            here = np.flatnonzero(first == band)
            for begin in range(0, len(here), 64):
                pairs = here[begin : begin + 64]
                misses += len(pairs) - found(pairs, band)
            later = np.flatnonzero(met[:, band] & (first < band))[:64]
            if len(later):
                again += found(later, band)
    assert misses <= 3 and again == 0


def test_whole_groups_cuts_between_groups():
    keys = [1, 1, 2, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2])], names=["k"]) for i in range(0, 9, 2)]
    got = [t["k"].to_pylist() for t in whole_groups(iter(batches), ["k"], 2)]
    assert sum(got, []) == keys and all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False)) and len(got) > 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i != 150] + [(1000, i) for i in range(1001, 1050)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
