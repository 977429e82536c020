import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, MapType, StringType, StructType

from ledgerloom.llm import repeats
from ledgerloom.llm.common import WORD, Block


def brute(rows, k):
    words = [re.findall(WORD, t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - k + 1):
            if d is not None:
                least[tuple(w[i : i + k])] = min(least.get(tuple(w[i : i + k]), d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((str(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "ß日"]
    passages = [rng.choices(words, k=rng.choice([13, 14, 30, 90])) for _ in range(6)]
    rows = []
    for _ in range(80):
        text = rng.choices(words, k=rng.choice([0, 3, 20, 120]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        rows.append(rng.choice([" ", "\n", " \t "]).join(text))
    rows += ["", None, "the end " * 400, "the end " * 300, "Same Text Here " * 9, "same text here " * 9, " ".join(passages[0]), "x " * 13 + "y", "x " * 20000]
    rng.shuffle(rows)
    return list(zip(rng.sample(range(1000), len(rows)), rows, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "clash", 2) for d, t in rows], "doc_id long, text string, n_words int, key string, start int").repartition(4)


def results(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in df.collect())


@pytest.mark.parametrize(("seed", "window", "hot", "bits"), [(1, 13, 256, 1 << 27), (2, 13, 1, 1 << 27), (3, 5, 256, 1 << 12), (4, 3, 2, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, seed, window, hot, bits):
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    monkeypatch.setattr(repeats, "FILTER_BITS", bits)
    rows = corpus(seed)
    out = repeats.remove_repeats(frame(spark, rows), window=window)
    assert out.columns == ["doc_id", "text", "key", "start", "n_words", "n_removed"]
    assert results(out) == brute(rows, window)


def test_repeated_and_null_ids_and_no_rows(spark):
    text = " ".join(f"a{i}" for i in range(15))
    rows = [(5, text), (5, text), (5, text + " more"), (None, text), (9, text), (None, None), (3, None), (4, "short one")]
    assert results(repeats.remove_repeats(frame(spark, rows))) == brute(rows, 13)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_runs_hold_every_window_once():
    texts = [t for _, t in corpus(5)]
    block = Block(pa.array(texts))
    runs = repeats.SuperKmers(block, 13)
    counts = np.bincount(runs.doc, weights=runs.windows, minlength=block.n)
    assert counts.tolist() == [max(len(re.findall(WORD, t or "")) - 12, 0) for t in texts]
    assert runs.windows.mean() > 3


@pytest.mark.parametrize("name", ["_id", "_hash", "_places", "places", "others", "id", "hash", "N_words", "a.b", "a b", "back`tick"])
def test_columns_of_any_name(spark, name):
    rows = corpus(6)[:30]
    frame = spark.createDataFrame([(d, t, {"x": 1}, (7,)) for d, t in rows], StructType().add("doc_id", "long").add("text", "string").add(name, MapType(StringType(), LongType())).add("s", StructType().add("a b.c", "integer")))
    out = repeats.remove_repeats(frame.repartition(2), window=5)
    assert out.columns == [*["doc_id", "text"], *([name] if name != "N_words" else []), "s", "n_words", "n_removed"]
    assert results(out) == brute(rows, 5) and {tuple(r.s) for r in out.collect()} == {(7,)}
