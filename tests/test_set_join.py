"""Set joins: what meets, and what travels."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.operators import similarity as sim


@pytest.mark.parametrize("threshold", [40.0, 70.0, 100.0])
def test_no_match_is_refused_and_few_others_pass(spark, monkeypatch, threshold):
    """bounds leave about the results, on large sets of one vocabulary, over many parts and small steps."""
    rng = np.random.default_rng(3)
    sets = []
    for i in range(150):
        base = rng.choice(1500, rng.integers(1, 700), replace=False)
        sets += [set(base)] + [set(base[rng.random(len(base)) > cut]) | set(rng.choice(1500, int(cut * len(base)))) for cut in (0.02, 0.1, 0.2)]
    texts = sorted({" ".join(f"w{x}" for x in sorted(s)) for s in sets})
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    monkeypatch.setattr(sim, "CELL_GRAMS", 4000)
    monkeypatch.setattr(sim, "_AT_ONCE", 1000)
    asked = []
    real = sim._set_pairs
    monkeypatch.setattr(sim, "_set_pairs", lambda *a: asked.append(real(*a)) or asked[-1])
    found = sim.jaccard_join(df, df, "v", "v", threshold)
    got = {(r.left_value, r.right_value) for r in found.collect()}
    words = {t: frozenset(t.split()) for t in texts}
    want = {(x, y) for x in texts for y in texts if 100.0 * len(words[x] & words[y]) / (len(words[x] | words[y]) or 1) >= threshold or not words[x] | words[y]}
    assert got == want
    if threshold >= 70:
        assert asked[0].count() <= 2 * len(want) and asked[0].count() < len(texts) ** 2 / 20
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in (300, 20))
    both = np.concatenate([a, b]), np.concatenate([a[:-3], b[2:]])
    maps = sim._sketch(np.repeat([0, 1], [len(x) for x in both]), np.concatenate(both), np.array([8, 8]))
    x, y = (np.frombuffer(m.as_py(), np.uint64) for m in maps)
    assert isinstance(maps, pa.BinaryArray) and 0 < np.bitwise_count(x ^ y).sum() <= 5
