import math

import numpy as np
import pytest

from ledgerloom.llm import mtree, onebit

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA).repartition(3)


def clustered(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    x = centres[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, d))
    x[100:140] = x[100]
    return x.astype(np.float32)


def brute(ids, x, queries, k, scale=None):
    x = np.floor(scale * x.astype(np.float64)).astype(np.int64) if scale else x.astype(np.float64)
    out = {}
    for q in queries:
        scores = (x * x[list(ids).index(q)]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(ids[i], scores[i]) for i in order]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("d", [5, 64, 100])
def test_one_bit_search_finds_nearly_all(spark, d):
    x = clustered(3000, d)
    df = frame(spark, list(enumerate(x)))
    got = results(onebit.search(df, df.where("vec_id % 20 = 0"), k=20))
    want = brute(np.arange(3000), x, range(0, 3000, 20), 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.98 * 20 * len(want)
    for q, pairs in got.items():
        scores = dict(want[q])
        assert all(i not in scores or math.isclose(s, scores[i], rel_tol=1e-12) for i, s in pairs)
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))


def test_one_bit_estimates_lie_within_their_bounds():
    x = clustered(500, 64, 3).astype(np.float64)
    turn = onebit.rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    estimate, error = onebit.estimates(x[:50], *onebit.codes(x, turn), turn, 2.5)
    assert (np.abs(estimate - x[:50] @ x.T) <= error).mean() > 0.98


@pytest.mark.parametrize("d", [3, 64])
def test_tree_search_is_exact(spark, d):
    x = clustered(3000, d, 5)
    df = frame(spark, list(enumerate(x)))
    got = results(mtree.search(df, df.where("vec_id % 100 = 0"), k=10))
    assert got == {q: [(int(i), int(s)) for i, s in v] for q, v in brute(np.arange(3000), x, range(0, 3000, 100), 10, 1024).items()}


def test_tree_avoids_distances():
    x = np.floor(1024 * clustered(4000, 4, 7)).astype(np.float64)
    tree = mtree.Tree(mtree.build(np.arange(4000), x, 0), 4)
    for own in range(0, 4000, 100):
        tree.search(own, x[own], 10)
    assert tree.computed < 0.5 * 40 * 4000


def test_tree_holds_every_row_inside_its_radii():
    x = np.floor(1024 * clustered(2000, 8, 7)).astype(np.float64)
    tree = mtree.Tree(mtree.build(np.arange(2000), x, 0), 8)

    def below(number):
        leaf, members, vectors, radii, to_parent = tree.pages[number]
        if leaf:
            return list(zip(members.tolist(), vectors, strict=True))
        rows = []
        for child, routing, radius in zip(members.tolist(), vectors, radii, strict=True):
            own = below(child)
            assert max(math.dist(v, routing) for _, v in own) <= radius + 1e-9
            assert np.allclose(tree.pages[child][4], [math.dist(v, routing) for v in tree.pages[child][2]])
            rows += own
        return rows

    assert sorted(i for i, _ in below(0)) == list(range(2000))


ODD = [(0, [1, 0]), (1, [1, 0]), (2, None), (3, [math.nan, 1]), (4, [None, 1]), (5, [math.inf, 1]), (6, [0, 0]), (7, [1, 2, 3]), (8, []), (None, [1, 1]), (100, [0.5, 0.5]), (100, [0.5, 0.5]), (9, [-1, 0])]


def test_odd_rows(spark):
    df = frame(spark, ODD)
    queries = df.where("vec_id % 20 = 0")
    assert results(onebit.search(df, queries, k=3)) == {0: [(1, 1.0), (100, 0.5), (9, -1.0)], 100: [(0, 0.5), (1, 0.5), (9, -0.5)]}
    got = results(mtree.search(df, queries, k=3))
    assert got == {0: [(1, 1024**2), (100, 512 * 1024), (6, 0)], 100: [(0, 512 * 1024), (1, 512 * 1024), (6, 0)]}


def test_no_rows(spark):
    df = frame(spark, [])
    assert onebit.search(df, df).count() == 0 and mtree.search(df, df).count() == 0
    one = frame(spark, [(0, [1, 2])])
    assert onebit.search(one, one).count() == 0 and mtree.search(one, one).count() == 0


def test_large_components_stay_exact(spark):
    x = [(0, [3e9, 1.0]), (1, [3e9 + 1, 2.0]), (2, [3e9 + 1, 1.0]), (100, [-3e9, 5.0])]
    df = spark.createDataFrame([(i, v) for i, v in x], "vec_id long, embedding array<double>")
    got = results(mtree.search(df, df.where("vec_id = 0"), k=3, scale=1.0))
    assert got[0] == sorted([(i, int(v[0]) * 3 * 10**9 + int(v[1])) for i, v in x[1:]], key=lambda p: (-p[1], p[0]))


def test_huge_components_are_clipped(spark):
    big = [[1e8, -1e8], [1e8, 1e8], [-1e8, 1e8], [1e60, 0.0], [1e150, 1.0], [3.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in mtree.search(df, df, k=9).collect()}
    used = [i for i in range(6) if i != 4]
    whole = [[int(x * 1024) for x in v] for v in big]
    want = {(a, b): max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[a], whole[b])))) for a in used for b in used if a != b}
    assert got == want
