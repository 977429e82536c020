import random

import pytest

from ledgerloom.operators import dedupe, graph


def greedy(edges):
    """Nodes in order; each one not yet taken takes its later neighbours."""
    near = {}
    for lo, hi, score in edges:
        near.setdefault(lo, []).append((hi, score))
    taken = {}
    for lo in sorted({n for e in edges for n in e[:2]}):
        if lo not in taken:
            for hi, score in near.get(lo, []):
                taken.setdefault(hi, (lo, score))
    return taken


@pytest.mark.parametrize("quick,most", [(0, 1 << 20), (0, 3), (2, 1 << 20), (4, 5)])
def test_same_as_one_by_one(spark, monkeypatch, quick, most):
    monkeypatch.setattr(dedupe, "QUICK_ROUNDS", quick)
    monkeypatch.setattr(dedupe, "GROUP_EDGES", most)
    rng = random.Random(quick)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(55)} | {(100 + i, 101 + i) for i in range(12)}
    edges = [(a, b, float(90 + (a + b) % 10)) for a, b in pairs]
    got = dedupe.elect_leaders(spark.createDataFrame(edges, "lo long, hi long, score double")).collect()
    assert {r.follower: (r.leader, r.score) for r in got} == greedy(edges) and len(got) == len(greedy(edges))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    inner = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append("component") or inner(df))
    step = dedupe._round
    monkeypatch.setattr(dedupe, "_round", lambda active: rounds.append("leader") or step(active))
    n = 10_000
    edges = spark.range(n).selectExpr("id lo", "id + 1 hi", "95.0D score")
    got = dedupe.elect_leaders(edges)
    assert got.count() == n // 2 and got.where("follower <> leader + 1 or leader % 2 = 1").count() == 0
    assert len(rounds) <= 20, rounds


def test_components_of_any_shape(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)] + [(20, i) for i in range(21, 60)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "lo long, hi long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {i: 20 for i in range(20, 60)} | {i: 100 for i in range(100, 141)}
    assert graph.components(spark.createDataFrame([], "lo long, hi long")).count() == 0
