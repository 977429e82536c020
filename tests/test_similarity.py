import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scoring
from ledgerloom.operators import similarity as sim
from tests import slow_scores as slow


def columns(spark, scorer, pairs):
    """Scores of pairs by the column expressions."""
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, vl string, vr string").coalesce(2)
    for side in "lr":
        df = df.select("*", *[c.alias(f"{name}_{side}") for name, c in zip(scoring.FORMS, scoring.forms(F.col(f"v{side}")))])
    score = scoring.score(scorer, 0.0, *[F.col(c) for c in ("vl", "vr", "sorted_l", "sorted_r", "unique_l", "unique_r")])
    return [r.s for r in df.select("i", score.alias("s")).orderBy("i").collect()]


def test_hand_scores(spark):
    one = lambda name, a, b: columns(spark, name, [(a, b)])[0]
    assert one("ratio", "abc", "abd") == pytest.approx(200 * 2 / 6)
    assert one("token_sort", "new york mets", "mets york new") == 100.0
    assert one("token_set", "new york mets", "the new york mets of queens") == 100.0
    assert one("partial", "york", "new york mets") == 100.0
    assert one("weighted_ratio", "york", "new york mets") == pytest.approx(90.0)
    assert one("weighted_ratio", "new york mets", "mets new york") == pytest.approx(95.0)
    assert one("ratio", "fuzzy wuzzy was", "wuzzy fuzzy was") == pytest.approx(200 * slow.lcs("fuzzy wuzzy was", "wuzzy fuzzy was") / 30)


@pytest.mark.parametrize("scorer", scoring.SCORERS)
def test_columns_match_slow_forms(spark, scorer):
    rng = random.Random(11)
    make = lambda: "".join(rng.choice("abc dé𝒳") for _ in range(rng.choice([0, 1, 3, 9, 30, 64, 65, 90])))
    pairs = [(make(), make()) for _ in range(150)] + list(zip(corpus(8, 150), corpus(9, 150))) + [("", ""), ("", "a"), (" ", ""), (" a ", "a"), ("a a b", "b a"), ("x", "x" * 20)]
    assert columns(spark, scorer, pairs) == pytest.approx([slow.SCORERS[scorer](x, y) for x, y in pairs])
    assert columns(spark, scorer, [(None, "a"), ("a", None)]) in ([None, None], [0.0, 0.0])


def test_batches_match_slow_forms(monkeypatch):
    rng = random.Random(7)
    make = lambda: "".join(rng.choice("abc dé𝒳\0") for _ in range(rng.choice([0, 1, 3, 9, 40, 64, 65, 130])))
    a, b = [make() for _ in range(300)], [make() for _ in range(300)]
    assert list(scoring.lcs(a, b)) == [slow.lcs(x, y) for x, y in zip(a, b)]
    for cells in (1 << 19, 64):
        monkeypatch.setattr(scoring, "_CELLS", cells)
        assert list(scoring.window_ratios(a[:90], b[:90])) == pytest.approx([slow.partial(x, y) for x, y in zip(a[:90], b[:90])])
    got = scoring.window_ratios(a[:90], b[:90], 70.0)
    assert all(g == pytest.approx(s) for g, s in zip(got, map(slow.partial, a[:90], b[:90])) if s >= 70)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["acme", "global", "tools", "trade", "co", "of", "a", "north", "ab", "stone", "bbbb", "ltd", "x"]
    out = []
    for _ in range(n):
        s = " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randint(0, len(s))
            s = s[:i] + rng.choice("abcx ") + s[i + rng.choice([0, 1]) :]
        out.append(s if rng.random() > 0.05 else rng.choice(["aaaa", "", " ", "aaab", " ab"]))
    return out


@pytest.mark.parametrize("scorer,threshold", [
    ("ratio", 88.0), ("ratio", 60.0), ("token_sort", 80.0), ("token_set", 90.0), ("token_set", 45.0),
    ("partial", 85.0), ("partial", 97.0), ("weighted_ratio", 88.0), ("weighted_ratio", 75.0), ("quick_ratio", 92.0), ("weighted_ratio", 50.0),
])
def test_no_pair_is_lost(spark, scorer, threshold):
    left, right = corpus(1, 90), corpus(2, 90)
    l = spark.createDataFrame([(v,) for v in left], "v string")
    r = spark.createDataFrame([(v,) for v in right], "v string")
    got = {(x.left_value, x.right_value) for x in sim.similarity_join(l, r, "v", "v", scorer, threshold).collect()}
    pairs = [(x, y) for x in sorted(set(left)) for y in sorted(set(right))]
    want = [slow.SCORERS[scorer](x, y) for x, y in pairs]
    assert got == {p for p, s in zip(pairs, want) if s >= threshold}


def test_self_pairs(spark):
    values = corpus(3, 120)
    df = sim.distinct_values(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    got = [frozenset((x.vl, x.vr)) for x in sim.value_pairs(df, None, "weighted_ratio", 80.0).collect()]
    distinct = sorted(set(values))
    pairs = [(x, y) for i, x in enumerate(distinct) for y in distinct[i + 1 :]]
    want = [slow.weighted_ratio(x, y) for x, y in pairs]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset(p) for p, s in zip(pairs, want) if s >= 80.0}


def test_top_and_best(spark):
    n = spark.createDataFrame([("acme tools",), ("zzz",)], "v string")
    h = spark.createDataFrame([("acme tools",), ("acme tool",), ("acme toolz",), ("other",)], "v string")
    best = sim.best_match(n, h, "v", "v").collect()
    assert [(b.left_value, b.right_value, b.score) for b in best] == [("acme tools", "acme tools", 100.0)]
    top = sim.top_matches(n, h, "v", "v", k=2).collect()
    assert len(top) == 2 and max(t.score for t in top) == 100.0


@pytest.mark.parametrize("threshold", [30.0, 50.0, 100.0])
def test_set_joins(spark, threshold):
    left, right = corpus(5, 80) + ["---", "!"], corpus(6, 80) + ["??"]
    l = spark.createDataFrame([(v,) for v in left], "v string")
    r = spark.createDataFrame([(v,) for v in right], "v string")

    import re

    def words(s):
        return set(re.sub(r"[^a-z0-9]+", " ", s.lower()).split())

    def grams(s):
        s = f"  {s.lower()}  "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    for fn, to_set in ((sim.jaccard_join, words), (sim.ngram_join, grams)):
        got = {(x.left_value, x.right_value): x.score for x in fn(l, r, "v", "v", threshold=threshold).collect()}
        want = {}
        for x in set(left):
            for y in set(right):
                a, b = to_set(x), to_set(y)
                s = 100.0 if not a and not b else 100.0 * len(a & b) / len(a | b)
                if s >= threshold:
                    want[x, y] = s
        assert got == pytest.approx(want)


def test_phonetic(spark):
    l = spark.createDataFrame([("Robert",), ("Smith",)], "v string")
    r = spark.createDataFrame([("Rupert",), ("Smyth",), ("Jones",)], "v string")
    got = {(x.side, x.value, x.partners) for x in sim.phonetic_join(l, r, "v", "v").collect()}
    assert got == {("left", "Robert", 1), ("right", "Rupert", 1), ("left", "Smith", 1), ("right", "Smyth", 1)}


def test_texts_of_a_set_join_do_not_travel_with_candidates(spark, monkeypatch):
    """one table with itself: each pair of different values once until it is scored, on rare and on frequent grams."""
    meetings = []
    real = sim._meet
    monkeypatch.setattr(sim, "_meet", lambda l, r, fits: meetings.append((l.columns, real(l, r, fits))) or meetings[-1][1])
    monkeypatch.setattr(sim, "KNOWN", 5)
    texts = [f"{' '.join(sorted({w[:3] for w in t.lower().split()}))} x{i % 3} y{i}" for i, t in enumerate(corpus(9, 60))] + ["--", "!!", None, "a b c", "A b, c", "A b, c"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = {(x.left_value, x.right_value): (x.left_rows, x.right_rows, x.score) for x in sim.jaccard_join(df, df, "v", "v", 60.0).collect()}
    import re

    sets, want = {t: set(re.findall("[a-z0-9]+", t.lower())) for t in texts if t}, {}
    for x, a in sets.items():
        for y, b in sets.items():
            score = 100.0 * len(a & b) / len(a | b) if a | b else 100.0
            if score >= 60.0:
                want[x, y] = (texts.count(x), texts.count(y), pytest.approx(score))
    assert got == want and len(got) > len(sets)
    assert all("v" not in columns and "s" not in columns for columns, _ in meetings)
    pairs = [(r.kl, r.kr) for _, df in meetings for r in df.distinct().collect()]
    assert all(l < r for l, r in pairs) and len(pairs) == len(set(pairs))
