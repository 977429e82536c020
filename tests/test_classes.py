"""Near matches as classes, tables kept in order, quantiles against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import crossfile, ordering, profile, query, schema_map


def records(spark, data):
    frame = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(data)], "row_id int, Name string, Email string")
    return schema_map.canonical_records([schema_map.Sheet(frame, ["row_id"], "f.csv")])


def test_classes_hold_all_pairs(spark):
    rng = random.Random(3)
    base = ["acme trading", "acme tradin", "Acme Trading", "ACME-TRADING", "northern lights", "norther lights", "zeta", "---", "--- ", "***", "Zeta!", None, ""]
    source = records(spark, [(rng.choice(base), rng.choice([f"{i // 3}@x.com", f"{i}@y.com"])) for i in range(80)])
    near = crossfile.near_classes(source)
    pairs = crossfile.near_matches(source, classes=near).cache()
    window = crossfile.near_matches(source, window=1000)
    key = ("ord_a", "ord_b", "match_level", "confidence", "reason")
    assert sorted(pairs.select(*key).collect()) == sorted(window.select(*key).collect()) and pairs.count() > 150
    by_level = {r.match_level: r.n for r in pairs.groupBy("match_level").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.match_level: int(r.n) for r in near.links.groupBy("match_level").agg(F.sum("pairs").alias("n")).collect()} == by_level
    both = pairs.select("ord_a", "match_level").unionAll(pairs.select("ord_b", "match_level")).toDF("ord", "level")
    want = {(r.ord, r.level): r.n for r in both.groupBy("ord", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = {"high_partners": crossfile.NEAR_LEVEL, "possible_partners": crossfile.POSSIBLE_LEVEL, "similar_partners": crossfile.SIMILAR_LEVEL}
    got = {(r.ord, level): r[c] for r in near.per_record().collect() for c, level in names.items() if r[c]}
    assert got == want
    conflicts = crossfile.match_conflicts(pairs)
    assert near.conflicts().agg(F.sum("pairs")).head()[0] == conflicts.count() > 0
    exact, missing = crossfile.exact_matches(source), source.select("ord").limit(0)
    a = crossfile.class_summary(source, exact, near, missing, 1, 1).head().asDict()
    assert a == crossfile.cross_summary(source, exact, pairs, conflicts, missing, 1, 1).head().asDict()


def test_a_hot_name_stays_linear(spark):
    m = 30_000
    data = spark.range(3 * m).select(
        (F.col("id") + 1).alias("row_id"), F.concat(F.col("id"), F.lit("@x.com")).alias("Email"),
        F.when(F.col("id") < m, F.lit("Acme Trading")).when(F.col("id") % 1000 == 0, F.col("id").cast("string")).alias("Name"),
    )
    source = schema_map.canonical_records([schema_map.Sheet(data.select("row_id", "Name", "Email"), ["row_id"], "f.csv")])
    near = crossfile.near_classes(source)
    hot = near.links.filter(F.col("key_a") == "Acme Trading").collect()
    assert [(r.match_level, int(r.pairs)) for r in hot] == [(crossfile.POSSIBLE_LEVEL, m * (m - 1) // 2)]
    assert near.links.count() < 1_000
    clash = near.conflicts().collect()
    assert [(r["values"], r.records, int(r.pairs)) for r in clash] == [(m, m, m * (m - 1) // 2)]


def test_classes_of_no_records(spark):
    none = records(spark, [("a", "b")]).limit(0)
    near = crossfile.near_classes(none)
    assert near.links.count() == near.per_record().count() == near.expand().count() == near.conflicts().count() == 0
    row = crossfile.class_summary(none, crossfile.exact_matches(none), near, none, 0, 0).head()
    assert row.similar_records == row.possible_matches == row.unique_records == row.conflicting_records == 0


def test_stored_pages(spark, tmp_path):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k"), F.lit("x").alias("a b.c"), (F.col("id") % 3).alias("t"))
    table = query.PagedTable.store(df, ["k"], str(tmp_path / "t"), rows_per_file=1_000)
    again = query.PagedTable(spark, table.path)
    for number in (0, 57, 399):
        page = again.page(number, 50)
        assert [r.k for r in page.collect()] == list(range(number * 50, number * 50 + 50))
        hit = spark.read.parquet(f"{table.path}/counts").filter((F.col("start") < number * 50 + 50) & (F.col("start") + F.col("n") > number * 50))
        assert hit.agg(F.sum("n")).head()[0] <= 3_000
        # The scan is pruned to the files of those rows.
        assert re.search(r"PartitionFilters: \[[^\]]*_paged_file", page._jdf.queryExecution().toString())
    assert again.page(400, 50).count() == 0 and again.page(0, 30_000).count() == 20_000
    ties = query.PagedTable.store(df, ["t"], rows_per_file=5_000)
    seen = [r.k for n in range(2) for r in ties.page(n, 10_000).collect()]
    assert sorted(seen) == list(range(20_000))
    assert query.PagedTable.store(df.limit(0), ["k"]).page(0, 10).count() == 0
    with pytest.raises(ValueError):
        query.PagedTable.store(df.withColumn("_Paged_Place", F.lit(1)), ["k"])


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_of_many_groups(spark, method):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, -0.5, rng.randint(0, 40) / 4, rng.random()])) for _ in range(3_000)] + [("one", 2.0), ("nil", None)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p99": 0.99, "hi": 1.0}
    got = {r.g: r for r in ordering.group_quantiles(df, ["g"], "v", probs, method=method, distinct="d").collect()}
    groups = {g: sorted(v for h, v in data if h == g and v is not None) for g, _ in data}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, row in got.items():
        v = groups[g]
        assert row.d == len(set(v))
        for name, p in probs.items():
            place = p * (len(v) - 1)
            low = int(place)
            want = v[int(place + 0.5)] if method == "nearest" else v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (place - low)
            assert row[name] == pytest.approx(want, abs=1e-12)


def test_kpis_of_repeated_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "x", None), (None, "x", [1])], "i int, s string, a array<int>")
    row = profile.summarise({"a": df, "empty": df.limit(0)}).head()
    assert (row.total_rows, row.unique_rows, row.duplicate_rows, row.missing_values, row.columns_profiled) == (4, 3, 1, 6, 6)
