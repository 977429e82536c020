"""Stream state with a watermark, and quantile sketches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ordering, profile, validate
from ledgerloom.streaming import live

DAY = dt.datetime(2024, 1, 1)
KIND = "id long, at timestamp, rows string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def refreshed(spark, tmp_path, delay="2 days"):
    stream = live.stream_delimited(spark, str(tmp_path / "in"), spark.createDataFrame([], KIND).schema, "parquet", 1)
    running = live.bounded_summary(stream, "at", delay, str(tmp_path / "state"), str(tmp_path / "ck"))
    running.awaitTermination()
    return running, live.current_summary(spark, str(tmp_path / "state"), 3).first()


def test_state_is_bounded_and_counts_are_exact_within_the_delay(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    sent, kept = [], []
    for day in range(12):
        rows = [(100 * day + i, DAY + dt.timedelta(days=day, minutes=i), None if i % 5 == 0 else "x") for i in range(50)]
        late = [r for r in sent if r[1] >= DAY + dt.timedelta(days=day - 1)][:20]  # copies from the day before
        sent += rows + late + rows[:3]
        arrive(spark, str(tmp_path / "in"), rows + late + rows[:3])
        running, found = refreshed(spark, tmp_path)
        kept.append(sum(s["numRowsTotal"] for s in running.lastProgress["stateOperators"]))
        assert (found.total_rows, found.unique_rows) == (len(sent), len(set(sent)))
        assert found.missing_values == sum(v is None for r in sent for v in r)
    assert max(kept) <= 50 * 5 and len(set(sent)) == 600


def test_rows_without_a_time_a_replay_and_an_expired_copy(spark, tmp_path):
    rows = [(1, DAY, "a"), (1, DAY, "a"), (2, None, "a"), (2, None, "a"), (3, None, None)]
    arrive(spark, str(tmp_path / "in"), rows)
    _, first = refreshed(spark, tmp_path)
    assert (first.total_rows, first.unique_rows, first.missing_values) == (5, 4, 4)
    _, again = refreshed(spark, tmp_path)  # nothing new: the source goes on from its checkpoint
    assert again == first
    arrive(spark, str(tmp_path / "in"), [(9, DAY + dt.timedelta(days=30), "b")])
    refreshed(spark, tmp_path)
    arrive(spark, str(tmp_path / "in"), [(1, DAY, "a"), (9, DAY + dt.timedelta(days=30), "b")])
    _, last = refreshed(spark, tmp_path)
    assert (last.total_rows, last.unique_rows) == (8, 5), "a row behind the watermark counts as a copy"


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_sketches_keep_their_rank_error(spark, accuracy):
    rng = np.random.default_rng(4)
    values = {"a": rng.lognormal(size=20000).round(3), "b": rng.integers(0, 30, 5000).astype(float), None: np.array([7.0, 7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("z", None)], "g string, v double").repartition(7)
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = {r.g: r for r in ordering.group_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
    assert found.keys() == values.keys()
    for g, vs in values.items():
        vs = np.sort(vs)
        for name, p in probs.items():
            low, high = np.searchsorted(vs, found[g][name], "left"), np.searchsorted(vs, found[g][name], "right")
            slack = len(vs) / accuracy + 1
            assert found[g][name] in vs and low - slack <= p * len(vs) <= high + slack
    none = df.filter("g = 'z'")
    assert ordering.group_quantiles(none, [], "v", probs, accuracy=accuracy).count() == 0


def test_profiles_and_outliers_by_sketches(spark):
    df = spark.range(2000).select("id", (F.col("id") % 100).cast("double").alias("v")).union(spark.createDataFrame([(9999, 1e6)], "id long, v double"))
    exact, near = (profile.profile_column(df, "v", accuracy=a).first() for a in (None, 500))
    assert abs(exact.median - near.median) <= 1 and abs(exact.unique - near.unique) <= 5 and exact.max == near.max
    medians = [{r.column: r.value for r in profile.profile_all(df, a).filter("metric = 'median'").collect()} for a in (None, 500)]
    assert medians[0].keys() == medians[1].keys() and abs(medians[0]["v"] - medians[1]["v"]) <= 1
    assert [r.row for r in validate.outlier_issues(df, "id", 500).collect()] == [r.row for r in validate.outlier_issues(df, "id").collect()] == [9999]
