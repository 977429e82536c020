"""One key holds a third of the rows: its join partition must be split, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedupe, merge

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n=30_000):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    return spark.range(0, n, 1, 8).select(F.col("id").alias("row_id"), key.alias("name"), F.md5(F.col("id").cast("string")).alias("pad"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    out = df.select("*")
    out.collect()
    return out._jdf.queryExecution().executedPlan().toString()


def test_group_members_are_split(tight):
    groups = dedupe.detect_by_column(hot(tight), "row_id", "name")
    assert "skew=true" in final_plan(groups)
    sizes = {r["key"]: r["n"] for r in groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes["hot"] == 10_000 and sum(sizes.values()) == 30_000


def test_outer_join_is_split(tight):
    left = hot(tight).select(F.col("name").alias("k"), F.col("row_id").alias("a"), "pad")
    right = tight.range(0, 40).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("b"))
    joined = merge.merge(left, right, "k", "outer")
    assert "skew=true" in final_plan(joined)
    turned = merge.merge(right, left, "k", "outer")
    assert "skew=true" in final_plan(turned)
    assert joined.count() == turned.count() == 30_000
