"""Positions and exact quantiles without a single-task sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted
from ..session import stable


def in_order(df: DataFrame, order_by: list) -> list[Column]:
    """Sort keys of ``order_by`` and a hash of the row, so that rows with equal keys may be split up."""
    order = [F.col(quoted(c)) if isinstance(c, str) else c for c in order_by]
    simple = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType))]
    return [*order, F.xxhash64(*[F.col(quoted(c)) for c in simple]) if simple else F.lit(0)]


def with_position(df: DataFrame, order_by: list, name: str = "pos", start: int = 0) -> DataFrame:
    """Add contiguous positions in the order of ``order_by``.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the number of rows in earlier partitions. The sorted rows are
    checkpointed, so that both the numbering and the shifts see the same split.
    Rows with equal keys are ordered by a hash, so that they may be split up.
    """
    order = in_order(df, order_by)
    sorted_rows = stable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", 33)
    local = F.col("_mid").bitwiseAND((1 << 33) - 1)
    # One row per partition: the window below and the broadcast are that small.
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    shift = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", shift.alias("_shift"))
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_shift") + local + F.lit(start))
        .drop("_mid", "_part", "_shift")
    )


def spread(*keys: str) -> Column:
    """Extra grouping column for aggregates that are joined back to rows on ``keys``.

    It follows from the keys, so groups stay the same, but the aggregate is then
    partitioned by more than the keys and the join shuffles both of its inputs. Only
    such joins have their hot partitions split at run time; without it the rows of
    a hot key would all pass through one task.
    """
    return F.pmod(F.xxhash64(*[F.col(quoted(k)) for k in keys]), F.lit(8)).alias("_spread")


def first_by(value: Column, order: Column, keep: Column) -> Column:
    """Value of the row that comes first in ``order`` among rows where ``keep`` holds."""
    return F.min_by(F.when(keep, value), F.when(keep, order))


def group_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
    distinct: str | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per group, one output column per entry of ``probs``.

    ``linear`` interpolates; ``nearest`` takes the value at ``floor(p(n-1) + 1/2)``.
    Values are reduced to (group, value, count) before anything is sorted, and
    ranks come from a range sort of that table, whatever its size; only the
    partitions that hold a wanted place are ranked row by row. ``distinct`` names a column for the number of values per group.

    With ``accuracy`` one aggregate of mergeable sketches takes the place of the
    sort: each result is a value of the group whose rank is at most ``n / accuracy``
    from ``p * n``, whatever ``method`` is, and ``distinct`` is an estimate too.
    """
    slim = df.select(*[F.col(quoted(g)) for g in groups], F.col(quoted(value)).cast("double").alias("_v"))
    slim = slim.filter(F.col("_v").isNotNull())
    if accuracy:
        found = F.percentile_approx("_v", [float(p) for p in probs.values()], accuracy)
        sketched = slim.groupBy(*[quoted(g) for g in groups]).agg(found.alias("_q"), *([F.approx_count_distinct("_v").alias(distinct)] if distinct else []))
        sketched = sketched.filter(F.col("_q").isNotNull())  # without groups there is a row even for no values
        picked = [F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
        return sketched.select(*[quoted(g) for g in groups], *picked, *([distinct] if distinct else []))
    one_group = not groups
    if one_group:
        slim = slim.withColumn("_g", F.lit(0))
        groups = ["_g"]
    freq = slim.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    keys = [F.col(quoted(g)) for g in groups]
    ranged = stable(freq.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    # One row per partition and group; a group lies in adjacent partitions.
    sizes = ranged.groupBy("_part", *groups).agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        "_part", *groups, "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"),
        F.sum("_size").over(whole).alias("_total"), F.sum("_rows").over(whole).alias("_values"),
    )
    # Only the partitions in which a wanted place lies are ranked.
    places = [F.lit(p) * (F.col("_total") - 1) for p in probs.values()]
    wanted = [F.floor(x + 0.5) for x in places] if method == "nearest" else [f(x) for x in places for f in (F.floor, F.ceil)]
    holds = reduce(lambda a, b: a | b, [(F.col("_base") <= i) & (i < F.col("_base") + F.col("_size")) for i in wanted])
    near = sizes.filter(holds).drop("_size")
    on = F.col("p._part") == F.col("t._part")
    for g in groups:
        on = on & F.col(f"p.{quoted(g)}").eqNullSafe(F.col(f"t.{quoted(g)}"))
    inside = W.partitionBy("_part", *groups).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    joined = ranged.alias("p").join(near.alias("t"), on).select("p.*", "t._base", "t._total", "t._values").withColumn(
        "_start", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )

    def at(index: Column) -> Column:
        hit = (F.col("_start") <= index) & (index < F.col("_start") + F.col("_n"))
        return F.max(F.when(hit, F.col("_v")))

    aggs = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("_total") - 1)
        if method == "nearest":
            aggs.append(at(F.floor(place + 0.5)).alias(name))
        else:
            aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    out = joined.groupBy(*groups, "_total", "_values").agg(*aggs)
    if method != "nearest":
        for name, p in probs.items():
            place = F.lit(p) * (F.col("_total") - 1)
            low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            out = out.withColumn(name, low + (high - low) * (place - F.floor(place)))
    out = out.select(*groups, *probs, *([F.col("_values").alias(distinct)] if distinct else []))
    return out.drop("_g") if one_group else out
