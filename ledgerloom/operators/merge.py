"""Joins of two tables with conflict detection and resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted, text_of
from .ordering import spread

# Accepted join names.
JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def merge(left: DataFrame, right: DataFrame, on=None, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Equi-join on text keys; right columns that collide get ``suffix``.

    ``on=None`` takes the shared columns. A full join keeps both key columns, the
    right one with the suffix. It is built as a left join plus the right rows
    without a partner, because hot keys are split at run time for those two kinds
    but not for a full outer join. Joins without keys are refused.
    """
    keys = shared_columns(left, right) if on is None else [on] if isinstance(on, str) else list(on)
    if how not in JOIN_KINDS:
        raise ValueError(f"unsupported join type: {how}")
    missing = [k for k in keys if k not in left.columns or k not in right.columns]
    if missing or not keys:
        raise ValueError(f"join keys missing in one of the tables: {missing}")
    kind = JOIN_KINDS[how]
    plain = {k: _same_plain_type(left, right, k) for k in keys}

    def keyed(df: DataFrame, side: str, rest: dict[str, str]) -> DataFrame:
        raw = [(F.col(quoted(k)) if plain[k] else text_of(df, k)).alias(f"{side}{i}") for i, k in enumerate(keys)]
        return df.select(*raw, *[F.col(quoted(c)).alias(n) for c, n in rest.items()])

    lnames = {c: c for c in left.columns if c not in keys}
    rnames = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns if c not in keys}
    l, r = keyed(left, "_lk", lnames), keyed(right, "_rk", rnames)
    on_cond = reduce(lambda a, b: a & b, [l[f"_lk{i}"] == r[f"_rk{i}"] for i in range(len(keys))])
    lcols, rcols = [quoted(n) for n in lnames.values()], [quoted(n) for n in rnames.values()]

    def shown(side: str, ending: str = "") -> list:
        return [F.col(f"{side}{i}").cast("string").alias(f"{k}{ending}") for i, k in enumerate(keys)]

    if kind in ("inner", "left"):
        return l.join(r, on_cond, kind).select(*shown("_lk"), *lcols, *rcols)
    if kind == "right":
        return l.join(r, on_cond, kind).select(*shown("_rk"), *lcols, *rcols)
    matched = l.join(r, on_cond, "left").select(*shown("_lk"), *lcols, *shown("_rk", suffix), *rcols)
    known = [f"_lk{i}" for i in range(len(keys))]
    alone = r.join(l.groupBy(*known, spread(*known)).agg(F.lit(1)).select(*known), on_cond, "left_anti").select(*shown("_rk", suffix), *rcols)
    return matched.unionByName(alone, allowMissingColumns=True)


def _same_plain_type(left: DataFrame, right: DataFrame, key: str) -> bool:
    """True when equal values have equal text, so the key joins as it is and keeps its partitioning."""
    a, b = left.schema[key].dataType, right.schema[key].dataType
    return a == b and isinstance(a, (T.StringType, T.IntegralType, T.DateType))


def merge_conflicts(joined: DataFrame, keys: list[str], suffix: str = "_right") -> DataFrame:
    """One row per shared non-key column whose two non-null values differ."""
    shared = [c for c in joined.columns if f"{c}{suffix}" in joined.columns and c not in keys]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), text_of(joined, c).alias("left_value"),
                 text_of(joined, f"{c}{suffix}").alias("right_value"))
        for c in shared
    ])
    found = F.filter(pairs, lambda p: p["left_value"] != p["right_value"])
    rows = joined.select(*[F.col(quoted(k)) for k in keys], F.explode(found).alias("p"))
    return rows.select(F.col("p.column").alias("column"), *[quoted(k) for k in keys], "p.left_value", "p.right_value")


def merge_stats(left: DataFrame, right: DataFrame, on, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Match counts of a join as one row.

    ``matched`` counts joined rows with all keys set, so left rows without a
    partner are in it; ``unmatched_*`` are differences of distinct key counts.
    ``*_without_partner`` are the true numbers of unpaired rows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    joined = merge(left, right, keys, how, suffix)
    all_set = reduce(lambda a, b: a & b, [F.col(quoted(k)).isNotNull() for k in keys])
    lk = left.select(*[text_of(left, k).alias(k) for k in keys])
    rk = right.select(*[text_of(right, k).alias(k) for k in keys])
    jk = joined.select(*[F.col(quoted(k)) for k in keys])

    def distinct_count(df: DataFrame):
        return df.distinct().agg(F.count(F.lit(1))).scalar()

    def alone(a: DataFrame, b: DataFrame):
        known = b.groupBy(*keys, spread(*keys)).agg(F.lit(1)).select(*[quoted(k) for k in keys])
        return a.join(known, keys, "left_anti").agg(F.count(F.lit(1))).scalar()

    zero = F.lit(0).cast("long")
    left_gap = F.greatest(zero, distinct_count(lk) - distinct_count(jk)) if how in ("right", "inner") else zero
    right_gap = F.greatest(zero, distinct_count(rk) - distinct_count(jk)) if how in ("left", "inner") else zero
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(all_set).alias("matched")).select(
        "rows", "matched", left_gap.alias("unmatched_left"), right_gap.alias("unmatched_right"),
        alone(lk, rk).alias("left_without_partner"), alone(rk, lk).alias("right_without_partner"),
    )


def resolve_conflicts(joined: DataFrame, strategy: str = "keep_left", suffix: str = "_right") -> DataFrame:
    """Fold each ``x`` / ``x_right`` pair into ``x``."""
    if strategy not in ("keep_left", "keep_right", "prefer_non_null", "keep_longest"):
        raise ValueError(f"unknown strategy: {strategy}")
    out = []
    for c in joined.columns:
        if c.endswith(suffix) and c[: -len(suffix)] in joined.columns:
            continue
        twin = f"{c}{suffix}"
        value = F.col(quoted(c))
        if twin in joined.columns:
            other = F.col(quoted(twin))
            if strategy == "keep_right":
                value = other
            elif strategy == "prefer_non_null":
                value = F.coalesce(value, other)
            elif strategy == "keep_longest":
                length = lambda n: F.coalesce(F.length(text_of(joined, n)), F.lit(0))
                value = F.when(length(c) >= length(twin), value).otherwise(other)
        out.append(value.alias(c))
    return joined.select(*out)
