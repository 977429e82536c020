"""Pivot tables and drill-through."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted, text_of
from .ordering import group_quantiles

# Aggregate names; cell header separator.
AGGREGATES = ("sum", "mean", "avg", "count", "count_distinct", "min", "max", "median", "std")
HEADER_SEPARATOR = " · "
MAX_PIVOT_COLUMNS = 10_000


def aggregate_column(value: Column, name: str) -> Column:
    """One of the pivot aggregates. A sum of nulls is 0, null is a distinct value, count counts rows."""
    if name == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if name in ("mean", "avg"):
        return F.avg(value)
    if name == "count":
        return F.count(F.lit(1))
    if name == "count_distinct":
        return F.count_distinct(value) + F.max(value.isNull().cast("int"))
    if name == "min":
        return F.min(value)
    if name == "max":
        return F.max(value)
    if name == "std":
        return F.stddev_samp(value)
    raise ValueError(f"unknown aggregate {name!r}, use one of {AGGREGATES}")


def _grouped(df: DataFrame, keys: list[str], value: str, aggregate: str, label: str) -> DataFrame:
    groups = df.groupBy(*[F.col(quoted(k)) for k in keys])
    if aggregate != "median":
        return groups.agg(aggregate_column(F.col(quoted(value)), aggregate).alias(label))
    medians = group_quantiles(df, keys, value, {"_median": 0.5})
    on = [F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}")) for k in keys]
    present = groups.agg(F.count(F.lit(1)).alias("_n"))
    condition = on[0]
    for extra in on[1:]:
        condition = condition & extra
    return present.alias("a").join(medians.alias("b"), condition, "left").select(
        *[F.col(f"a.{quoted(k)}").alias(k) for k in keys], F.col("b._median").alias(label)
    )


def pivot(
    df: DataFrame,
    rows: list[str],
    columns: list[str] | None = None,
    value: str | None = None,
    aggregate: str = "sum",
    lenient: bool = False,
) -> DataFrame:
    """Group table, or cross-tab when ``columns`` is given, ordered by the row fields."""
    if not rows:
        raise ValueError("at least one row field is required")
    if lenient:
        return _lenient(df, rows, value, aggregate)
    aggregate = aggregate.lower()
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate!r}, use one of {AGGREGATES}")
    order = [F.col(quoted(r)) for r in rows]
    if value is None:
        label = f"{aggregate}(__count__)" if aggregate == "sum" else "count(__count__)"
        value, aggregate = "__count__", "sum"
        df = df.withColumn("__count__", F.lit(1))
    else:
        label = f"{aggregate}({value})"
    if not columns:
        return _grouped(df, rows, value, aggregate, label).orderBy(*order)
    parts = [text_of(df, c) for c in columns]
    header = parts[0]
    for part in parts[1:]:
        header = F.concat(header, F.lit(HEADER_SEPARATOR), part)
    slim = df.select(*order, header.alias("__col__"), F.col(quoted(value)))
    # The headers become columns of the result; more than Spark's own limit is an error.
    headers = [r[0] for r in slim.select("__col__").distinct().limit(MAX_PIVOT_COLUMNS + 1).collect()]
    if len(headers) > MAX_PIVOT_COLUMNS:
        raise ValueError(f"more than {MAX_PIVOT_COLUMNS} pivot columns")
    headers.sort(key=lambda h: (h is None, h or ""))
    # Cells are aggregated first, so the pivot itself only spreads one value per cell.
    cells = _grouped(slim, rows + ["__col__"], value, aggregate, "__cell__")
    spread = [
        F.first(F.when(F.col("__col__").eqNullSafe(F.lit(h)), F.col("__cell__")), ignorenulls=True).alias("null" if h is None else h)
        for h in headers
    ]
    return cells.groupBy(*order).agg(*spread).orderBy(*order)


def _lenient(df: DataFrame, rows: list[str], value: str | None, aggregate: str) -> DataFrame:
    """Null keys become ``N/A``, non-numeric values are skipped, results have two decimals."""
    aggregate = aggregate.lower()
    keys = [F.coalesce(text_of(df, r), F.lit("N/A")).alias(r) for r in rows]
    count = F.count(F.lit(1)).cast("double")
    if value is None:
        result, label = count, "COUNT"
    else:
        number = text_of(df, value).try_cast("double")
        label = f"{aggregate.upper()}({value})"
        known = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
        result = F.coalesce(known[aggregate](number), F.lit(0.0)) if aggregate in known else count
    return df.groupBy(*keys).agg(F.round(result, 2).alias(label))


def drill_through(df: DataFrame, row_keys: dict, col_keys: dict | None = None) -> DataFrame:
    """Rows behind a pivot cell. Values compare as text; unknown columns and null values are ignored.

    Text and whole-number columns compare without a cast, so the filter reaches the scan.
    """
    for column, wanted in {**row_keys, **(col_keys or {})}.items():
        if column not in df.columns or wanted is None:
            continue
        text = str(wanted)
        if isinstance(df.schema[column].dataType, T.IntegralType) and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", text):
            df = df.filter(F.col(quoted(column)) == F.lit(int(text)))
        else:
            df = df.filter(text_of(df, column) == F.lit(text))
    return df


def header_keys(header: str, columns: list[str]) -> dict[str, str]:
    """Column filters behind a cross-tab cell header."""
    parts = header.split(HEADER_SEPARATOR)
    return dict(zip(columns, parts)) if len(parts) == len(columns) else {}


def drill_aggregate(df: DataFrame, value: str | None, aggregate: str = "sum") -> DataFrame:
    """One value over drilled rows; null becomes 0, no value column gives the row count."""
    known = ("sum", "mean", "avg", "min", "max")
    if value is not None and aggregate == "median":
        return group_quantiles(df, [], value, {"value": 0.5}).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))
    if value is None or aggregate not in known:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value"))
    result = aggregate_column(F.col(quoted(value)), aggregate)
    return df.agg(F.coalesce(result.cast("double"), F.lit(0.0)).alias("value"))
