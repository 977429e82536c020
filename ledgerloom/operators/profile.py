"""Profiling and KPI tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted, text_of
from .ordering import group_quantiles

NUMERIC = T.NumericType


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMERIC)


def unpivot_text(df: DataFrame, columns: list[str], keep: list[str] = (), name: str = "column", value: str = "value"):
    """Long form (keep..., column, value) with every value as text."""
    texts = [text_of(df, c).alias(c) for c in columns]
    kept = [F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(keep)]
    wide = df.select(*kept, *texts)
    long = wide.unpivot([f"_k{i}" for i in range(len(keep))], [quoted(c) for c in columns], name, value)
    for i, c in enumerate(keep):
        long = long.withColumnRenamed(f"_k{i}", c)
    return long


def _row_hash(df: DataFrame) -> Column:
    """128-bit row identity. Hashing skips nulls, so a null bitmap goes first.

    Nested values are hashed as JSON that keeps their nulls, at any depth.
    """
    def plain(c: str) -> Column:
        if _nested(df.schema[c].dataType):
            return F.to_json(F.struct(F.col(quoted(c)).alias("v")), {"ignoreNullFields": "false"})
        return F.col(quoted(c))

    columns = [plain(c) for c in df.columns]
    nulls = F.concat(*[F.when(F.col(quoted(c)).isNull(), "1").otherwise("0") for c in df.columns])
    return F.struct(F.xxhash64(nulls, *columns).alias("a"), F.xxhash64(F.lit("second"), nulls, *columns).alias("b"))


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def row_duplicate_kpi(df: DataFrame) -> DataFrame:
    """Total, unique and duplicate rows; null equals null."""
    counts = df.select(_row_hash(df).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(total.alias("total_rows"), F.count(F.lit(1)).alias("unique_rows")).withColumn(
        "duplicate_rows", F.col("total_rows") - F.col("unique_rows")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: (column, nulls)."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, nulls long")
    wide = df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], [quoted(c) for c in df.columns], "column", "nulls")


def summarise(datasets: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """Workspace KPIs as one row.

    ``sizes`` holds file sizes by dataset; without it the largest file is empty.
    Each dataset is read once: rows of one identity have the same number of nulls,
    so one aggregate by identity carries both.
    """
    parts = []
    zero = F.lit(0).cast("long")
    for df in datasets.values():
        missing = reduce(lambda a, b: a + b, [F.col(quoted(c)).isNull().cast("int") for c in df.columns])
        counts = df.select(_row_hash(df).alias("h"), missing.alias("m")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
        parts.append(counts.agg(
            F.coalesce(F.sum("n"), zero).alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"),
            F.coalesce(F.sum(F.col("n") * F.col("m")), zero).alias("missing"),
        ).withColumn("cols", F.lit(len(df.columns))))
    rows = reduce(DataFrame.unionByName, parts)
    sizes = sizes or {}
    largest = max(sizes, key=lambda k: sizes[k]) if sizes else ""
    cells = F.greatest(F.lit(1), F.sum(F.col("total_rows") * F.greatest(F.lit(1), F.col("cols"))))
    duplicates = F.greatest(F.lit(0), F.sum("total_rows") - F.sum("unique_rows"))
    return rows.agg(
        F.lit(len(datasets)).alias("total_files"),
        F.lit(len(datasets)).alias("total_sheets"),
        F.sum("total_rows").alias("total_rows"),
        F.sum("unique_rows").alias("unique_rows"),
        duplicates.alias("duplicate_rows"),
        F.sum("missing").alias("missing_values"),
        F.sum("cols").alias("columns_profiled"),
        F.lit(largest).alias("largest_file"),
        F.round(100.0 - 100.0 * F.sum("missing") / cells, 2).alias("data_quality_score"),
        F.round(100.0 - 100.0 * duplicates / F.greatest(F.lit(1), F.sum("total_rows")), 2).alias("validation_score"),
    )


def per_sheet(datasets: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, cols) per dataset."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(len(df.columns)).alias("cols"))
        for n, df in datasets.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def quality_composition(summary: DataFrame) -> DataFrame:
    """KPI row turned into (label, value) rows."""
    return summary.select(
        F.col("unique_rows").alias("Unique"),
        F.col("duplicate_rows").alias("Duplicates"),
        F.col("missing_values").alias("Missing"),
    ).unpivot([], ["Unique", "Duplicates", "Missing"], "label", "value")


def top_values(df: DataFrame, column: str, n: int = 10, nulls: bool = True, null_label: str | None = None) -> DataFrame:
    """Most frequent values; count descending, then value ascending with nulls first."""
    rows = df if nulls else df.filter(F.col(quoted(column)).isNotNull())
    counts = rows.groupBy(F.col(quoted(column)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc("value")).limit(n)
    if null_label is not None:
        top = top.withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit(null_label)))
    return top


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, float]:
    """About ``rows`` rows, those whose keys have the least MD5, and their share: the same rows on every run and engine."""
    total = df.count()
    if total <= rows:
        return df, 1.0
    text = F.concat_ws("|", *[F.col(quoted(k)).cast("string") for k in keys])
    return df.filter(F.substring(F.md5(text.cast("binary")), 1, 8) < f"{int(rows / total * 2**32):08x}"), rows / total


def profile_column(
    df: DataFrame, column: str, sample_rows: int | None = None, seed: int = 42, sample_by: list[str] | None = None, top: int = 10,
    accuracy: int | None = None,
) -> DataFrame:
    """One-row profile: count, nulls, unique (null is a value), numeric moments, or for text the ``top`` most frequent values.

    With ``sample_rows`` every figure comes from the same sample, whose share of
    the rows is reported as ``sampled_fraction``: a random one, or by a hash of
    the columns ``sample_by``. Unique, median and top values come from one
    table of values and their counts, the moments from one more aggregate. With
    ``accuracy`` median and unique of numbers come from sketches (see ``group_quantiles``).
    """
    fraction = 1.0
    if sample_rows is not None and sample_by:
        df, fraction = hash_sample(df, sample_by, sample_rows)
    elif sample_rows is not None:
        total = df.count()
        if total > sample_rows:
            fraction = sample_rows / total
            df = df.sample(fraction=fraction, seed=seed)
    c = F.col(quoted(column))
    dtype = df.schema[column].dataType
    aggs = [
        F.lit(column).alias("column"),
        F.lit(dtype.simpleString()).alias("dtype"),
        F.count(F.lit(1)).alias("count"),
        F.count_if(c.isNull()).alias("nulls"),
    ]
    if is_numeric(df, column):
        aggs += [
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
        ]
    out = df.agg(*aggs)
    nothing = F.when(F.col("nulls") > 0, 1).otherwise(0)
    if is_numeric(df, column):
        found = group_quantiles(df, [], column, {"median": 0.5}, distinct="unique", accuracy=accuracy)
        found = found.select(F.struct("median", "unique").alias("f")).scalar()
        out = out.withColumn("_f", found).withColumn("unique", F.coalesce("_f.unique", F.lit(0)) + nothing).withColumn("median", F.col("_f.median")).drop("_f")
    else:
        counts = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("value").isNotNull())
        out = out.withColumn("unique", counts.agg(F.count(F.lit(1))).scalar() + nothing)
        if isinstance(dtype, T.StringType):
            first = counts.orderBy(F.desc("n"), F.asc("value")).limit(top)
            shown = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))), lambda x: F.concat(x["value"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")")))
            out = out.withColumn("top_values", first.agg(F.array_join(shown, "; ")).scalar())
    if sample_rows is not None:
        out = out.withColumn("sampled_fraction", F.lit(fraction))
    return out


def profile_all(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(column, metric, value) for all columns.

    Moments come from one wide aggregate. Distinct counts come from a long
    (column, value) count, which combines on the map side and needs no expand.
    With ``accuracy`` medians come from sketches (see ``group_quantiles``).
    """
    columns = df.columns
    wide = []
    for c in columns:
        col = F.col(quoted(c))
        metrics = {"count": F.count(F.lit(1)), "nulls": F.count_if(col.isNull())}
        if is_numeric(df, c):
            metrics |= {"min": F.min(col), "max": F.max(col), "mean": F.coalesce(F.avg(col), F.lit(0.0)),
                        "std": F.coalesce(F.stddev_samp(col), F.lit(0.0))}
        wide += [v.cast("double").alias(f"{c}\u0001{m}") for m, v in metrics.items()]
    row = df.agg(*wide)
    long = row.unpivot([], [quoted(c) for c in row.columns], "k", "value")
    part = F.split("k", "\u0001")
    moments = long.select(part[0].alias("column"), part[1].alias("metric"), "value")
    distinct = unpivot_text(df, columns).groupBy("column", "value").agg(F.lit(1).alias("one"))
    unique = distinct.groupBy("column").agg(F.count(F.lit(1)).cast("double").alias("value"))
    out = moments.unionByName(unique.select("column", F.lit("unique").alias("metric"), "value"))
    numeric = [c for c in columns if is_numeric(df, c)]
    if numeric:
        values = df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in numeric])
        medians = group_quantiles(
            values.unpivot([], [quoted(c) for c in numeric], "column", "v"), ["column"], "v", {"value": 0.5}, accuracy=accuracy
        )
        out = out.unionByName(medians.select("column", F.lit("median").alias("metric"), "value"))
    return out


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) over ``bins`` equal-width bins; the last one is closed."""
    values = df.select(F.col(quoted(column)).cast("double").alias("x")).filter(F.col("x").isNotNull())
    bounds = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    edge = bounds.select(F.struct("lo", "hi").alias("edge")).scalar()
    width = (F.col("edge.hi") - F.col("edge.lo")) / bins
    place = F.least(F.floor((F.col("x") - F.col("edge.lo")) / width), F.lit(bins - 1)).cast("int")
    counts = values.withColumn("edge", edge).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = bounds.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", ((F.col("hi") - F.col("lo")) / bins).alias("w")
    )
    # counts has at most ``bins`` rows.
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def shares(df: DataFrame, label: str, value: str) -> DataFrame:
    """Total of ``value`` per label and its percentage of the grand total."""
    totals = df.groupBy(F.col(quoted(label)).alias("label")).agg(F.sum(quoted(value)).alias("value"))
    grand = df.agg(F.sum(quoted(value)).alias("_all"))
    whole = F.when(F.col("_all") == 0, F.lit(1.0)).otherwise(F.col("_all"))
    return totals.withColumn("_all", grand.scalar()).select("label", "value", (100.0 * F.col("value") / whole).alias("share"))


def describe(df: DataFrame) -> DataFrame:
    """Dataset card: per column type, row count, nulls and unique values."""
    types = F.create_map(*[F.lit(x) for c in df.columns for x in (c, df.schema[c].dataType.simpleString())])
    long = unpivot_text(df, df.columns)
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count(F.lit(1)).alias("unique"),
    ).select("column", types[F.col("column")].alias("dtype"), "rows", "nulls", "unique")


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(quoted(c)) for c in order_by]).limit(n)
