"""Live refresh: a folder of arriving files as a stream, and KPIs kept per batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted
from ..operators.profile import _row_hash


def stream_delimited(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "csv", files_per_trigger: int = 100) -> DataFrame:
    """Rows of files as they arrive. A changed file must arrive under a new name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(folder)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def stream_summary(stream: DataFrame, state: str, checkpoint: str, available_now: bool = True):
    """Start a query that keeps exact row, unique and missing counts under ``state``.

    A batch stores only row identities not seen in earlier batches, so each refresh
    reads the batch and one anti-join, never the source again. Every batch writes
    its own folder, which a replay overwrites.
    """
    columns = stream.columns

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        missing = sum((F.count_if(F.col(quoted(c)).isNull()) for c in columns), F.lit(0))
        totals = batch.agg(F.count(F.lit(1)).alias("rows"), missing.cast("long").alias("missing"))
        fresh = batch.select(_row_hash(batch).alias("h")).distinct()
        seen = _read(spark, f"{state}/rows")
        if seen is not None:
            fresh = fresh.join(seen.filter(F.col("batch") < number).select("h"), "h", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{state}/rows/batch={number}")
        new = spark.read.schema("h struct<a: long, b: long>").parquet(f"{state}/rows/batch={number}").agg(F.count(F.lit(1))).scalar()
        totals.withColumn("new_unique", new).write.mode("overwrite").parquet(f"{state}/kpis/batch={number}")

    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def bounded_summary(stream: DataFrame, time: str, delay: str, state: str, checkpoint: str, available_now: bool = True):
    """As ``stream_summary``, with a state that doesn't grow with the history.

    Row identities are kept in Spark's state store, keyed by identity, from their first
    sight until the watermark (the latest ``time`` less ``delay``) has passed it by
    ``delay``. A batch thus costs what its rows cost, however long the stream has
    run. Counts are exact if copies of a row are at most ``delay`` apart in ``time``
    and no row is later than that. A copy that comes after its row has expired counts
    as a new row; a row behind the watermark counts as a copy. ``time`` takes part in
    the identity like any other column; rows without a time are never copies.
    """
    columns = stream.columns
    missing = sum((F.col(quoted(c)).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    rows = stream.select(_row_hash(stream).alias("h"), F.col(quoted(time)).cast("timestamp").alias("at"), missing.alias("missing"))
    every = rows.select(F.lit(1).alias("rows"), F.col("at").isNull().cast("int").alias("fresh"), "missing")
    timed = rows.filter(F.col("at").isNotNull()).select("h", "at").withWatermark("at", delay)
    first = timed.dropDuplicatesWithinWatermark(["h"]).select(F.lit(0).alias("rows"), F.lit(1).alias("fresh"), F.lit(0).cast("long").alias("missing"))

    def refresh(batch: DataFrame, number: int) -> None:
        totals = batch.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("rows", "rows"), ("missing", "missing"), ("fresh", "new_unique"))])
        totals.write.mode("overwrite").parquet(f"{state}/kpis/batch={number}")

    writer = every.unionByName(first).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_summary(spark: SparkSession, state: str, cols: int) -> DataFrame:
    """KPIs over all batches so far, as one row."""
    rows, unique, missing = F.sum("rows"), F.sum("new_unique"), F.sum("missing")
    return spark.read.parquet(f"{state}/kpis").agg(
        rows.alias("total_rows"), unique.alias("unique_rows"), (rows - unique).alias("duplicate_rows"), missing.alias("missing_values"),
        F.round(100.0 - 100.0 * missing / F.greatest(F.lit(1), rows * cols), 2).alias("data_quality_score"),
        F.round(100.0 - 100.0 * (rows - unique) / F.greatest(F.lit(1), rows), 2).alias("validation_score"),
    )
