"""Search, sort, paging, cross-filters and SQL over named tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import quoted, text_of
from ..session import ensure_checkpoint_dir
from .ordering import in_order, with_position


def search(df: DataFrame, q: str, column: str | None = None) -> DataFrame:
    """Rows where one column, or any column, contains ``q`` ignoring case."""
    columns = [column] if column else df.columns
    tests = [F.contains(F.lower(text_of(df, c)), F.lit(q.lower())) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]))


def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    c = F.col(quoted(column))
    return df.orderBy(c.asc() if ascending else c.desc())


def page(df: DataFrame, order_by: list, number: int = 0, size: int = 5000) -> DataFrame:
    """Page ``number`` (from 0) of the ordered table, by distributed row positions: a top-k would gather all rows before the page."""
    start = number * size
    placed = with_position(df, order_by, "_pos")
    return placed.filter((F.col("_pos") >= start) & (F.col("_pos") < start + size)).drop("_pos")


ROWS_PER_FILE = 1_000_000


class PagedTable:
    """A table kept in order on shared storage, of which any page is read without the rest.

    ``store`` writes it once: files by ranges of the order, every row with its place
    in its file, and one row of counts per file. A page looks its files up in the
    counts and reads these alone, and of them the Parquet pages with its places.
    Rows with equal keys keep the order that they were stored in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def store(cls, df: DataFrame, order_by: list, path: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> PagedTable:
        """Write ``df`` in the order of ``order_by`` below ``path``, or in the checkpoint folder; an existing path is an error."""
        path = path or f"{ensure_checkpoint_dir(df.sparkSession)}/pages-{uuid.uuid4().hex}"
        clash = [c for c in df.columns if c.lower() in (cls.FILE, cls.PLACE)]
        if clash:
            raise ValueError(f"columns {clash} are names of the layout")
        files = max(1, -(-df.count() // rows_per_file))
        order = in_order(df, order_by)
        rows = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        kept = rows.withColumn(cls.PLACE, place).withColumn(cls.FILE, F.spark_partition_id())
        kept.write.partitionBy(cls.FILE).parquet(f"{path}/rows")
        kept.limit(0).write.parquet(f"{path}/schema")
        table = cls(df.sparkSession, path)
        counts = table._rows().groupBy(cls.FILE).agg(F.count(F.lit(1)).alias("n"))
        # One row per file, so that a single task may add them up.
        start = F.coalesce(F.sum("n").over(W.orderBy(cls.FILE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts.withColumn("start", start).coalesce(1).write.parquet(f"{path}/counts")
        return table

    FILE, PLACE = "_paged_file", "_paged_place"

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema  # a table without rows has no files of its own
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def page(self, number: int = 0, size: int = 5000) -> DataFrame:
        """Page ``number`` (from 0) of ``size`` rows; empty beyond the end."""
        low, high = number * size, (number + 1) * size
        counts = self.spark.read.schema(f"{self.FILE} int, n long, start long").parquet(f"{self.path}/counts")
        # A page of ``size`` rows meets at most ``size`` files that hold rows. All but the first and last are read whole.
        hit = counts.filter((F.col("start") < high) & (F.col("start") + F.col("n") > low)).orderBy("start").collect()
        if not hit:
            return self._rows().drop(self.FILE, self.PLACE).limit(0)
        file, place, first, last = F.col(self.FILE), F.col(self.PLACE), hit[0], hit[-1]
        found = self._rows().filter(
            file.isin([r[self.FILE] for r in hit])
            & ((file != first[self.FILE]) | (place >= low - first["start"]))
            & ((file != last[self.FILE]) | (place < high - last["start"]))
        )
        return found.orderBy(self.FILE, self.PLACE).drop(self.FILE, self.PLACE)


def cross_filter(df: DataFrame, row_id: str, segment: str | None = None, column: str | None = None, value: str | None = None) -> DataFrame:
    """Rows behind a chart element: a quality segment or a ``column`` value."""
    from .dedupe import detect_smart
    from .validate import validate

    if column is not None:
        return search(df, "" if value is None else value, column)
    if segment in (None, "All", "Unique"):
        return df
    if segment == "Duplicates":
        groups = detect_smart(df, row_id)
        return df.join(groups.select(row_id).distinct(), row_id, "left_semi")
    if segment == "Missing":
        return validate(df, row_id)
    raise ValueError(f"unknown segment: {segment}")


def register(spark: SparkSession, datasets: dict[str, DataFrame]) -> DataFrame:
    """Expose tables to SQL as ``t0``, ``t1``, ... and under their own names. A new call replaces the views of the last;
    two tables of one call that would share a view are an error."""
    views = {name: "".join(ch if ch.isalnum() else "_" for ch in name).lower() for name in datasets}
    taken = [*views.values(), *(f"t{i}" for i in range(len(datasets)))]
    clashes = sorted({v for v in taken if taken.count(v) > 1})
    if clashes:
        raise ValueError(f"more than one table for the view {', '.join(clashes)}")
    rows = []
    for i, (name, df) in enumerate(datasets.items()):
        df.createOrReplaceTempView(f"t{i}")
        df.createOrReplaceTempView(views[name])
        rows.append((f"t{i}", name, len(df.columns)))
    return spark.createDataFrame(rows, "alias string, name string, cols int")


def tables(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables() if t.isTemporary]


def sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query.strip().rstrip(";"))
