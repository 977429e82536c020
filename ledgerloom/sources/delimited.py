"""Readers for delimited files and folders of them."""

from __future__ import annotations

import logging
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted
from ..operators.clean import normalize_headers

log = logging.getLogger(__name__)


def separator(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


# Standard quoting: a quote inside a quoted cell is doubled, and a cell may hold line breaks.
QUOTING = {"quote": '"', "escape": '"'}
# What stands for a cell with nothing in it, not even quotes: no cell holds this, so an empty text in quotes stays one.
NOTHING = {"nullValue": uuid.uuid4().hex, "emptyValue": ""}


def _options(reader, sep: str, multi_line: bool = True):
    return reader.options(header=True, sep=sep, mode="PERMISSIVE", multiLine=multi_line, **QUOTING, **NOTHING)


def _filled(name: str) -> Column:
    """A cell's text, or null where it is empty, in quotes or not: such a cell has no type."""
    return F.nullif(F.col(quoted(name)), F.lit(""))


# Rows that are looked at first: one value that does not parse rules a type out.
LOOK = 256
# The types that are tried, and what a value must begin with before it is parsed, as a failed parse is slow.
KINDS = (
    ("bigint", T.LongType(), r"^[\x00-\x20\x7F-\x9F]*[-+.0-9]"), ("double", T.DoubleType(), r"^[\x00-\x20\x7F-\x9F]*[-+.0-9iInN]"),
    ("date", T.DateType(), r"^\d{4}-\d{2}-\d{2}$"), ("timestamp", T.TimestampType(), r"^\d{4}-\d{2}-\d{2}"),
)


def _failing(rows: DataFrame, tried: list[list[tuple]]) -> list[tuple]:
    """For each column the number of filled cells, and of those that each type tried does not fit."""
    aggs = []
    for i, (c, kinds) in enumerate(zip(rows.columns, tried, strict=True)):
        v = _filled(c)
        aggs += [F.count(v).alias(f"{i}_n")] if kinds else []
        aggs += [F.count_if(v.isNotNull() & F.when(v.rlike(start), v.try_cast(kind)).isNull()).alias(f"{i}_{kind}") for kind, _, start in kinds]
    row = rows.agg(*aggs).first() if aggs else None
    return [(row[f"{i}_n"], [row[f"{i}_{k[0]}"] for k in kinds]) if kinds else (0, []) for i, kinds in enumerate(tried)]


def infer_types(sample: DataFrame) -> T.StructType:
    """Types of an all-text table: every filled value of all rows must parse, else the column stays text.

    A few rows rule types out; those that are left are tried on all rows.
    """
    columns = sample.columns
    first = _failing(sample.limit(LOOK), [list(KINDS)] * len(columns))
    left = [[k for k, bad in zip(KINDS, failed, strict=True) if not bad] for _, failed in first]
    fields = []
    for c, kinds, (filled, failed) in zip(columns, left, _failing(sample, left), strict=True):
        dtype = next((k[1] for k, bad in zip(kinds, failed, strict=True) if filled and not bad), T.StringType())
        fields.append(T.StructField(c, dtype))
    return T.StructType(fields)


def _text(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return _options(spark.read, separator(path), multi_line).option("inferSchema", False).csv(path)


def read_delimited(
    spark: SparkSession, path: str, max_rows: int | None = None, schema: T.StructType | None = None, multi_line: bool = True,
) -> DataFrame:
    """One delimited file, or a folder of files with the same header.

    A column's type is one that every filled cell of all rows has, found by one
    aggregate; headers are normalised. With a ``schema`` of one's own, cells that
    do not fit become null; ``lost_cells`` counts them. If columns can't be told
    apart, every column is text; a job that fails does not pass for that. A cell
    without quotes and text is null, ``""`` is an empty text (null in a typed
    column). Cells may hold line breaks; where none do, ``multi_line=False`` lets
    large files be split.
    """
    text = _text(spark, path, multi_line)
    if schema is None:
        try:
            schema = infer_types(text)
        except AnalysisException as error:
            log.warning("typing of %s failed, reading text: %s", path, error)
            schema = text.schema
    typed = [
        (F.col(quoted(c)) if isinstance(f.dataType, T.StringType) else F.col(quoted(c)).try_cast(f.dataType)).alias(f.name)
        for c, f in zip(text.columns, schema.fields, strict=True)
    ]
    df = normalize_headers(text.select(*typed))
    return df if max_rows is None else df.limit(max_rows)


def lost_cells(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """(column, lost): filled cells per column that do not fit the type of ``schema`` at their place."""
    text = _text(spark, path, multi_line)
    counts = []
    for name, field in zip(text.columns, schema.fields, strict=True):
        v = _filled(name)
        counts.append(F.count_if(v.isNotNull() & v.try_cast(field.dataType).isNull()).alias(field.name))
    wide = text.agg(*counts)
    return wide.unpivot([], [quoted(f.name) for f in schema.fields], "column", "lost")


def read_many(spark: SparkSession, paths: list[str], max_rows: int | None = None) -> dict[str, DataFrame]:
    """One dataset per file; files that cannot be read are logged and left out."""
    out = {}
    for path in paths:
        try:
            out[path] = read_delimited(spark, path, max_rows)
        except Exception as error:  # noqa: BLE001 - a bad file must not stop the others
            log.error("skipping %s: %s", path, error)
    return out


def read_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as one text table with ``_source_file``; files with one header share a scan."""
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        try:
            header = tuple(_text(spark, path, True).columns)
        except Exception as error:  # noqa: BLE001
            log.error("skipping %s: %s", path, error)
            continue
        groups.setdefault((separator(path), header), []).append(path)
    parts = []
    for (sep, header), files in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        df = _options(spark.read, sep).schema(schema).csv(files)
        named = normalize_headers(df)
        source = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        parts.append(df.select("*", source.alias("_source_file")).toDF(*named.columns, "_source_file"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON or delimited input, by extension."""
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".tsv", ".txt")):
        return read_delimited(spark, path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.orc(path) if low.endswith(".orc") else spark.read.parquet(path)
