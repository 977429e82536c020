"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted


# Quotes are doubled and white space at the ends of cells is kept, so that any reader gets the cells back.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def _writable(df: DataFrame, fmt: str) -> DataFrame:
    """CSV has no nested types: they are written as JSON text."""
    if fmt != "csv":
        return df
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        (F.to_json(quoted(f.name)) if isinstance(f.dataType, nested) else F.col(quoted(f.name))).alias(f.name) for f in df.schema.fields
    ])


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """Write each named table to its own folder; returns the folders."""
    out = {}
    for name, df in tables.items():
        folder = f"{path.rstrip('/')}/{name}"
        writer = _writable(df, fmt).write.mode(mode).format(fmt)
        (writer.options(**CSV_OPTIONS) if fmt == "csv" else writer).save(folder)
        out[name] = folder
    return out


def write_summary(df: DataFrame, path: str) -> None:
    """KPI row as JSON with ``generated_at``."""
    df.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(path)


def or_info(df: DataFrame, message: str) -> DataFrame:
    """The table itself, or a one-row ``info`` table when it is empty."""
    return df if not df.isEmpty() else df.sparkSession.createDataFrame([(message,)], "info string")


def duplicates_or_info(report: DataFrame) -> DataFrame:
    return or_info(report, "No duplicates detected")


def validation_or_info(issues: DataFrame) -> DataFrame:
    return or_info(issues, "No validation issues detected")
