"""Rule checks per cell and per column, as one flat issue table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import EMAIL, quoted, text_of
from .ordering import group_quantiles
from .profile import is_numeric, null_counts

ISSUE_SCHEMA = T.StructType([
    T.StructField("row", T.LongType()),
    T.StructField("column", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("message", T.StringType()),
])
# Patterns, date formats, header words and severity weights.
GSTIN = r"(?U)^\d{2}[A-Z]{5}\d{4}[A-Z]{1}\d[Z][A-Z\d]$"
ZIP = r"(?U)^\d{3,10}(-\d{3,5})?$"
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy",
                "yyyy-M-d H:m:s")
PHONE_WORDS = ("phone", "mobile", "contact")
ZIP_WORDS = ("zip", "pin", "postal")
WEIGHTS = {"error": 3, "warning": 2, "info": 1}


def _issue(row: Column, column: str, value: Column, severity: str, rule: str, message) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(row.cast("long").alias("row"), F.lit(column).alias("column"), value.cast("string").alias("value"),
                    F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), text.alias("message"))


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"(?U)\D", ""))


def _parses_as_date(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS]).isNotNull()


def _cell_rule(df: DataFrame, column: str, row: Column) -> Column | None:
    """The rule chain of one column: the first header match whose test applies decides."""
    header = column.lower()
    value = text_of(df, column)
    present = value.isNotNull() & (value != "")
    chain = None

    def branch(test: Column, *issue):
        nonlocal chain
        hit = _issue(row, column, value, *issue)
        chain = F.when(present & test, hit) if chain is None else chain.when(present & test, hit)

    if "email" in header:
        branch(~value.rlike(EMAIL), "error", "invalid_email", "Not a valid email")
    if any(w in header for w in PHONE_WORDS):
        branch((_digits(value) < 6) | (_digits(value) > 15), "error", "invalid_phone", "Phone length invalid")
        return chain
    if "gst" in header:
        branch(~F.upper(value).rlike(GSTIN), "warning", "invalid_gst", "Not a GSTIN pattern")
    if any(w in header for w in ZIP_WORDS):
        branch(~value.rlike(ZIP), "warning", "invalid_zip", "ZIP/PIN pattern invalid")
    if "date" in header:
        branch(~_parses_as_date(value), "warning", "invalid_date", "Unrecognised date")
    return chain


def cell_issues(df: DataFrame, row_id: str, rules: list[str] | None = None) -> DataFrame:
    """invalid_email, invalid_phone, invalid_gst, invalid_zip and invalid_date in one pass."""
    row = F.col(quoted(row_id))
    found = [r for c in df.columns if c != row_id and (r := _cell_rule(df, c, row)) is not None]
    if not found:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    out = df.select(F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.*")
    return out if rules is None else out.filter(F.col("rule").isin(rules))


def header_issues(spark: SparkSession, columns: list[str]) -> DataFrame:
    bad = [c for c in columns if not c or c.startswith("column")]
    message = "Column has missing / auto-generated header"
    return spark.createDataFrame([(-1, c, None, "warning", "missing_header", message) for c in bad], ISSUE_SCHEMA)


def null_issues(df: DataFrame) -> DataFrame:
    counts = null_counts(df).filter(F.col("nulls") > 0)
    message = F.concat(F.col("nulls").cast("string"), F.lit(" null / missing values"))
    issue = F.struct(F.lit(-1).cast("long").alias("row"), "column", F.lit(None).cast("string").alias("value"),
                     F.lit("info").alias("severity"), F.lit("null_values").alias("rule"), message.alias("message"))
    return counts.select(issue.alias("i")).select("i.*")


def quartiles(df: DataFrame, columns: list[str], accuracy: int | None = None) -> dict[str, tuple]:
    """Column -> (non-null count, q1, q3) with the nearest-rank rule, or by sketches (see ``group_quantiles``).

    Returns one tuple per numeric column to the driver.
    """
    counts = df.agg(*[F.count(quoted(c)).alias(c) for c in columns]).first().asDict()
    usable = [c for c in columns if counts[c] >= 4]
    if not usable:
        return {}
    values = df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in usable])
    long = values.unpivot([], [quoted(c) for c in usable], "column", "v")
    found = group_quantiles(long, ["column"], "v", {"q1": 0.25, "q3": 0.75}, method="nearest", accuracy=accuracy)
    return {r["column"]: (counts[r["column"]], r["q1"], r["q3"]) for r in found.collect()}


def outlier_issues(df: DataFrame, row_id: str, accuracy: int | None = None) -> DataFrame:
    """Values outside 1.5 IQR of numeric columns with four or more values; with ``accuracy`` the quartiles
    may be off by ``n / accuracy`` ranks, and take one pass in place of a sort."""
    numeric = [c for c in df.columns if c != row_id and is_numeric(df, c)]
    row = F.col(quoted(row_id))
    found = []
    for c, (_, q1, q3) in (quartiles(df, numeric, accuracy) if numeric else {}).items():
        spread = q3 - q1
        if spread == 0:
            continue
        low, high = q1 - 1.5 * spread, q3 + 1.5 * spread
        value = F.col(quoted(c))
        test = (value < low) | (value > high)
        found.append(F.when(test, _issue(row, c, text_of(df, c), "info", "outlier", f"Outside [{low:.2f}, {high:.2f}]")))
    if not found:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.*")


def validate(df: DataFrame, row_id: str, profile: str = "full") -> DataFrame:
    """All issues of a table; the schema is the same when there are none."""
    if profile == "light":
        return _light(df, row_id)
    data = df.drop(row_id)
    parts = [header_issues(df.sparkSession, data.columns), null_issues(data), cell_issues(df, row_id), outlier_issues(df, row_id)]
    return reduce(DataFrame.unionByName, parts)


def _light(df: DataFrame, row_id: str) -> DataFrame:
    """Missing value per cell, ``@`` test, phone of fewer than seven digits; rows count from 1."""
    row = F.col(quoted(row_id)) + 1
    found = []
    for c in df.columns:
        if c == row_id:
            continue
        value, header = text_of(df, c), c.lower()
        missing = _issue(row, c, F.lit(None), "warning", "missing_value", f"Missing value in column '{c}'")
        chain = F.when(value.isNull() | (value == ""), missing)
        if "email" in header:
            chain = chain.when(~value.contains("@"), _issue(row, c, value, "error", "invalid_email", "Invalid email address format"))
        if "phone" in header:
            short = F.length(F.regexp_replace(value, r"[^0-9]", "")) < 7
            chain = chain.when(short, _issue(row, c, value, "warning", "invalid_phone", "Suspicious phone number format"))
        found.append(chain)
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.*")


def quality_score(issues: DataFrame, rows: int | Column, cols: int, profile: str = "full") -> DataFrame:
    """Score in [0, 100] as one row; ``rows`` may be a scalar subquery."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    if profile == "light":
        cost, digits = F.count(F.lit(1)), 1
    else:
        weight = F.lit(1)
        for severity, w in WEIGHTS.items():
            weight = F.when(F.col("severity") == severity, w).otherwise(weight)
        cost, digits = F.coalesce(F.sum(weight), F.lit(0)), 2
    total = issues.agg(cost.alias("cost"))
    cells = F.greatest(F.lit(1), rows * max(1, cols))
    return total.select(F.greatest(F.lit(0.0), F.round(100.0 - 100.0 * F.col("cost") / cells, digits)).alias("quality_score"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
