"""Text normalisers as column expressions.

Everything stays inside the JVM except Unicode NFKC, which has no built-in; its
pandas UDF receives null for plain ASCII values, so those cross Arrow as nulls.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\ufeff\u00ad]"
SPACES = r"(?U)\s+"
EDGE_SPACES = r"(?U)^\s+|\s+$"
NON_ASCII = r"[^\x00-\x7F]"
EMAIL = r"(?U)^[\w.+\-]+@[\w\-]+\.[\w\-.]+$"


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def strip_invisible(c: Column) -> Column:
    """Drop zero-width, direction and soft-hyphen characters."""
    return F.regexp_replace(c, INVISIBLE, "")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; ASCII values are left alone."""
    return F.coalesce(_nfkc_udf(F.when(c.rlike(NON_ASCII), c)), c)


def squeeze(c: Column) -> Column:
    """Collapse each run of white space to one space."""
    return F.regexp_replace(c, SPACES, " ")


def strip(c: Column) -> Column:
    """Trim any white space, not only U+0020."""
    return F.regexp_replace(c, EDGE_SPACES, "")


def fix_case(c: Column, mode: str) -> Column:
    """``lower``, ``upper`` or ``title``; a title word starts after any non-alphanumeric."""
    if mode == "lower":
        return F.lower(c)
    if mode == "upper":
        return F.upper(c)
    if mode == "title":
        parts = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
        return F.array_join(F.transform(parts, F.initcap), "")
    raise ValueError(f"unknown case mode: {mode}")


def phone_chars(c: Column) -> Column:
    """Keep only digits and ``+``."""
    return F.regexp_replace(c, r"(?U)[^\d+]", "")


def as_text(c: Column, dtype: T.DataType) -> Column:
    """String form of a column, with plain decimal digits for floating values."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = c.cast("string")
        plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
        plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
        size = F.abs(c)
        return F.when((size >= 1e7) & (size < 1e16) | (size >= 1e-4) & (size < 1e-3), plain).otherwise(text)
    return c.cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    """String form of one column of ``df``."""
    return as_text(F.col(quoted(name)), df.schema[name].dataType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean_text(c: Column) -> Column:
    """NFKC, single spaces, trimmed; null becomes the empty string."""
    return strip(squeeze(nfkc(F.coalesce(c, F.lit("")))))


def norm_exact(c: Column) -> Column:
    """Comparison form of a value: cleaned and lower-cased."""
    return F.lower(clean_text(c))


def norm_high_confidence(c: Column) -> Column:
    """Comparison form that also ignores punctuation."""
    return strip(F.regexp_replace(norm_exact(c), r"(?U)[^\w\s]", ""))


def norm_phone(c: Column) -> Column:
    """Digits only; a leading 91 is dropped from twelve-digit numbers."""
    digits = F.regexp_replace(clean_text(c), r"(?U)\D", "")
    return F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)


def norm_email(c: Column) -> Column:
    return norm_exact(c)


def norm_light(c: Column) -> Column:
    """Trim and lower only; null becomes the empty string."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def is_valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def is_blank(c: Column) -> Column:
    """Null, or only white space."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def soundex_code(c: Column) -> Column:
    """Four-character phonetic code; uncoded letters do not separate equal codes."""
    up = F.upper(F.coalesce(c, F.lit("")))
    first = F.substring(up, 1, 1)
    coded = F.translate(
        F.regexp_replace(up, "[^BFPVCGJKQSXZDTLMNR]", ""), "BFPVCGJKQSXZDTLMNR", "111122222222334556"
    )
    runs = F.regexp_replace(coded, r"(.)\1+", "$1")
    tail = F.when(first.rlike("[BFPVCGJKQSXZDTLMNR]"), F.substring(runs, 2, 3)).otherwise(F.substring(runs, 1, 3))
    return F.when(up == "", F.lit("0000")).otherwise(F.rpad(F.concat(first, tail), 4, "0"))


def tokens(c: Column) -> Column:
    """Distinct ``[a-z0-9]+`` tokens of the lower-cased text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(found)


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased text padded with two spaces."""
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(c, F.lit(""))), F.lit("  "))
    count = F.length(padded) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))
    return F.when(count > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
