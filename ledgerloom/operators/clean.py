"""Whole-table cleaning in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Header words that mark phone-like columns.
PHONE_WORDS = ("phone", "mobile", "contact")


def clean(
    df: DataFrame,
    trim: bool = True,
    dedupe_spaces: bool = True,
    strip_invisible: bool = True,
    unicode_normalize: bool = True,
    fix_case: str | None = None,
    normalize_phones: bool = True,
    normalize_emails: bool = True,
) -> DataFrame:
    """Clean every string column; other columns pass through."""
    out = []
    for field in df.schema.fields:
        c = F.col(tx.quoted(field.name))
        if isinstance(field.dataType, T.StringType):
            if strip_invisible:
                c = tx.strip_invisible(c)
            if unicode_normalize:
                c = tx.nfkc(c)
            if dedupe_spaces:
                c = tx.squeeze(c)
            if trim:
                c = tx.strip(c)
            if fix_case:
                c = tx.fix_case(c, fix_case)
            header = field.name.lower()
            if normalize_emails and "email" in header:
                c = F.lower(c)
            if normalize_phones and any(w in header for w in PHONE_WORDS):
                c = tx.phone_chars(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Remove rows whose cells are all null or blank."""
    keep = F.lit(False)
    for c in df.columns:
        keep = keep | ~tx.is_blank(tx.text_of(df, c))
    return df.filter(keep)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trim headers, name blank ones ``column`` and number repeats ``_1``, ``_2``.

    Repeats are found ignoring case, because column lookup ignores case too.
    """
    seen: dict[str, int] = {}
    taken: set[str] = set()
    names = []
    for raw in df.columns:
        base = raw.strip()
        if not base or base.lower().startswith("unnamed"):
            base = "column"
        name, n = base, seen.get(base.lower(), 0)
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        seen[base.lower()] = n
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)
