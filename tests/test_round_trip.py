"""Texts that are written as CSV and read back."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.plans import q_files
from ledgerloom.sources import delimited

ODD = [
    "", None, " ", " a ", "\n", "a\r\nb", "a\rb\r", '"', '""', 'a","b', 'a"\n"', "\\", 'a\\"b', "a\0b", "\0", "﻿a", "#a", "a\x85b c", "12", "2020-01-01", "null",
    'x"y\n' * 400000,
]


def test_documents_come_back_as_they_are(spark, tmp_path):
    """an empty text is not a missing one."""
    rows = [(i, t, "" if i % 5 == 0 else "en", None if i % 3 else "", len(t or "")) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    back = q_files.s2_documents(spark, str(tmp_path))
    assert back.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == rows


def test_empty_cells_have_no_type(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,word,none\n1,"",""\n"",a,\n,,""\n3,b,\n')
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "word": "string", "none": "string"}
    assert list(map(tuple, df.collect())) == [(1, "", ""), (None, "a", None), (None, None, ""), (3, "b", None)]
    lost = delimited.lost_cells(spark, str(tmp_path / "t.csv"), df.schema)
    assert {r["column"]: r.lost for r in lost.collect()} == {"n": 0, "word": 0, "none": 0}


def test_a_failed_job_is_no_table_of_texts(spark, tmp_path, monkeypatch):
    """types are not given up because a task was lost."""
    (tmp_path / "t.csv").write_text("n\n1\n")
    monkeypatch.setattr(delimited, "_failing", lambda rows, tried: rows.select(F.raise_error(F.lit("lost task"))).collect())
    with pytest.raises(PySparkException, match="lost task"):
        delimited.read_delimited(spark, str(tmp_path / "t.csv"))
