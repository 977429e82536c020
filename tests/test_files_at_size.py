"""Files that are larger than what a task may hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import q_files
from ledgerloom.sources import delimited, inventory


@pytest.mark.parametrize("split", ["700b", "128m"])
def test_copies_among_large_files(spark, tmp_path, monkeypatch, split):
    """contents are never one value, and copies are still found, however files are split."""
    text = "a,b\r\n" + "".join(f"{i},é{i % 7}\r\n" for i in range(300))
    lines = text.split("\n")
    files = {
        "a.csv": text, "b copy.csv": text, "c/deep.csv": text, "cut.csv": text[:-1], "swapped.csv": "\n".join([lines[0], lines[2], lines[1], *lines[3:]]),
        "twice.csv": text + text, "small.csv": "a,b\n1,2\n", "small2.csv": "a,b\n1,2\n",
    }
    for name, content in files.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())
    monkeypatch.setattr(inventory, "MAX_BYTES", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.relative_path: r for r in inventory.discover(spark, str(tmp_path / "in"), max_bytes=100).collect()}
        digests = {r.relative_path: r.digest for r in inventory._content(spark, str(tmp_path / "in"), 100).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {n: r.duplicate_of for n, r in got.items() if r.is_duplicate} == {"b copy.csv": "a.csv", "c/deep.csv": "b copy.csv", "small2.csv": "small.csv"}
    assert {n: (r.rows, r.columns) for n, r in got.items()} == {n: (601 if n == "twice.csv" else 300 if n[:5] != "small" else 1, ["a", "b"]) for n in files}
    assert {got[n].status for n in ("a.csv", "cut.csv")} == {"unhashed"} and got["c/deep.csv"].status == "duplicate"
    seen = _DIGESTS.setdefault("all", digests)
    assert digests == seen and len(set(digests.values())) == 5


_DIGESTS = {}


def test_default_never_loads_large_contents():
    assert inventory.MAX_BYTES <= 1 << 24


def test_written_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """the number of files follows from the data, and two writes give the same files."""
    monkeypatch.setattr(q_files, "FILE_BYTES", 2000)
    df = spark.range(500).select("id", F.repeat(F.lit("x\n"), 20).alias("v"))
    for name in ("one", "two"):
        q_files._save(df, f"{tmp_path}/{name}", "id")
    files = {n: sorted(p.read_bytes() for p in (tmp_path / n).glob("part-*")) for n in ("one", "two")}
    assert files["one"] == files["two"] and len(files["one"]) > 8 and max(map(len, files["one"])) < 8000
    assert delimited.read_delimited(spark, f"{tmp_path}/one").exceptAll(df).isEmpty()


def test_types_that_only_late_rows_refuse(spark, tmp_path, monkeypatch):
    """only types that the first rows leave open are tried on all rows, and each is tried on all of them."""
    tried = []
    real = delimited._failing
    monkeypatch.setattr(delimited, "_failing", lambda rows, kinds: tried.append([[k[0] for k in x] for x in kinds]) or real(rows, kinds))
    head = "n,late,day,at,word,none,odd\n"
    body = "".join(f"{i},{i},2024-01-0{1 + i % 9},2024-01-01 00:00:0{i % 9},w{i},,{' 1' if i % 2 else 'NaN'}\n" for i in range(2000))
    (tmp_path / "t.csv").write_text(head + body + "5,text,2024-01-01,2024-01-02,w,,+Infinity\n")
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "late": "string", "day": "date", "at": "timestamp", "word": "string", "none": "string", "odd": "double"}
    assert df.count() == 2001 and df.agg(F.max("day")).first()[0] == dt.date(2024, 1, 9)
    assert tried[1][4] == [] and tried[1][0] == ["bigint", "double"] and tried[1][6] == ["double"]
