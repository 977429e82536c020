"""Run registered queries next to their SQL oracle.

usage: python tests/oracle_check.py [sf_dir] [name-part ...]
"""

import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "<null>"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int,)) or hasattr(v, "dtype") and v.dtype.kind in "iu":
            return str(int(v))
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
            return str(int(v)) if float(v).is_integer() else repr(round(float(v), 9))
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, pd.Timestamp):
            return str(v)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark, sf_dir, name, fn, sql, con):
    t = time.time()
    got = fn(spark, sf_dir)
    pdf = pd.DataFrame([r.asDict(recursive=True) for r in got.collect()], columns=got.columns, dtype=object)
    took = time.time() - t
    if sql is None:
        return "rows-only", len(pdf), took, ""
    rel = con.sql(sql)
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    if sorted(pdf.columns) != sorted(want.columns):
        return "COLUMNS", len(pdf), took, f"{sorted(pdf.columns)} vs {sorted(want.columns)}"
    a, b = canonical(pdf), canonical(want)
    if a == b:
        return "ok", len(a), took, ""
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return "DIFF", len(a), took, f"{len(a)} vs {len(b)} rows\n   columns {sorted(pdf.columns)}\n   spark  {only_a}\n   oracle {only_b}"


def main():
    import __spark_entry__ as entry
    from ledgerloom.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="10g",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        try:
            status, rows, took, note = compare(spark, sf, name, fn, oracles.get(name), con)
        except Exception as e:  # noqa: BLE001
            status, rows, took, note = "ERROR", 0, 0.0, str(e)[:1500]
        print(f"{status:10} {name:40} rows={rows:<8} {took:6.2f}s {note}", flush=True)
        if status not in ("ok", "rows-only"):
            bad.append(name)
        elif rows == 0:
            print("           ^ no rows")
    print("failed:", bad)


if __name__ == "__main__":
    main()
