"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pr
from .registry import query
from .sheets import table

def _kpi_tables(spark, sf):
    events = table(spark, sf, "events").withColumn("value", F.when(F.col("value") > 5, F.col("value")))
    return {"orders": table(spark, sf, "orders"), "events": events, "embeddings": table(spark, sf, "embeddings")}


_KPI_SQL = """
with e as (select * replace (case when value > 5 then value end as value) from events),
s as (
  select 'orders' as name, count(*) as n, 6 as cols, (select count(*) from (select distinct * from orders)) as u, 0 as m from orders
  union all
  select 'events', count(*), 6, (select count(*) from (select distinct * from e)), count(*) - count(value) from e
  union all
  select 'embeddings', count(*), 3, (select count(*) from (select distinct * from embeddings)), 0 from embeddings)
"""


@query("p1_workspace_kpis", _KPI_SQL + """
select 3 as total_files, 3 as total_sheets, cast(sum(n) as bigint) as total_rows, cast(sum(u) as bigint) as unique_rows,
  cast(sum(n) - sum(u) as bigint) as duplicate_rows, cast(sum(m) as bigint) as missing_values, cast(sum(cols) as bigint) as columns_profiled,
  'orders' as largest_file, round(100.0 - 100.0 * sum(m) / sum(n * cols), 2) as data_quality_score,
  round(100.0 - 100.0 * (sum(n) - sum(u)) / sum(n), 2) as validation_score from s""")
def p1(spark, sf):
    tables = ("orders", "events")
    files = [table(spark, sf, t).select(F.lit(t).alias("t"), "_metadata.file_path", "_metadata.file_size").distinct() for t in tables]
    sizes = {r["t"]: r["size"] for f in files for r in f.groupBy("t").agg(F.sum("file_size").alias("size")).collect()}
    return pr.summarise(_kpi_tables(spark, sf), sizes)


@query("p2_rows_per_sheet", "select 'customer' as name, count(*) as rows, 5 as cols from customer union all select 'lineitem', count(*), 11 from lineitem")
def p2(spark, sf):
    return pr.per_sheet({n: table(spark, sf, n) for n in ("customer", "lineitem")})


@query("p2_quality_composition", _KPI_SQL + """
select 'Unique' as label, cast(sum(u) as bigint) as value from s union all select 'Duplicates', cast(sum(n) - sum(u) as bigint) from s
union all select 'Missing', cast(sum(m) as bigint) from s""")
def p2_quality(spark, sf):
    return pr.quality_composition(pr.summarise(_kpi_tables(spark, sf)))


def _profile_sql(column: str, dtype: str, source: str) -> str:
    return f"""select '{column}' as "column", '{dtype}' as dtype, count(*) as count, count(*) - count({column}) as nulls,
      count(distinct {column}) + coalesce(max(case when {column} is null then 1 else 0 end), 0) as "unique", min({column}) as min, max({column}) as max,
      round(avg({column}), 4) as mean, median({column}) as median, round(stddev_samp({column}), 4) as std from {source}"""


def _rounded(df):
    return df.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("p3_profile_numeric", _profile_sql("l_extendedprice", "double", "lineitem"))
def p3(spark, sf):
    return _rounded(pr.profile_column(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("p3_profile_nulls", _profile_sql("v", "double", "(select case when value > 50 then value end as v from events)"))
def p3_nulls(spark, sf):
    df = table(spark, sf, "events").select(F.when(F.col("value") > 50, F.col("value")).alias("v"))
    return _rounded(pr.profile_column(df, "v"))


@query("p3_profile_text", """select 'o_orderpriority' as "column", 'string' as dtype, count(*) as count,
  count(*) - count(o_orderpriority) as nulls, count(distinct o_orderpriority) as "unique", (select string_agg(v || ' (' || n || ')', '; ' order by n desc, v) from (
  select o_orderpriority as v, count(*) as n from orders group by 1 order by n desc, v limit 10)) as top_values from orders""")
def p3_text(spark, sf):
    return pr.profile_column(table(spark, sf, "orders"), "o_orderpriority")


@query("p4_top_values", "select cast(l_partkey as varchar) as value, count(*) as count from lineitem group by l_partkey order by count desc, l_partkey limit 10")
def p4(spark, sf):
    return pr.top_values(table(spark, sf, "lineitem"), "l_partkey", 10, null_label="—")


@query("p4_top_values_with_null", """select coalesce(v, '—') as value, count(*) as count from
  (select case when o_orderstatus <> 'F' then o_orderpriority end as v from orders) group by v order by count desc, v nulls first limit 4""")
def p4_null(spark, sf):
    df = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("v"))
    return pr.top_values(df, "v", 4, null_label="—")


@query("p5_sampled_profile", """with c as (select cast(50000 as double) / count(*) as f from lineitem),
  s as (select l_quantity from lineitem, c where f >= 1 or substr(md5(l_orderkey || '|' || l_linenumber), 1, 8) < lower(printf('%08x', cast(floor(f * 4294967296) as bigint))))
  select 'l_quantity' as "column", 'double' as dtype, count(*) as count, 0 as nulls, count(distinct l_quantity) as "unique", min(l_quantity) as min, max(l_quantity) as max,
  round(avg(l_quantity), 4) as mean, median(l_quantity) as median, round(stddev_samp(l_quantity), 4) as std, (select least(f, 1.0) from c) as sampled_fraction from s""")
def p5(spark, sf):
    return _rounded(pr.profile_column(table(spark, sf, "lineitem"), "l_quantity", sample_rows=50_000, sample_by=["l_orderkey", "l_linenumber"]))


def _all_sql() -> str:
    numbers = ["o_orderkey", "o_custkey", "o_totalprice"]
    texts = ["o_orderstatus", "o_orderpriority", "o_orderdate"]
    parts = []
    for c in numbers + texts:
        metrics = {"count": "count(*)", "nulls": f"count(*) - count({c})", "unique": f"count(distinct {c})"}
        if c in numbers:
            metrics |= {"min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "median": f"median({c})"}
        parts += [f"select '{c}' as \"column\", '{m}' as metric, round(cast({e} as double), 2) as value from orders" for m, e in metrics.items()]
    return " union all ".join(parts)


@query("p6_profile_all_columns", _all_sql())
def p6(spark, sf):
    return pr.profile_all(table(spark, sf, "orders")).withColumn("value", F.round("value", 2))


@query("p7_top_values_without_null", """select v as value, count(*) as count from
  (select case when o_orderstatus <> 'F' then o_orderpriority end as v from orders) where v is not null group by v order by count desc, v limit 10""")
def p7(spark, sf):
    df = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("v"))
    return pr.top_values(df, "v", 10, nulls=False)


@query("p8_row_duplicates", """with t as (select * from lineitem union all select * from lineitem where l_orderkey % 10 = 0)
  select count(*) as total_rows, (select count(*) from (select distinct * from t)) as unique_rows, count(*) - (select count(*) from (select distinct * from t)) as duplicate_rows from t""")
def p8(spark, sf):
    rows = table(spark, sf, "lineitem")
    return pr.row_duplicate_kpi(rows.union(rows.filter("l_orderkey % 10 = 0")))


@query("p8_nested_duplicates", """with t as (select embedding, label from embeddings union all select embedding, null from embeddings union all
    select case when vec_id % 2 = 0 then list_concat(embedding, [null]) else embedding end, label from embeddings)
  select count(*) as total_rows, (select count(*) from (select distinct * from t)) as unique_rows, count(*) - (select count(*) from (select distinct * from t)) as duplicate_rows from t""")
def p8_nested(spark, sf):
    rows = table(spark, sf, "embeddings").select("embedding", "label", "vec_id")
    longer = F.when(F.col("vec_id") % 2 == 0, F.concat("embedding", F.array(F.lit(None).cast("float")))).otherwise(F.col("embedding"))
    none = rows.withColumn("label", F.lit(None).cast("int"))
    return pr.row_duplicate_kpi(rows.union(none).union(rows.withColumn("embedding", longer)).drop("vec_id"))


@query("p9_histogram", """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
  c as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) as bin, count(*) as n from lineitem, b group by 1)
  select cast(g.bin as integer) as bin, round(lo + g.bin * ((hi - lo) / 20), 4) as low, round(lo + (g.bin + 1) * ((hi - lo) / 20), 4) as high, coalesce(n, 0) as count
  from (select unnest(range(20)) as bin) g cross join b left join c on c.bin = g.bin""")
def p9(spark, sf):
    return pr.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("p10_category_shares", """select c_mktsegment as label, round(sum(c_acctbal), 2) as value, round(100.0 * sum(c_acctbal) / (select sum(c_acctbal) from customer), 6) as share
  from customer group by 1""")
def p10(spark, sf):
    return pr.shares(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal").withColumns({"value": F.round("value", 2), "share": F.round("share", 6)})


def _card_sql(source: str, columns: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", '{t}' as dtype, count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) + "
        f"coalesce(max(case when {c} is null then 1 else 0 end), 0) as \"unique\" from {source}" for c, t in columns.items()
    )


@query("s6_dataset_card", _card_sql("part", {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}))
def s6(spark, sf):
    return pr.describe(table(spark, sf, "part"))


@query("s6_preview", "select * from orders order by o_orderkey limit 100")
def s6_preview(spark, sf):
    return pr.preview(table(spark, sf, "orders"), 100, ["o_orderkey"])
