"""File, sink and stream queries over files that Spark writes from the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources import delimited as dl
from ..sources import inventory as iv
from ..sources import sinks
from ..streaming import live
from . import reports
from .registry import query
from .sheets import ACCOUNTS, frame, table


# What a written file is meant to hold.
FILE_BYTES = 1 << 25


def scratch(spark) -> str:
    """A new folder next to the session's checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _save(df, folder: str, key: str, parts: int = 4, sep: str = ",") -> str:
    """Write CSV files whose content depends only on the data, so that two writes give equal files.

    Tables of more than ``parts`` times ``FILE_BYTES`` are written to more files, so that no task grows with the table.
    """
    texts = [F.col(f.name) for f in df.schema if isinstance(f.dataType, T.StringType)]
    rest = F.lit(12 * (len(df.columns) - len(texts)))
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts], rest)
    size = df.agg(F.sum(width)).first()[0] or 0
    df.repartition(max(parts, -(-size // FILE_BYTES)), key).sortWithinPartitions(key).write.options(**sinks.CSV_OPTIONS).option("sep", sep).mode("overwrite").csv(folder)
    return folder


@query("s1_file_inventory", "select 'orders' as folder, 'csv' as extension, true as has_size union all select 'sub/customer', 'csv', true")
def s1(spark, sf):
    root = scratch(spark)
    _save(table(spark, sf, "orders"), f"{root}/orders", "o_orderkey")
    _save(table(spark, sf, "customer"), f"{root}/sub/customer", "c_custkey")
    found = iv.file_inventory(spark, root)
    return found.groupBy("folder", "extension").agg((F.sum("size") > 0).alias("has_size"))


@query("s2_read_delimited", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, cast(o_orderdate as date) as day from orders")
def s2(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    return dl.read_delimited(spark, _save(orders, f"{scratch(spark)}/orders", "o_orderkey"))


@query("s2_read_tab_separated", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def s2_tab(spark, sf):
    root = scratch(spark)
    folder = _save(table(spark, sf, "customer"), f"{root}/customer.tsv", "c_custkey", sep="\t")
    return dl.read_delimited(spark, folder)


@query("s2_documents_round_trip", "select doc_id, text, lang, source, n_chars from documents")
def s2_documents(spark, sf):
    """Long texts with quotes and line breaks, written and read back with types of their own."""
    return dl.read_delimited(spark, _save(table(spark, sf, "documents"), f"{scratch(spark)}/documents", "doc_id"))


@query("s2_events_round_trip", "select event_id, ts, user_id, event_type, value, props from events")
def s2_events(spark, sf):
    return dl.read_delimited(spark, _save(table(spark, sf, "events"), f"{scratch(spark)}/events", "event_id"))


@query("s2_lost_cells", """select 'o_orderkey' as "column", 0 as lost union all select 'o_custkey', 0 union all select 'o_orderstatus', count(*) from orders
  union all select 'o_totalprice', count(*) from orders union all select 'o_orderdate', 0 union all select 'o_orderpriority', 0""")
def s2_lost(spark, sf):
    orders = table(spark, sf, "orders")
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("o_orderkey", "o_custkey", "o_orderstatus") else T.TimestampType() if c == "o_orderdate" else T.StringType())
                           for c in orders.columns])
    price = T.StructType([T.StructField(f.name, T.LongType() if f.name == "o_totalprice" else f.dataType) for f in schema])
    text = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    path = _save(text, f"{scratch(spark)}/orders", "o_orderkey")
    return dl.lost_cells(spark, path, price)


@query("s4_read_many", "select 'nation' as name, count(*) as rows, 3 as cols from nation union all select 'supplier', count(*), 4 from supplier")
def s4(spark, sf):
    root = scratch(spark)
    paths = [_save(table(spark, sf, t), f"{root}/{t}", k) for t, k in (("nation", "n_nationkey"), ("supplier", "s_suppkey"))]
    loaded = dl.read_many(spark, [*paths, f"{root}/absent"])
    counts = [df.agg(F.lit(p.rsplit("/", 1)[-1]).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("cols")) for p, df in loaded.items()]
    return counts[0].unionByName(counts[1])


@query("s4_read_union", """select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey, null as s_suppkey, null as s_name, null as s_nationkey, null as balance from nation
  union all select null, null, null, cast(s_suppkey as varchar), s_name, cast(s_nationkey as varchar), cast(cast(round(s_acctbal * 100) as bigint) as varchar) from supplier""")
def s4_union(spark, sf):
    root = scratch(spark)
    a = _save(table(spark, sf, "nation"), f"{root}/nation", "n_nationkey")
    cents = F.round(F.col("s_acctbal") * 100).cast("long").alias("balance")
    b = _save(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", cents), f"{root}/supplier", "s_suppkey")
    return dl.read_union(spark, [a, b]).drop("_source_file")


def _discovery_root(spark, sf) -> str:
    root = scratch(spark)
    orders = table(spark, sf, "orders")
    for name in ("a", "b", "c/deep"):
        _save(orders, f"{root}/{name}", "o_orderkey")
    _save(table(spark, sf, "customer"), f"{root}/d", "c_custkey")
    return root


@query("s7_discovery", """select folder, rows, case when folder in ('b', 'c/deep') then rows else 0 end as duplicate_rows, cols from
  (select unnest(['a', 'b', 'c/deep']) as folder, count(*) as rows, 6 as cols from orders union all select 'd', count(*), 5 from customer)""")
def s7(spark, sf):
    report = iv.discover(spark, _discovery_root(spark, sf))
    duplicate = F.sum(F.when(F.col("is_duplicate"), F.col("rows")).otherwise(0))
    return report.groupBy("folder").agg(F.sum("rows").alias("rows"), duplicate.alias("duplicate_rows"), F.max("cols").alias("cols"))


@query("s7_discovery_totals", """select (select count(*) from orders) * 3 + (select count(*) from customer) as total_records, 0 as empty_sheets_count""")
def s7_totals(spark, sf):
    return iv.discovery_totals(iv.discover(spark, _discovery_root(spark, sf))).select("total_records", "empty_sheets_count")


@query("s8_incremental_discovery", "select 'orders' as folder, false as reanalysed, count(*) as rows from orders union all select 'supplier', true, count(*) from supplier")
def s8(spark, sf):
    root, manifest = scratch(spark), f"{scratch(spark)}/manifest"
    _save(table(spark, sf, "orders"), f"{root}/orders", "o_orderkey")
    iv.discover_incremental(spark, root, manifest)
    _save(table(spark, sf, "supplier"), f"{root}/supplier", "s_suppkey")
    return iv.discover_incremental(spark, root, manifest).groupBy("folder", "reanalysed").agg(F.sum("rows").alias("rows"))


@query("s9_write_tables", "select * from orders")
def s9(spark, sf):
    written = sinks.write_tables({t: table(spark, sf, t) for t in ("orders", "customer")}, scratch(spark))
    return spark.read.parquet(written["orders"])


@query("s9_write_csv_and_json", "select fmt, event_id, user_id, event_type, value, props from events, (select unnest(['csv', 'json']) as fmt)")
def s9_formats(spark, sf):
    root, parts = scratch(spark), []
    for fmt in ("csv", "json"):
        path = sinks.write_tables({"events": table(spark, sf, "events")}, f"{root}/{fmt}", fmt)["events"]
        back = dl.read_delimited(spark, path) if fmt == "csv" else spark.read.json(path)
        parts.append(back.select(F.lit(fmt).alias("fmt"), "event_id", "user_id", "event_type", "value", "props"))
    return parts[0].unionByName(parts[1])


@query("s10_summary_json", """select count(*) as total_rows, (select count(*) from (select distinct * from orders)) as unique_rows, true as stamped from orders""")
def s10(spark, sf):
    from ..operators.profile import summarise

    path = f"{scratch(spark)}/summary"
    sinks.write_summary(summarise({"orders": table(spark, sf, "orders")}), path)
    return spark.read.json(path).select("total_rows", "unique_rows", F.col("generated_at").isNotNull().alias("stamped"))


@query("e3_report_package", "select 'duplicates' as name, true as filled union all select 'validation', true union all select 'top_groups', true union all select 'top_issues', true")
def e3(spark, sf):
    out = reports.report_package({"accounts": frame(spark, sf, "customer", ACCOUNTS)}, {"accounts": "row_id"}, scratch(spark))
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("name"), (F.count(F.lit(1)) > 0).alias("filled")) for n, p in out.items() if n != "summary"]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


@query("e4_none_found", "select 'No duplicates detected' as info where (select count(distinct o_orderkey) = count(*) from orders)")
def e4(spark, sf):
    from ..operators.dedupe import detect_exact

    return sinks.duplicates_or_info(detect_exact(table(spark, sf, "orders").withColumn("row_id", F.col("o_orderkey")), "row_id", ["o_orderkey"]))


_ORDER_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
                              T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_orderpriority", T.StringType())])


@query("l1_stream_files", "select * from orders")
def l1(spark, sf):
    root = scratch(spark)
    _save(table(spark, sf, "orders"), f"{root}/in", "o_orderkey")
    stream = live.stream_delimited(spark, f"{root}/in", _ORDER_SCHEMA, files_per_trigger=2)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/ck").option("path", f"{root}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("l2_stream_kpis", """with o as (select o_orderkey // 2 as k, o_custkey, o_orderstatus, o_totalprice, o_orderdate, case when o_custkey % 3 > 0 then o_orderpriority end as p from orders
    union all select o_orderkey // 2, o_custkey, o_orderstatus, o_totalprice, o_orderdate, case when o_custkey % 3 > 0 then o_orderpriority end from orders where o_orderkey % 4 = 0)
  select count(*) as total_rows, (select count(*) from (select distinct * from o)) as unique_rows, count(*) - (select count(*) from (select distinct * from o)) as duplicate_rows,
  count(*) - count(p) as missing_values, round(100.0 - 100.0 * (count(*) - count(p)) / (count(*) * 6), 2) as data_quality_score,
  round(100.0 - 100.0 * (count(*) - (select count(*) from (select distinct * from o))) / count(*), 2) as validation_score from o""")
def l2(spark, sf):
    root = scratch(spark)
    orders = table(spark, sf, "orders").withColumn("o_orderpriority", F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")))
    orders = orders.union(orders.filter("o_orderkey % 4 = 0")).withColumn("o_orderkey", F.expr("o_orderkey div 2"))
    orders.repartition(4).write.parquet(f"{root}/in")
    stream = live.stream_delimited(spark, f"{root}/in", _ORDER_SCHEMA, "parquet", 1)
    live.stream_summary(stream, f"{root}/state", f"{root}/ck").awaitTermination()
    return live.current_summary(spark, f"{root}/state", 6)


_EVENT_MISSING = " + ".join(f"count(*) - count({c})" for c in ("event_id", "ts", "user_id", "event_type", '"value"', "props"))


@query("l2_bounded_kpis", f"""with e as (select * from events union all select * from events where user_id % 3 = 0),
    u as (select count(*) as n from (select distinct * from e)), t as (select count(*) as n, {_EVENT_MISSING} as missing from e)
  select t.n as total_rows, u.n as unique_rows, t.n - u.n as duplicate_rows, missing as missing_values, round(100.0 - 100.0 * missing / (t.n * 6), 2) as data_quality_score,
  round(100.0 - 100.0 * (t.n - u.n) / t.n, 2) as validation_score from t, u""")
def l2_bounded(spark, sf):
    """Events arrive in four parts by time, copies of a third of the users half a day after their first sight; state is kept for a day."""
    root = scratch(spark)
    events = table(spark, sf, "events")
    copies = events.filter("user_id % 3 = 0")
    arriving = events.withColumn("arrival", F.col("ts")).union(copies.withColumn("arrival", F.col("ts") + F.expr("interval 12 hours")))
    low, high = arriving.agg(F.min("arrival"), F.max("arrival")).first()
    for part in range(4):
        start, end = (low + (high - low) * p / 4 for p in (part, part + 1))
        inside = (F.col("arrival") >= F.lit(start)) & (F.lit(part == 3) | (F.col("arrival") < F.lit(end)))
        arriving.filter(inside).drop("arrival").repartition(2).write.mode("append").parquet(f"{root}/in")
    stream = live.stream_delimited(spark, f"{root}/in", events.schema, "parquet", 2)
    live.bounded_summary(stream, "ts", "1 day", f"{root}/state", f"{root}/ck").awaitTermination()
    return live.current_summary(spark, f"{root}/state", 6)
