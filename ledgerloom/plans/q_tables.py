"""Join, pivot, search and SQL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as mg
from ..operators import pivot as pv
from ..operators import query as qy
from .registry import query
from .sheets import table

# Two order extracts that share keys and disagree on some columns.
_LEFT = {"custkey": "case when o_orderkey % 17 = 0 then null else o_custkey end", "orderkey": "o_orderkey", "status": "o_orderstatus",
         "note": "case when o_orderkey % 3 = 0 then null else o_orderpriority end"}
_RIGHT = {"custkey": "case when c_custkey % 19 = 0 then null else c_custkey end", "status": "case when c_custkey % 2 = 0 then 'O' else 'F' end",
          "note": "case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then '2-HIGH' else c_mktsegment end", "balance": "c_acctbal"}
_SIDES = "l as (select " + ", ".join(f"{e} as {n}" for n, e in _LEFT.items()) + " from orders), r as (select " + ", ".join(
    f"{e} as {n}" for n, e in _RIGHT.items()) + " from customer)"
_PAIR = "l.orderkey, l.status, l.note, r.status as status_right, r.note as note_right, r.balance"


def _sides(spark, sf):
    left = table(spark, sf, "orders").selectExpr(*[f"{e} as {n}" for n, e in _LEFT.items()])
    right = table(spark, sf, "customer").selectExpr(*[f"{e} as {n}" for n, e in _RIGHT.items()])
    return left, right


def _join_sql(kind: str, key: str) -> str:
    return f"with {_SIDES} select {key}, {_PAIR} from l {kind} join r on l.custkey = r.custkey"


@query("j1_inner_join", _join_sql("inner", "cast(l.custkey as varchar) as custkey"))
def j1(spark, sf):
    return mg.merge(*_sides(spark, sf), "custkey", "inner")


@query("j1_join_on_shared", f"with {_SIDES} select cast(l.custkey as varchar) as custkey, l.status, l.note, l.orderkey, r.balance from l join r on l.custkey = r.custkey and l.status = r.status and l.note = r.note")
def j1_shared(spark, sf):
    return mg.merge(*_sides(spark, sf))


@query("j2_left_join", _join_sql("left", "cast(l.custkey as varchar) as custkey"))
def j2(spark, sf):
    return mg.merge(*_sides(spark, sf), "custkey", "left")


@query("j3_right_join", _join_sql("right", "cast(r.custkey as varchar) as custkey"))
def j3(spark, sf):
    return mg.merge(*_sides(spark, sf), "custkey", "right")


@query("j4_full_join", _join_sql("full", "cast(l.custkey as varchar) as custkey, cast(r.custkey as varchar) as custkey_right"))
def j4(spark, sf):
    return mg.merge(*_sides(spark, sf), "custkey", "outer")


@query("j6_join_conflicts", f"""with {_SIDES}, j as (select l.custkey, {_PAIR} from l join r on l.custkey = r.custkey)
  select 'status' as "column", cast(custkey as varchar) as custkey, status as left_value, status_right as right_value from j where status <> status_right
  union all select 'note', cast(custkey as varchar), note, note_right from j where note <> note_right""")
def j6(spark, sf):
    return mg.merge_conflicts(mg.merge(*_sides(spark, sf), "custkey", "inner"), ["custkey"])


@query("j7_join_stats", f"""with {_SIDES}, j as (select l.custkey from l join r on l.custkey = r.custkey),
  dl as (select count(*) as n from (select distinct custkey from l)), dr as (select count(*) as n from (select distinct custkey from r)),
  dj as (select count(*) as n from (select distinct custkey from j))
  select count(*) as rows, count(custkey) as matched, greatest(0, (select n from dl) - (select n from dj)) as unmatched_left,
  greatest(0, (select n from dr) - (select n from dj)) as unmatched_right,
  (select count(*) from l where not exists (select 1 from r where r.custkey = l.custkey)) as left_without_partner,
  (select count(*) from r where not exists (select 1 from l where r.custkey = l.custkey)) as right_without_partner from j""")
def j7(spark, sf):
    return mg.merge_stats(*_sides(spark, sf), "custkey", "inner")


def _resolve_sql(status: str, note: str) -> str:
    return f"with {_SIDES} select cast(l.custkey as varchar) as custkey, l.orderkey, {status} as status, {note} as note, r.balance from l join r on l.custkey = r.custkey"


def _resolve(spark, sf, strategy):
    return mg.resolve_conflicts(mg.merge(*_sides(spark, sf), "custkey", "inner"), strategy)


@query("j8_keep_left", _resolve_sql("l.status", "l.note"))
def j8_left(spark, sf):
    return _resolve(spark, sf, "keep_left")


@query("j8_keep_right", _resolve_sql("r.status", "r.note"))
def j8_right(spark, sf):
    return _resolve(spark, sf, "keep_right")


@query("j8_prefer_non_null", _resolve_sql("coalesce(l.status, r.status)", "coalesce(l.note, r.note)"))
def j8_non_null(spark, sf):
    return _resolve(spark, sf, "prefer_non_null")


def _longest(c: str) -> str:
    return f"case when length(coalesce(l.{c}, '')) >= length(coalesce(r.{c}, '')) then l.{c} else r.{c} end"


@query("j8_keep_longest", _resolve_sql(_longest("status"), _longest("note")))
def j8_longest(spark, sf):
    return _resolve(spark, sf, "keep_longest")


@query("v1_group_pivot", 'select o_orderpriority, round(sum(o_totalprice), 2) as "sum(o_totalprice)" from orders group by 1')
def v1(spark, sf):
    return pv.pivot(table(spark, sf, "orders"), ["o_orderpriority"], None, "o_totalprice", "sum").withColumn("sum(o_totalprice)", F.round("`sum(o_totalprice)`", 2))


_CELLS = {f"{a} · {b}": (a, b) for a in "ANR" for b in "FO"}


def _cross_sql(expr: str) -> str:
    cells = ", ".join(f"{expr.replace('FILTER', f'''filter (where l_returnflag = '{a}' and l_linestatus = '{b}')''')} as \"{name}\"" for name, (a, b) in _CELLS.items())
    return f"select l_linenumber, {cells} from lineitem group by 1"


def _cross(spark, sf, aggregate, value="l_quantity"):
    out = pv.pivot(table(spark, sf, "lineitem"), ["l_linenumber"], ["l_returnflag", "l_linestatus"], value, aggregate)
    return out.select("l_linenumber", *[F.round(f"`{c}`", 4).alias(c) if aggregate in ("mean", "std", "sum", "median") else F.col(f"`{c}`") for c in out.columns[1:]])


@query("v2_cross_tab", _cross_sql("round(sum(l_quantity) FILTER, 4)"))
def v2(spark, sf):
    return _cross(spark, sf, "sum")


@query("v2_cross_tab_distinct", _cross_sql("nullif(count(distinct l_suppkey) FILTER, 0)"))
def v2_distinct(spark, sf):
    return _cross(spark, sf, "count_distinct", "l_suppkey")


@query("v2_cross_tab_median", _cross_sql("round(median(l_extendedprice) FILTER, 4)"))
def v2_median(spark, sf):
    return _cross(spark, sf, "median", "l_extendedprice")


@query("v2_cross_tab_std", _cross_sql("round(stddev_samp(l_discount) FILTER, 4)"))
def v2_std(spark, sf):
    return _cross(spark, sf, "std", "l_discount")


@query("v3_count_table", 'select event_type, count(*) as "count(__count__)" from events group by 1')
def v3(spark, sf):
    return pv.pivot(table(spark, sf, "events"), ["event_type"], aggregate="mean")


@query("v3_sum_count_table", 'select event_type, count(*) as "sum(__count__)" from events group by 1')
def v3_sum(spark, sf):
    return pv.pivot(table(spark, sf, "events"), ["event_type"], aggregate="sum")


_NINE = {
    "sum": "round(coalesce(sum(v), 0), 2)", "mean": "round(avg(v), 4)", "avg": "round(avg(v), 4)", "count": "count(*)",
    "count_distinct": "count(distinct v) + max(case when v is null then 1 else 0 end)", "min": "min(v)", "max": "max(v)",
    "median": "median(v)", "std": "round(stddev_samp(v), 4)",
}


@query("v4_nine_aggregates", "select user_id, " + ", ".join(f"{e} as a_{n}" for n, e in _NINE.items()) + """
  from (select user_id, case when value > 3 then value end as v from events) group by 1""")
def v4(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.when(F.col("value") > 3, F.col("value")).alias("v"))
    digits = {"sum": 2, "mean": 4, "avg": 4, "std": 4}
    out = None
    for name in _NINE:
        part = pv.pivot(df, ["user_id"], None, "v", name).withColumnRenamed(f"{name}(v)", f"a_{name}")
        if name in digits:
            part = part.withColumn(f"a_{name}", F.round(f"a_{name}", digits[name]))
        out = part if out is None else out.join(part, "user_id")
    return out


@query("v5_drill_through", "select * from lineitem where l_returnflag = 'A' and l_linestatus = 'F' and l_linenumber = 3")
def v5(spark, sf):
    keys = pv.header_keys("A · F", ["l_returnflag", "l_linestatus"])
    return pv.drill_through(table(spark, sf, "lineitem"), {"l_linenumber": 3, "unknown": 1, "l_tax": None}, keys)


@query("v6_drill_aggregate", """select round(coalesce(sum(l_quantity), 0), 4) as total, round(avg(l_quantity), 4) as mean, min(l_quantity) as low, max(l_quantity) as high,
  median(l_quantity) as middle, cast(count(*) as double) as n from lineitem where l_returnflag = 'R'""")
def v6(spark, sf):
    rows = pv.drill_through(table(spark, sf, "lineitem"), {"l_returnflag": "R"})
    names = {"total": "sum", "mean": "mean", "low": "min", "high": "max", "middle": "median"}
    out = pv.drill_aggregate(rows, None).withColumnRenamed("value", "n")
    for label, agg in names.items():
        out = out.withColumn(label, F.round(pv.drill_aggregate(rows, "l_quantity", agg).scalar(), 4))
    return out


@query("v7_lenient_pivot", """select coalesce(k, 'N/A') as k, round(coalesce(avg(try_cast(v as double)), 0), 2) as "MEAN(v)" from
  (select case when o_orderkey % 4 = 0 then null else o_orderstatus end as k, case when o_orderkey % 5 = 0 then 'n/a' else cast(o_custkey as varchar) end as v from orders) group by 1""")
def v7(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "case when o_orderkey % 4 = 0 then null else o_orderstatus end as k", "case when o_orderkey % 5 = 0 then 'n/a' else cast(o_custkey as string) end as v")
    return pv.pivot(df, ["k"], None, "v", "mean", lenient=True)


@query("t1_search_column", "select doc_id, lang from documents where contains(lower(text), 'the')")
def t1(spark, sf):
    return qy.search(table(spark, sf, "documents"), "The", "text").select("doc_id", "lang")


@query("t1_search_any_column", "select * from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring') or contains(cast(p_partkey as varchar), 'ring')")
def t1_any(spark, sf):
    return qy.search(table(spark, sf, "part"), "RING")


@query("t2_sort", "select * from supplier order by s_acctbal desc")
def t2(spark, sf):
    return qy.sort(table(spark, sf, "supplier"), "s_acctbal", ascending=False)


@query("t3_page", "select * from orders order by o_totalprice, o_orderkey limit 50 offset 100")
def t3(spark, sf):
    return qy.page(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], 2, 50)


@query("t3_deep_page", "select * exclude (n) from (select *, row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem) where n > 50000 and n <= 50500")
def t3_deep(spark, sf):
    return qy.page(table(spark, sf, "lineitem"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 100, 500)


@query("t3_stored_page", "select * from orders order by o_totalprice, o_orderkey limit 50 offset 350")
def t3_stored(spark, sf):
    return qy.PagedTable.store(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"]).page(7, 50)


@query("t4_cross_filter_value", "select * from events where contains(lower(event_type), 'click')")
def t4(spark, sf):
    return qy.cross_filter(table(spark, sf, "events"), "event_id", column="event_type", value="click")


@query("z1_register_tables", "select 't0' as alias, 'nation' as name, 3 as cols, count(*) as rows from nation union all select 't1', 'lineitem', 11, count(*) from lineitem")
def z1(spark, sf):
    """The registered tables, each counted through the view of its alias."""
    listed = qy.register(spark, {n: table(spark, sf, n) for n in ("nation", "lineitem")})
    counts = qy.sql(spark, "select 't0' as alias, count(*) as rows from t0 union all select 't1', count(*) from t1")
    return listed.join(counts, "alias")


def _z2(spark, sf, text):
    qy.register(spark, {n: table(spark, sf, n) for n in ("orders", "customer", "lineitem", "events")})
    return qy.sql(spark, text + " ;")


def _sql_query(name: str, text: str, oracle: str | None = None):
    query(name, oracle or text)(lambda spark, sf: _z2(spark, sf, text))


_sql_query("z2_sql_join", "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by c_mktsegment")
_sql_query("z2_sql_semi_anti", """select 'semi' as kind, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey)
  union all select 'anti', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
_sql_query("z2_sql_grouping_sets", """select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as int) as g from lineitem
  group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")
_sql_query("z2_sql_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
_sql_query("z2_sql_windows", """select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r,
  lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as run from orders""")
_sql_query("z2_sql_set_operations", """(select o_custkey as k from orders intersect select c_custkey from customer) except select l_suppkey from lineitem""")
_sql_query("z2_sql_range_join", """select count(*) as n from (select user_id, ts from events where event_type = 'click') a join (select ts as t2, user_id as u2 from events where event_type = 'signup') b
  on u2 = user_id and t2 >= ts and t2 < ts + interval 10 hours""")
_sql_query("z2_sql_as_of", """select event_id, last_value(case when event_type = 'signup' then event_id end) ignore nulls over (partition by user_id order by ts, event_id
  rows between unbounded preceding and current row) as last_signup from events""",
  """select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id
  rows between unbounded preceding and current row) as last_signup from events""")
_sql_query("z2_sql_json_dates", """select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n, round(avg(o_totalprice), 2) as mean from orders group by 1, 2""")
_sql_query("z2_sql_props", "select event_type, cast(sum(cast(get_json_object(props, '$.k') as int)) as bigint) as k from events group by event_type",
  "select event_type, cast(sum(cast(props ->> '$.k' as int)) as bigint) as k from events group by event_type")


@query("z2_sql_approximate")
def z2_approx(spark, sf):
    return _z2(spark, sf, "select approx_count_distinct(l_partkey) as parts, approx_percentile(l_quantity, 0.5) as middle from lineitem")
