"""Validation and relationship queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import crossfile as xf
from ..operators import query as qy
from ..operators import relations as rl
from ..operators import validate as va
from .registry import ORACLES, query
from .sheets import CHECKED, contact_sheets, frame, select_sql, table, RECORDS_SQL

_T = f"t as ({select_sql('customer', CHECKED)})"
_EMAIL = r"^[\w.+\-]+@[\w\-]+\.[\w\-.]+$"
_DATES = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d %b %Y", "%d %B %Y", "%Y-%m-%d %H:%M:%S"]
_DIGITS = "length(regexp_replace({c}, '[^0-9]', '', 'g'))"


def _issue_sql(column: str, test: str, severity: str, rule: str, message: str) -> str:
    return (f"select row_id as \"row\", '{column}' as \"column\", cast({column} as varchar) as value, '{severity}' as severity, '{rule}' as rule, "
            f"'{message}' as message from t where {column} is not null and cast({column} as varchar) <> '' and ({test})")


def _bad_phone(c: str) -> str:
    d = _DIGITS.format(c=c)
    return f"{d} < 6 or {d} > 15"


_BAD_DATE = "coalesce(" + ", ".join(f"try_strptime(created_date, '{f}')" for f in _DATES) + ") is null"
# Rule names, messages and patterns that the checks must give.
_RULES = {
    "invalid_email": _issue_sql("contact_email", f"not regexp_matches(contact_email, '{_EMAIL}')", "error", "invalid_email", "Not a valid email"),
    "invalid_phone": " union all ".join([
        _issue_sql("contact_name", _bad_phone("contact_name"), "error", "invalid_phone", "Phone length invalid"),
        _issue_sql("contact_email", f"regexp_matches(contact_email, '{_EMAIL}') and ({_bad_phone('contact_email')})", "error", "invalid_phone", "Phone length invalid"),
        _issue_sql("phone", _bad_phone("phone"), "error", "invalid_phone", "Phone length invalid"),
    ]),
    "invalid_gst": _issue_sql("gst_no", "not regexp_matches(upper(gst_no), '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9]$')", "warning", "invalid_gst", "Not a GSTIN pattern"),
    "invalid_zip": _issue_sql("shipping_zip", "not regexp_matches(shipping_zip, '^[0-9]{3,10}(-[0-9]{3,5})?$')", "warning", "invalid_zip", "ZIP/PIN pattern invalid"),
    "invalid_date": _issue_sql("created_date", _BAD_DATE, "warning", "invalid_date", "Unrecognised date"),
}


def _checked(spark, sf):
    return frame(spark, sf, "customer", CHECKED)


def _cell_query(name: str, rule: str):
    query(name, f"with {_T} {_RULES[rule]}")(lambda spark, sf: va.cell_issues(_checked(spark, sf), "row_id", [rule]))


_HEADER_SQL = "select -1 as \"row\", 'column_9' as \"column\", cast(null as varchar) as value, 'warning' as severity, 'missing_header' as rule, 'Column has missing / auto-generated header' as message"
_NULL_COLUMNS = [c for c in CHECKED if c != "row_id"]
_NULL_SQL = " union all ".join(
    f"select -1 as \"row\", '{c}' as \"column\", cast(null as varchar) as value, 'info' as severity, 'null_values' as rule, "
    f"count(*) - count({c}) || ' null / missing values' as message from t having count(*) > count({c})" for c in _NULL_COLUMNS)


def _outlier_sql(column: str) -> str:
    pick = "list_sort(list({c}))[cast(floor({p} * (count({c}) - 1) + 0.5) as bigint) + 1]"
    q1, q3 = pick.format(c=column, p="0.25"), pick.format(c=column, p="0.75")
    value = f"cast({column} as varchar)"
    return (f"select row_id as \"row\", '{column}' as \"column\", {value} as value, 'info' as severity, 'outlier' as rule, "
            f"printf('Outside [%.2f, %.2f]', cast(q1 - 1.5 * (q3 - q1) as double), cast(q3 + 1.5 * (q3 - q1) as double)) as message "
            f"from t, (select {q1} as q1, {q3} as q3 from t where {column} is not null) b where q3 <> q1 and ({column} < q1 - 1.5 * (q3 - q1) or {column} > q3 + 1.5 * (q3 - q1))")


_OUTLIER_SQL = " union all ".join(f"({_outlier_sql(c)})" for c in ("column_9", "balance"))


@query("q1_missing_header", _HEADER_SQL)
def q1(spark, sf):
    return va.validate(_checked(spark, sf), "row_id").filter(F.col("rule") == "missing_header")


@query("q2_null_values", f"with {_T} {_NULL_SQL}")
def q2(spark, sf):
    return va.null_issues(_checked(spark, sf).drop("row_id"))


_cell_query("q3_invalid_email", "invalid_email")
_cell_query("q4_invalid_phone", "invalid_phone")
_cell_query("q5_invalid_gst", "invalid_gst")
_cell_query("q6_invalid_zip", "invalid_zip")
_cell_query("q7_invalid_date", "invalid_date")


@query("q8_outliers", f"with {_T} {_OUTLIER_SQL}")
def q8(spark, sf):
    return va.outlier_issues(_checked(spark, sf), "row_id")


_ALL_SQL = f"with {_T}, i as (({_HEADER_SQL}) union all ({_NULL_SQL}) union all " + " union all ".join(f"({s})" for s in _RULES.values()) + f" union all {_OUTLIER_SQL})"


@query("q10_validate", _ALL_SQL + " select * from i")
def q10(spark, sf):
    return va.validate(_checked(spark, sf), "row_id")


@query("t4_cross_filter_missing", _ALL_SQL + " select * from i")
def t4_missing(spark, sf):
    return qy.cross_filter(_checked(spark, sf), "row_id", segment="Missing")


@query("q10_issue_counts", _ALL_SQL + " select severity, count(*) as count from i group by 1")
def q10_counts(spark, sf):
    return va.issue_counts(va.validate(_checked(spark, sf), "row_id"))


@query("q9_quality_score", _ALL_SQL + """ select greatest(0.0, round(100.0 - 100.0 * sum(case severity when 'error' then 3 when 'warning' then 2 else 1 end)
  / ((select count(*) from t) * 8), 2)) as quality_score from i""")
def q9(spark, sf):
    df = _checked(spark, sf)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return va.quality_score(va.validate(df, "row_id"), rows, len(df.columns) - 1)


def _light_sql() -> str:
    parts = []
    for c in _NULL_COLUMNS:
        text = f"cast({c} as varchar)"
        head = f"select row_id + 1 as \"row\", '{c}' as \"column\", "
        parts.append(head + f"cast(null as varchar) as value, 'warning' as severity, 'missing_value' as rule, 'Missing value in column ''{c}''' as message from t where {c} is null or {text} = ''")
        if "email" in c:
            parts.append(head + f"{text}, 'error', 'invalid_email', 'Invalid email address format' from t where {text} <> '' and not contains({text}, '@')")
        if "phone" in c:
            parts.append(head + f"{text}, 'warning', 'invalid_phone', 'Suspicious phone number format' from t where {text} <> '' and {_DIGITS.format(c=text)} < 7")
    return " union all ".join(parts)


@query("q11_light_rules", f"with {_T} {_light_sql()}")
def q11(spark, sf):
    return va.validate(_checked(spark, sf), "row_id", profile="light")


@query("q11_light_score", f"with {_T}, i as ({_light_sql()}) select greatest(0.0, round(100.0 - 100.0 * count(*) / ((select count(*) from t) * 8), 1)) as quality_score from i")
def q11_score(spark, sf):
    df = _checked(spark, sf)
    return va.quality_score(va.validate(df, "row_id", profile="light"), df.agg(F.count(F.lit(1))).scalar(), 8, profile="light")


def _missing_sql() -> str:
    columns = {0: [("name", "Customer Name"), ("address", "Office Address"), ("city", "Town"), ("state", "Province"), ("phone", "Contact Number"), ("email", "Mail ID")],
               1: [("name", "Full Name"), ("company", "Company"), ("address", "Address"), ("city", "City"), ("state", "State"), ("phone", "Mobile"), ("email", "Email Address"), ("gst", "GST Number")]}
    return f"with {RECORDS_SQL} " + " union all ".join(
        f"select source_file, sheet_name, rn as row_number, folder_path, '{h}' as missing_column, 'Field ''{h}'' is empty' as details from rec "
        f"where src = {s} and trim(coalesce({c}, '')) = ''" for s, cols in columns.items() for c, h in cols)


MISSING_SQL = _missing_sql()


@query("x6_missing_cells", MISSING_SQL)
def x6(spark, sf):
    return xf.missing_cells(contact_sheets(spark, sf))


# Table prefixes hide equal column names, so they are removed for discovery.
_LINKED = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "documents": ["doc_id", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"],
}


def _plain(table_name: str, column: str) -> str:
    return column if table_name in ("documents", "labels") else column.split("_", 1)[1]


def _linked(spark, sf):
    return {t: table(spark, sf, t).select(*[F.col(c).alias(_plain(t, c)) for c in cols]) for t, cols in _LINKED.items()}


def _relation_sql() -> str:
    parts = []
    for a, b in combinations(_LINKED, 2):
        for ca in _LINKED[a]:
            for cb in _LINKED[b]:
                if _plain(a, ca) == _plain(b, cb):
                    parts.append(f"""select '{a}' as la, '{_plain(a, ca)}' as lc, '{b}' as ra, '{_plain(b, cb)}' as rc,
                      (select count(distinct {ca}) from {a}) as na, (select count(distinct {cb}) from {b}) as nb,
                      (select count(*) from (select distinct cast({ca} as varchar) as v from {a} intersect select distinct cast({cb} as varchar) from {b}) where v is not null) as n""")
    return " union all ".join(parts)


_RELATIONS = f"""with p as ({_relation_sql()}), o as (select *, n / na as ab, n / nb as ba from p where n >= 5),
  f as (select * from o where greatest(ab, ba) >= 0.6)"""
_CARD = "case when ab > 0.98 and ba > 0.98 then '1:1' when ba > 0.98 then 'N:1' when ab > 0.98 then '1:N' else 'N:N' end"
_REASON = "'Same column name; ' || printf('%.0f', ab * 100) || '% / ' || printf('%.0f', ba * 100) || '% value overlap'"


@query("r1_key_candidates", """select 'documents' as dataset, c as "column" from (select unnest(['doc_id', 'lang', 'source', 'n_chars']) as c)
  union all select 'documents', 'text' from documents having count(distinct text) / count(*) <= 0.95 or avg(length(text)) <= 40
  union all select 'benchmark', 'item_id' union all select 'benchmark', 'text' from benchmark having count(distinct text) / count(*) <= 0.95 or avg(length(text)) <= 40
  union all select 'customer', c from (select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) as c)""")
def r1(spark, sf):
    rows = [(t, c) for t in ("documents", "benchmark", "customer") for c in rl.fk_candidates(table(spark, sf, t))]
    return spark.createDataFrame(rows, 'dataset string, column string')


@query("r2_relationships", _RELATIONS + f""" select la as left_dataset, lc as left_column, ra as right_dataset, rc as right_column, round(ab, 4) as overlap, round(ba, 4) as reverse_overlap,
  n as shared_values, {_CARD} as cardinality, round(100.0 * (ab + ba) / 2, 2) as confidence, {_REASON} as reason from f""")
def r2(spark, sf):
    return rl.discover_relationships(_linked(spark, sf))


@query("r4_relationship_table", _RELATIONS + f""" select la || '.' || lc as "left", ra || '.' || rc as "right", {_CARD} as cardinality, round(100.0 * (ab + ba) / 2, 2) as confidence,
  n as shared, {_REASON} as reason from f""")
def r4(spark, sf):
    return rl.relationship_table(rl.discover_relationships(_linked(spark, sf)))


@query("r3_loose_relationships", _RELATIONS.replace("n >= 5", "n >= 3").replace(">= 0.6", ">= 0.5") + f""" select la as left_dataset, lc as left_column, ra as right_dataset, rc as right_column,
  {_CARD} as cardinality, round(100.0 * (ab + ba) / 2, 2) as confidence from f""")
def r3(spark, sf):
    return rl.discover_relationships(_linked(spark, sf), 0.5, 3).select("left_dataset", "left_column", "right_dataset", "right_column", "cardinality", "confidence")


# All columns of all given tables; which of them may be keys is left to ``fk_candidates``. Kinds: i whole number, f floating, s string, t time, v vector.
_GIVEN = {
    "region": "r_regionkey:i r_name:s", "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s", "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:f props:s", "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:v label:i", "pages": "page_id:i url:s html:s", "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i", "conversations": "conv_id:i turn:i role:s text:s",
}
_PREFIXED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _bare(table_name: str, column: str) -> str:
    return column.split("_", 1)[1] if table_name in _PREFIXED else column


def _all_linked(spark, sf):
    frames = {t: table(spark, sf, t) for t in _GIVEN}
    return {t: df.select(*[F.col(c).alias(_bare(t, c)) for c in df.columns]) for t, df in frames.items()}


def _all_relation_sql() -> str:
    columns = {t: [tuple(c.split(":")) for c in cols.split()] for t, cols in _GIVEN.items()}
    parts = []
    for a, b in combinations(columns, 2):
        for ca, ka in columns[a]:
            for cb, kb in columns[b]:
                if "f" in (ka, kb) or not rl.names_compatible(_bare(a, ca), _bare(b, cb)):
                    continue
                tests = [f"(select count(distinct {c}) / count(*) <= 0.95 or coalesce(avg(length({c})), 0) <= 40 from {t})" for t, c, k in ((a, ca, ka), (b, cb, kb)) if k == "s"]
                parts.append(f"""select '{a}' as la, '{_bare(a, ca)}' as lc, '{b}' as ra, '{_bare(b, cb)}' as rc,
                  (select count(distinct {ca}) from {a}) as na, (select count(distinct {cb}) from {b}) as nb,
                  (select count(*) from (select distinct cast({ca} as varchar) as v from {a} intersect select distinct cast({cb} as varchar) from {b}) where v is not null) as n
                  where {" and ".join(tests) or "true"}""")
    return " union all ".join(parts)


def _all_tables(name: str) -> str:
    return ORACLES[name].replace(_relation_sql(), _all_relation_sql())


@query("r2_all_relationships", _all_tables("r2_relationships"))
def r2_all(spark, sf):
    return rl.discover_relationships(_all_linked(spark, sf))


@query("r3_all_loose_relationships", _all_tables("r3_loose_relationships"))
def r3_all(spark, sf):
    return rl.discover_relationships(_all_linked(spark, sf), 0.5, 3).select("left_dataset", "left_column", "right_dataset", "right_column", "cardinality", "confidence")


@query("r4_all_relationship_table", _all_tables("r4_relationship_table"))
def r4_all(spark, sf):
    return rl.relationship_table(rl.discover_relationships(_all_linked(spark, sf)))
