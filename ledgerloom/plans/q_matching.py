"""Similarity, duplicate and cross-file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import crossfile as xf
from ..operators import dedupe as dd
from ..operators import schema_map as sm
from ..operators import query as qy
from ..operators import similarity as si
from ..session import stable
from .q_quality import MISSING_SQL
from .registry import ORACLES, query
from .sheets import ACCOUNTS, NAMED, RECORDS_SQL, contact_sheets, frame, joined_parts, n_clean, n_exact, n_hc, select_sql, table


def _names(spark, sf, turned: bool = True):
    """Product labels, and the same products spelled differently."""
    part = table(spark, sf, "part")
    other = "p_brand || ' ' || replace(p_name, 'in', 'n')" if turned else "replace(p_name, 'in', 'n') || ' ' || p_brand || ' ' || p_type"
    return part.selectExpr("p_name || ' ' || p_brand as label"), part.selectExpr(f"{other} as label")


def _fuzzy(name: str, scorer: str, threshold: float, turned: bool):
    def run(spark, sf):
        left, right = _names(spark, sf, turned)
        return si.similarity_join(left, right, "label", "label", scorer, threshold).withColumn("score", F.round("score", 4))

    query(name)(run)


_fuzzy("f1_ratio_join", "ratio", 80.0, False)
_fuzzy("f2_partial_join", "partial", 95.0, False)
_fuzzy("f3_token_sort_join", "token_sort", 88.0, True)
_fuzzy("f4_token_set_join", "token_set", 95.0, True)
_fuzzy("f5_weighted_ratio_join", "weighted_ratio", 90.0, True)
_fuzzy("f6_quick_ratio_join", "quick_ratio", 80.0, False)


@query("f7_best_match")
def f7(spark, sf):
    left, right = _names(spark, sf)
    return si.best_match(left, right, "label", "label", "token_sort", 80.0)


@query("f8_top_matches")
def f8(spark, sf):
    left, right = _names(spark, sf)
    return si.top_matches(left, right, "label", "label", 5, "token_sort", 80.0)


_SOUNDEX_FROM = "BFPVCGJKQSXZDTLMNR"


def _soundex_sql(x: str) -> str:
    up = f"upper({x})"
    runs = f"translate(regexp_replace({up}, '[^{_SOUNDEX_FROM}]', '', 'g'), '{_SOUNDEX_FROM}', '111122222222334556')"
    for d in "123456":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    tail = f"case when regexp_matches(substr({up}, 1, 1), '[{_SOUNDEX_FROM}]') then substr({runs}, 2) else {runs} end"
    return f"case when coalesce({x}, '') = '' then '0000' else rpad(substr(substr({up}, 1, 1) || ({tail}), 1, 4), 4, '0') end"


@query("f9_soundex", f"select p_partkey, p_name, {_soundex_sql('p_name')} as code from part")
def f9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", tx.soundex_code(F.col("p_name")).alias("code"))


@query("f10_phonetic_join", f"""with l as (select distinct p_name as v from part), r as (select distinct p_type || 'R' as v from part union select distinct p_name from part),
  b as (select 'left' as side, v as value, {_soundex_sql('v')} as code from l union all select 'right', v, {_soundex_sql('v')} from r)
  select side, value, code, (select count(*) from b o where o.code = b.code and o.side <> b.side) as partners from b
  where exists (select 1 from b o where o.code = b.code and o.side <> b.side)""")
def f10(spark, sf):
    part = table(spark, sf, "part")
    other = part.selectExpr("p_type || 'R' as v").unionAll(part.selectExpr("p_name as v"))
    return si.phonetic_join(part, other, "p_name", "v")


def _set_sql(left: str, right: str, grams: str, threshold: float, empty: bool) -> str:
    """Brute form over an inverted index."""
    return f"""with l as (select v, count(*) as n, list_distinct({grams}) as s from ({left}) where v is not null group by v),
  r as (select v, count(*) as n, list_distinct({grams}) as s from ({right}) where v is not null group by v),
  le as (select v, unnest(s) as g from l), re as (select v, unnest(s) as g from r),
  c as (select le.v as lv, re.v as rv, count(*) as shared from le join re using (g) group by all),
  p as (select lv, rv, l.n as ln, r.n as rn, 100.0 * shared / (len(l.s) + len(r.s) - shared) as score from c join l on l.v = lv join r on r.v = rv
    {"union all select l.v, r.v, l.n, r.n, 100.0 from l, r where len(l.s) = 0 and len(r.s) = 0" if empty else ""})
  select lv as left_value, rv as right_value, ln as left_rows, rn as right_rows, round(score, 4) as score from p where score >= {threshold}"""


@query("f11_token_jaccard_join", _set_sql("select text as v from documents", "select text as v from documents", "regexp_extract_all(lower(v), '[a-z0-9]+')", 70, True))
def f11(spark, sf):
    docs = table(spark, sf, "documents")
    return si.jaccard_join(docs, docs, "text", "text", 70.0).withColumn("score", F.round("score", 4))


@query("f12_ngram_join", _set_sql("select p_name || ' ' || p_brand as v from part", "select p_brand || ' ' || replace(p_name, 'in', 'n') as v from part",
                                  "list_transform(range(1, length(v) + 3), lambda i: substr('  ' || lower(v) || '  ', i, 3))", 55, False))
def f12(spark, sf):
    left, right = _names(spark, sf)
    return si.ngram_join(left, right, "label", "label", 3, 55.0).withColumn("score", F.round("score", 4))


# ---------------------------------------------------------------- duplicates

_ACCOUNT_COLUMNS = [c for c in ACCOUNTS if c != "row_id"]
_ROW_TEXT = " || '|' || ".join(n_exact(f'cast("{c}" as varchar)') for c in _ACCOUNT_COLUMNS)
_ACCOUNTS_SQL = f"t as ({select_sql('customer', ACCOUNTS)})"


def _group_sql(key: str, detector: int, method: str, reason: str, source: str = "t", skip_blank: bool = False) -> str:
    blank = "where key <> ''" if skip_blank else ""
    return f"""select key, {detector} as detector, min(row_id) over (partition by key) as group_first, row_id, cast(100 as double) as similarity, cast(100 as double) as confidence,
      '{method}' as method, '{reason}' as reason, count(*) over (partition by key) as group_size from (select row_id, {key} as key from {source}) {blank}
      qualify count(*) over (partition by key) > 1"""


_EXACT = _group_sql(f"sha1({_ROW_TEXT})", 0, "hash", f"Identical values across {len(_ACCOUNT_COLUMNS)} columns")


def _accounts(spark, sf):
    return frame(spark, sf, "customer", ACCOUNTS)


@query("d1_exact_duplicates", f"with {_ACCOUNTS_SQL} {_EXACT}")
def d1(spark, sf):
    return dd.detect_exact(_accounts(spark, sf), "row_id")


@query("d1_exact_documents", """with t as (select doc_id as row_id, text, lang from documents),
  k as (select row_id, sha1(lower(regexp_replace(regexp_replace(regexp_replace(text, '[\\t-\\r \\x{0085}\\p{Z}]+', ' ', 'g'), '^ ', ''), ' $', '')) || '|' || lang) as key from t)
  select key, row_id, min(row_id) over (partition by key) as group_first, count(*) over (partition by key) as group_size from k qualify count(*) over (partition by key) > 1""")
def d1_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    return dd.detect_exact(docs, "row_id").select("key", "row_id", "group_first", "group_size")


@query("d2_duplicates_by_column", f"with {_ACCOUNTS_SQL} " + _group_sql(n_exact("email"), 0, "column_exact", "Same ''email'' value", skip_blank=True))
def d2(spark, sf):
    return dd.detect_by_column(_accounts(spark, sf), "row_id", "email")


@query("d3_fuzzy_groups")
def d3(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_partkey as row_id", "p_name || ' ' || p_brand as label")
    return dd.detect_fuzzy(part, "row_id", "label", 88.0)


@query("d3_fuzzy_names")
def d3_names(spark, sf):
    return dd.detect_fuzzy(frame(spark, sf, "customer", NAMED), "row_id", "full_name", 85.0, "ratio")


_DETECTORS = [
    _group_sql(n_exact("email"), 0, "column_exact", "Same ''email'' value", skip_blank=True),
    _group_sql(n_exact("mobile"), 1, "column_exact", "Same ''mobile'' value", skip_blank=True),
    _EXACT.replace("0 as detector", "2 as detector"),
]
_RESOLVED = f"""with {_ACCOUNTS_SQL}, g as materialized ({' union all '.join(f'({d})' for d in _DETECTORS)}),
  m as materialized (select *, (detector, group_first) = min((detector, group_first)) over (partition by row_id) as own from g),
  k as materialized (select detector, group_first from m group by all having bool_and(own)), kept as materialized (select g.* from g join k using (detector, group_first))"""


@query("d4_smart_detection", _RESOLVED + " select key, detector, group_first, row_id, similarity, confidence, method, reason, group_size from kept")
def d4(spark, sf):
    return dd.detect_smart(_accounts(spark, sf), "row_id")


@query("d4_smart_with_names")
def d4_names(spark, sf):
    return dd.detect_smart(frame(spark, sf, "customer", NAMED), "row_id")


@query("d5_resolve_overlaps", _RESOLVED + " select detector, group_first, count(*) as members from kept group by all")
def d5(spark, sf):
    df = _accounts(spark, sf)
    parts = dd.detect_by_column(df, "row_id", "email", 0).unionByName(dd.detect_by_column(df, "row_id", "mobile", 1)).unionByName(
        dd.detect_exact(df, "row_id", detector=2))
    return dd.resolve_overlaps(parts, "row_id").groupBy("detector", "group_first").agg(F.count(F.lit(1)).alias("members"))


@query("t4_cross_filter_duplicates", _RESOLVED + " select t.* from t where row_id in (select row_id from kept)")
def t4_duplicates(spark, sf):
    return qy.cross_filter(_accounts(spark, sf), "row_id", segment="Duplicates")


_NUMBERED = _RESOLVED + """, n as (select detector, group_first, row_number() over (order by detector, group_first) - 1 as group_id from (select distinct detector, group_first from kept))"""


@query("d6_duplicate_report", _NUMBERED + """ select email, mobile, town, segment, balance, group_id as _group_id, group_size as _group_size, round(confidence, 2) as _confidence,
  method as _method, reason as _reason, row_id as _row_index from kept join n using (detector, group_first) join t using (row_id)""")
def d6(spark, sf):
    df = _accounts(spark, sf)
    return dd.duplicate_report(df, dd.detect_smart(df, "row_id"), "row_id")


_LIGHT_ROW = " || '||' || ".join(["lower(trim(coalesce(email, '')))", "lower(trim(coalesce(mobile, '')))", "lower(trim(coalesce(town, '')))",
                                  "lower(trim(coalesce(segment, '')))", "coalesce(cast(nullif(balance, 0) as varchar), '')"])


@query("d7_light_row_duplicates", f"""with {_ACCOUNTS_SQL}, g as ({_group_sql(f"sha1({_LIGHT_ROW})", 0, "hash", "r")})
  select key, group_first, row_id, group_size, row_number() over (partition by key order by row_id) as rank from g """)
def d7(spark, sf):
    groups = dd.detect_exact(_accounts(spark, sf), "row_id", norm="light")
    return dd.sample_rows(groups, "row_id").select("key", "group_first", "row_id", "group_size", "rank")


@query("d8_top_groups", _NUMBERED + """ select group_id, group_size, round(confidence, 2) as confidence, method, reason,
  row_number() over (partition by group_id order by similarity desc, row_id) as rank, row_id from kept join n using (detector, group_first)""")
def d8(spark, sf):
    return dd.report_top(dd.detect_smart(_accounts(spark, sf), "row_id"), "row_id")


@query("d8_group_totals", _RESOLVED + " select count(distinct (detector, group_first)) as total_groups, count(*) as total_rows_flagged from kept")
def d8_totals(spark, sf):
    return dd.group_totals(dd.detect_smart(_accounts(spark, sf), "row_id"))


def _lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence by rows of the usual table, as nested list folds."""
    cell = f"case when unicode({b}[j[1]]) = ch[1] then row[j[1]] + 1 else greatest(acc[j[1]], row[j[1] + 1]) end"
    line = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda x: [x]), lambda acc, j: list_append(acc, {cell}), [0::bigint])"
    letters = f"list_transform(range(1, length({a}) + 1), lambda x: [unicode({a}[x])::bigint])"
    start = f"list_transform(range(length({b}) + 1), lambda x: 0::bigint)"
    return f"list_reduce({letters}, lambda row, ch: {line}, {start})[length({b}) + 1]"


def _ratio_sql(a: str, b: str) -> str:
    return f"(1 - (length({a}) + length({b}) - 2 * {_lcs_sql(a, b)}) / cast(length({a}) + length({b}) as double)) * 100"


# ---------------------------------------------------------------- cross-file

# Field names, levels and reasons below must match as they stand.
_FIELDS = {"Name": "name", "Company": "company", "Email": "email", "Phone Number": "phone", "Address": "address", "GST Number": "gst"}
_KEY = joined_parts({label: n_exact(c) for label, c in _FIELDS.items()})
_LABELS = ", ".join(f"case when {n_exact(c)} <> '' then '{label}' end" for label, c in sorted(_FIELDS.items()))
_KEYED = f"""{RECORDS_SQL}, keyed as (select *, {_KEY} as key, list_filter([{_LABELS}], lambda p: p is not null) as labels from rec),
  sizes as (select key, count(*) as group_size, min(ord) as first from keyed where key <> '' group by key having count(*) > 1),
  groups as (select *, row_number() over (order by first) as group_id from sizes)"""
_EXACT_MATCHES = f"""with {_KEYED} select group_id, ord, source_file, sheet_name, folder_path, rn as row_number, 'Exact Match (100%)' as match_level, cast(100 as double) as confidence,
  array_to_string(labels, ', ') as matching_fields, 'Identical values across ' || len(labels) || ' canonical field(s): ' || array_to_string(labels, ', ') as reason, group_size
  from keyed join groups using (key)"""
_SURVIVORS = f"""{_KEYED}, s as (select *, row_number() over (order by ord) - 1 as pos from (select *, {n_clean("coalesce(nullif(name, ''), company)")} as nm,
  {n_exact("email")} as em, {n_hc("phone")} as ph, {n_hc("coalesce(nullif(name, ''), company)")} as pl from keyed where key not in (select key from sizes))),
  pairs as (select a.*, b.ord as ord_b, b.nm as nm_b, b.em as em_b, b.ph as ph_b, b.pl as pl_b, b.email as email_b, b.phone as phone_b, b.source_file as file_b, b.rn as rn_b
    from s a join s b on b.pos > a.pos and b.pos < a.pos + 200 where a.nm <> '' and b.nm <> '')"""
_HIGH = "(pl <> '' and pl = pl_b and nm <> nm_b)"
_SAME = f"(not {_HIGH} and lower(nm) = lower(nm_b))"


def _records(spark, sf):
    return sm.canonical_records(contact_sheets(spark, sf))


@query("x1_exact_matches", _EXACT_MATCHES)
def x1(spark, sf):
    return xf.exact_matches(_records(spark, sf))


@query("x2_high_confidence", f"""with {_SURVIVORS} select ord as ord_a, ord_b, nm as name_a, nm_b as name_b, cast(97 as double) as confidence,
  'Case/formatting difference only (''' || nm || ''' vs ''' || nm_b || ''')' as reason from pairs where {_HIGH}""")
def x2(spark, sf):
    pairs = xf.near_matches(_records(spark, sf), xf.WINDOW).filter(F.col("match_level") == xf.NEAR_LEVEL)
    return pairs.select("ord_a", "ord_b", "name_a", "name_b", "confidence", "reason")


# Pairs in the window are scored by the slow fold; letters in common bound the score first.
_SIMILAR = f"""{_SURVIVORS}, near as (select *, lower(nm) as low, lower(nm_b) as low_b from pairs where not {_HIGH} and lower(nm) <> lower(nm_b) and abs(length(nm) - length(nm_b)) <= 10),
  open as (select * from near where length(low) - len(list_filter(string_split(low, ''), lambda c: contains(low_b, c))) <= length(low) - 0.4 * (length(low) + length(low_b))),
  scored as (select *, {_ratio_sql('low', 'low_b')} as score from open), alike as (select * from scored where score >= 80 and score < 95)"""


@query("x3_similar_records", f"with {_SIMILAR} select ord as ord_a, ord_b, nm as name_a, nm_b as name_b, round(score, 1) as confidence from alike")
def x3(spark, sf):
    pairs = xf.near_matches(_records(spark, sf), xf.WINDOW).filter(F.col("match_level") == xf.SIMILAR_LEVEL)
    return pairs.select("ord_a", "ord_b", "name_a", "name_b", "confidence")


@query("x3_similar_reasons")
def x3_reasons(spark, sf):
    return xf.near_matches(_records(spark, sf), xf.WINDOW).filter(F.col("match_level") == xf.SIMILAR_LEVEL)


@query("x4_possible_matches", f"""with {_SURVIVORS} select ord as ord_a, ord_b, nm as name_a, cast(75 as double) as confidence,
  'Same Name (''' || nm || '''), but differing details across files' as reason from pairs where {_SAME}""")
def x4(spark, sf):
    pairs = xf.near_matches(_records(spark, sf), xf.WINDOW).filter(F.col("match_level") == xf.POSSIBLE_LEVEL)
    return pairs.select("ord_a", "ord_b", "name_a", "confidence", "reason")


@query("x5_match_conflicts", f"""with {_SURVIVORS}, c as (select * from pairs where {_SAME})
  select nm as entity_name, 'Email' as field_name, email as value_a, email_b as value_b, ord as ord_a, ord_b, source_file as source_file_a, file_b as source_file_b,
    rn as row_number_a, rn_b as row_number_b from c where em <> '' and em_b <> '' and em <> em_b
  union all select nm, 'Phone Number', phone, phone_b, ord, ord_b, source_file, file_b, rn, rn_b from c where ph <> '' and ph_b <> '' and ph <> ph_b""")
def x5(spark, sf):
    return xf.match_conflicts(xf.near_matches(_records(spark, sf), xf.WINDOW)).drop("sheet_name_a", "sheet_name_b")


SUMMARY_SQL = f"""with {_SIMILAR}, possible as (select * from pairs where {_SAME}), high as (select * from pairs where {_HIGH}),
  flagged as (select ord from keyed join sizes using (key) union select ord from alike union select ord_b from alike union select ord from possible union select ord_b from possible
    union select ord from high union select ord_b from high),
  conf as (select count(*) filter (where em <> '' and em_b <> '' and em <> em_b) + count(*) filter (where ph <> '' and ph_b <> '' and ph <> ph_b) as n from possible)
  select 2 as total_files, 2 as total_worksheets, (select count(*) from rec) as total_records, (select count(*) from keyed join sizes using (key)) as exact_duplicates,
  2 * ((select count(*) from alike) + (select count(*) from high)) as similar_records, (select count(*) from possible) as possible_matches,
  (select count(*) from rec) - (select count(*) from flagged) as unique_records, (select n from conf) as conflicting_records,
  (select count(*) from ({MISSING_SQL})) as missing_records"""


@query("x7_cross_summary", SUMMARY_SQL)
def x7(spark, sf):
    sheets = contact_sheets(spark, sf)
    records = sm.canonical_records(sheets)
    exact, pairs = xf.exact_matches(records), xf.near_matches(records, xf.WINDOW)
    return xf.cross_summary(records, exact, pairs, xf.match_conflicts(pairs), xf.missing_cells(sheets), 2, 2)



# The same over all pairs of records, at any distance: the whole result.
def unbounded(sql: str) -> str:
    return sql.replace(" and b.pos < a.pos + 200", "")


def _all_level(level: str, *columns: str):
    def run(spark, sf):
        return xf.near_matches(_records(spark, sf)).filter(F.col("match_level") == level).select("ord_a", "ord_b", *columns)

    return run


query("x2_all_high_confidence", unbounded(ORACLES["x2_high_confidence"]))(_all_level(xf.NEAR_LEVEL, "name_a", "name_b", "confidence", "reason"))
query("x3_all_similar_records", unbounded(ORACLES["x3_similar_records"]))(_all_level(xf.SIMILAR_LEVEL, "name_a", "name_b", "confidence"))
query("x4_all_possible_matches", unbounded(ORACLES["x4_possible_matches"]))(_all_level(xf.POSSIBLE_LEVEL, "name_a", "confidence", "reason"))


@query("x5_all_match_conflicts", unbounded(ORACLES["x5_match_conflicts"]))
def x5_all(spark, sf):
    return xf.match_conflicts(xf.near_matches(_records(spark, sf))).drop("sheet_name_a", "sheet_name_b")


@query("x7_all_cross_summary", unbounded(SUMMARY_SQL))
def x7_all(spark, sf):
    sheets = contact_sheets(spark, sf)
    records = sm.canonical_records(sheets)
    return xf.class_summary(records, xf.exact_matches(records), xf.near_classes(records), xf.missing_cells(sheets), 2, 2)


# The same results as classes of records and links between them, without a row per pair.
_SAME_KEY = "case when pl <> '' then nm else lower(nm) end"


@query("x2_match_classes", unbounded(f"""with {_SIMILAR} select '{xf.NEAR_LEVEL}' as match_level, pl as key_a, pl as key_b, count(*) as pairs from pairs where {_HIGH} group by pl
  union all select '{xf.POSSIBLE_LEVEL}', {_SAME_KEY}, {_SAME_KEY}, count(*) from pairs where {_SAME} group by {_SAME_KEY}
  union all select '{xf.SIMILAR_LEVEL}', least(low, low_b), greatest(low, low_b), count(*) from alike group by least(low, low_b), greatest(low, low_b)"""))
def x2_classes(spark, sf):
    return xf.near_classes(_records(spark, sf)).links.select("match_level", "key_a", "key_b", F.col("pairs").cast("long").alias("pairs"))


_LEVELS = {"high_partners": f"pairs where {_HIGH}", "possible_partners": f"pairs where {_SAME}", "similar_partners": "alike"}
_PARTNERS = " union all ".join(
    f"select unnest([ord, ord_b]) as ord, {', '.join(f'{int(level == kind)} as {kind}' for kind in _LEVELS)} from {source}" for level, source in _LEVELS.items())


@query("x4_match_counts", unbounded(f"""with {_SIMILAR}, found as ({_PARTNERS})
  select ord, {', '.join(f'cast(coalesce(sum({kind}), 0) as bigint) as {kind}' for kind in _LEVELS)} from (select ord from s where nm <> '') left join found using (ord) group by ord"""))
def x4_counts(spark, sf):
    return xf.near_classes(_records(spark, sf)).per_record()


_DIFFER = {"Email": "em", "Phone Number": "ph"}


@query("x5_conflict_classes", unbounded(f"with {_SURVIVORS}, c as (select * from pairs where {_SAME}), " + ", ".join(
    f"{c}_values as (select {_SAME_KEY} as entity_key, count(distinct {c}) as n, count(*) as m from s where nm <> '' and {c} <> '' group by 1), "
    f"{c}_pairs as (select {_SAME_KEY} as entity_key, count(*) as k from c where {c} <> '' and {c}_b <> '' and {c} <> {c}_b group by 1)" for c in _DIFFER.values()) + " " + " union all ".join(
    f"select entity_key, '{name}' as field_name, n as values, m as records, k as pairs from {c}_values join {c}_pairs using (entity_key)" for name, c in _DIFFER.items())))
def x5_classes(spark, sf):
    return xf.near_classes(_records(spark, sf)).conflicts().withColumn("pairs", F.col("pairs").cast("long"))


_CELLS = {0: ["name", "address", "city", "state", "phone", "email"], 1: ["name", "company", "address", "city", "state", "phone", "email", "gst"]}
_FIRST_CELLS = " ".join(
    f"when src = {s} then array_to_string(list_filter([{', '.join(f'''nullif(trim({c}), '')''' for c in cols)}], lambda p: p is not null), '|')" for s, cols in _CELLS.items())


@query("x8_cross_sheet_match", f"""with {RECORDS_SQL}, k as (select *, lower(trim(case when src = 2 then nullif(email, '') {_FIRST_CELLS} end)) as key,
  source_file || ' (' || sheet_name || ')' as label from (select * from rec union all select 2, c_custkey, 'mail.csv', 'mail', 'sales', null, null, null, null, null, "Email", null, null,
    0, 0 from (select c_custkey, 'user' || (c_custkey % 150) || '@x.com' as "Email" from customer)))
  select key, count(*) as "Match_Occurrences", array_to_string(list_sort(list_distinct(list(label))), '; ') as "Matched_In_Files", arg_min(coalesce(name, ''), (src, k)) as primary_name
  from k where key <> '' group by key having count(*) > 1""")
def x8(spark, sf):
    mail = table(spark, sf, "customer").selectExpr("c_custkey", "'user' || (c_custkey % 150) || '@x.com' as Email")
    sheets = contact_sheets(spark, sf) + [sm.Sheet(mail, ["c_custkey"], "mail.csv", "mail", "sales")]
    found = xf.cross_match(sheets)
    return found.select("key", "Match_Occurrences", "Matched_In_Files", F.coalesce("`Customer Name`", "`Full Name`", F.lit("")).alias("primary_name"))


# ---------------------------------------------------------------- scores that SQL can follow

# The product name column has few distinct values at every scale, so the quadratic
# form of the oracle stays small over the whole table.


_SPELLED = "case when p_partkey % 2 = 0 then replace(p_name, 'in', 'n') else p_name || 's' end"
_TURNED = "split_part(p_name, ' ', 2) || ' ' || replace(split_part(p_name, ' ', 1), 'e', '')"


def _pairs_sql(other: str, sorted_words: bool) -> str:
    def form(x):
        return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')" if sorted_words else x

    return f"""l as (select p_name as v, {form('p_name')} as u, count(*) as n from part group by all), r as (select v, {form('v')} as u, count(*) as n from (select {other} as v from part) group by all),
  pairs as (select l.v as left_value, r.v as right_value, l.n as left_rows, r.n as right_rows, {_ratio_sql('l.u', 'r.u')} as score from l, r)"""


def _labelled(spark, sf, other):
    part = table(spark, sf, "part")
    return part, part.selectExpr(f"{other} as other")


def _scored(name: str, scorer: str, threshold: float, other: str, sorted_words: bool):
    sql = f"with {_pairs_sql(other, sorted_words)} select left_value, right_value, left_rows, right_rows, round(score, 6) as score from pairs where score >= {threshold}"

    @query(name, sql)
    def run(spark, sf):
        return si.similarity_join(*_labelled(spark, sf, other), "p_name", "other", scorer, threshold).withColumn("score", F.round("score", 6))


_scored("f1_ratio_product_names", "ratio", 75.0, _SPELLED, False)
_scored("f3_token_sort_product_names", "token_sort", 80.0, _TURNED, True)
_scored("f6_quick_ratio_product_names", "quick_ratio", 88.0, _SPELLED, False)


@query("f7_best_product_name", f"with {_pairs_sql(_SPELLED, False)} select left_value, right_value, left_rows, right_rows, round(score, 6) as score from pairs where score >= 80 "
       "qualify row_number() over (partition by left_value order by score desc, right_value) = 1")
def f7_names(spark, sf):
    return si.best_match(*_labelled(spark, sf, _SPELLED), "p_name", "other", "ratio", 80.0).withColumn("score", F.round("score", 6))


@query("f8_top_product_names", f"""with {_pairs_sql(_SPELLED, False)} select left_value, right_value, left_rows, right_rows, round(score, 6) as score,
  row_number() over (partition by left_value order by score desc, right_value) as rank from pairs where score >= 60 qualify rank <= 3""")
def f8_names(spark, sf):
    return si.top_matches(*_labelled(spark, sf, _SPELLED), "p_name", "other", 3, "ratio", 60.0).withColumn("score", F.round("score", 6))


# Longer and turned forms of the same names, so that every branch of the scores is met.
_LONGER = "case when p_partkey % 3 = 0 then p_type || ' ' || replace(p_name, 'in', 'n') else split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || 's' end"


def _scores_sql(other: str) -> str:
    """All scores of p_name and ``other`` in SQL: LCS by list folds, windows of the longer string listed once each."""
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    form = lambda ws: f"array_to_string({ws}, ' ')"
    raw = _pairs_sql(other, False).replace(f", {_ratio_sql('l.u', 'r.u')} as score", "")
    return f"""{raw},
  worded as (select *, list_sort({words('left_value')}) as sl, list_sort({words('right_value')}) as sr from pairs),
  formed as (select *, {form('sl')} as jl, {form('sr')} as jr, list_sort(list_distinct(sl)) as ul, list_sort(list_distinct(sr)) as ur from worded),
  joined as (select *, {form('ul')} as kl, {form('ur')} as kr, list_sort(list_intersect(ul, ur)) as shared from formed),
  parts as materialized (select *, {form('shared')} as b, {form('list_filter(ul, lambda w: not list_contains(shared, w))')} as dl, {form('list_filter(ur, lambda w: not list_contains(shared, w))')} as dr,
    greatest(length(left_value), length(right_value)) / least(length(left_value), length(right_value)) as spread from joined),
  asked as (select left_value as x, right_value as y from parts union select jl, jr from parts union select kl, kr from parts),
  sided as (select x, y, case when length(x) <= length(y) then x else y end as s, case when length(x) <= length(y) then y else x end as t from asked),
  turned as (select * from sided union all select x, y, t, s from sided where length(s) = length(t)),
  spans as materialized (select x, y, s, substr(t, greatest(k, 0) + 1, k + length(s) - greatest(k, 0)) as w from turned, lateral (select unnest(range(1 - length(s), length(t)))) as u(k)),
  shown as materialized (select s, w, {_ratio_sql('s', 'w')} as score from (select distinct s, w from spans)),
  windows as materialized (select x, y, max(score) as score from spans join shown using (s, w) group by all),
  measured as (select p.*, {_ratio_sql('left_value', 'right_value')} as ratio, {_ratio_sql('jl', 'jr')} as turned, wv.score as partial, greatest(wj.score, wk.score) as wordy,
    case when len(shared) > 0 and (len(shared) = len(ul) or len(shared) = len(ur)) then 100 else greatest(
      100.0 - 100.0 * (length(dl) + length(dr) - 2 * {_lcs_sql('dl', 'dr')}) / (2 * length(b) + 2 * sign(length(b)) + length(dl) + length(dr)),
      case when b <> '' then greatest(100.0 - 100.0 * (1 + length(dl)) / (2 * length(b) + 1 + length(dl)), 100.0 - 100.0 * (1 + length(dr)) / (2 * length(b) + 1 + length(dr))) else 0 end) end as token_set
    from parts p join windows wv on wv.x = left_value and wv.y = right_value join windows wj on wj.x = jl and wj.y = jr join windows wk on wk.x = kl and wk.y = kr),
  scored as (select *, case when spread < 1.5 then greatest(ratio, 0.95 * greatest(turned, token_set)) else
    greatest(ratio, partial * case when spread <= 8 then 0.9 else 0.6 end, case when len(shared) > 0 then 100 else wordy end * 0.95 * case when spread <= 8 then 0.9 else 0.6 end) end as weighted from measured)"""


def _combined(name: str, scorer: str, column: str, threshold: float):
    sql = f"with {_scores_sql(_LONGER)} select left_value, right_value, left_rows, right_rows, round({column}, 6) as score from scored where {column} >= {threshold}"

    @query(name, sql)
    def run(spark, sf):
        return si.similarity_join(*_labelled(spark, sf, _LONGER), "p_name", "other", scorer, threshold).withColumn("score", F.round("score", 6))


_combined("f2_partial_product_names", "partial", "partial", 78.3)
_combined("f4_token_set_product_names", "token_set", "token_set", 72.3)
_combined("f5_weighted_product_names", "weighted_ratio", "weighted", 74.3)

_GREEDY = f"""with keys as (select p_name as v, min(p_partkey) as first, count(*) as n from part group by 1), ranked as (select *, row_number() over (order by first) as i from keys),
  near as (select b.i, a.i as j, {_ratio_sql('a.v', 'b.v')} as score from ranked a, ranked b where a.i < b.i), hits as (select * from near where score >= 70),
  links as (select ranked.i, list(j) filter (where j is not null) as js from ranked left join hits using (i) group by 1),
  table_of as (select list(coalesce(js, []) order by i) as adj from links),
  led as (select list_reduce(list_transform(range(1, len(adj) + 1), lambda x: [x]), lambda acc, x: case when len(list_intersect(acc, adj[x[1]])) = 0 then list_append(acc, x[1]) else acc end,
    []::bigint[]) as leaders from table_of),
  placed as (select r.*, coalesce(h.j, r.i) as lead from ranked r left join (select hits.i, min(hits.j) as j from hits, led where list_contains(leaders, hits.j) group by 1) h on h.i = r.i),
  scored as (select p.*, coalesce(h.score, 100) as similarity, l.v as key, l.first as group_first from placed p join ranked l on l.i = p.lead left join hits h on h.i = p.i and h.j = p.lead),
  groups as (select lead, sum(n) as group_size, sum(similarity * n) / sum(n) as confidence from scored group by 1 having sum(n) > 1)"""


@query("d3_fuzzy_product_names", _GREEDY + """ select p_partkey as row_id, key, group_first, round(similarity, 6) as similarity, round(confidence, 6) as confidence, cast(group_size as bigint) as group_size
  from part join scored on p_name = v join groups using (lead)""")
def d3_products(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    found = dd.detect_fuzzy(part, "row_id", "p_name", 70.0, "ratio")
    return found.select("row_id", "key", "group_first", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"), "group_size")
