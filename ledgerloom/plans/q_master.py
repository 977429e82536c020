"""Consolidation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossfile as xf
from ..operators import mdm
from ..operators import schema_map as sm
from . import reports
from .q_matching import _EXACT_MATCHES, _HIGH, _SAME, _SIMILAR, _SURVIVORS, SUMMARY_SQL, unbounded
from .q_quality import MISSING_SQL
from .registry import ORACLES, query
from .sheets import RECORDS_SQL, contact_sheets, joined_parts, n_clean, n_exact, n_phone

RUN_DATE = "2024-01-01 00:00:00"
_RULE_PARTS = {
    "rule_1": {"Name": n_exact("name"), "Address": n_exact("address"), "City": n_exact("city"), "State": n_exact("state"), "Contact Number": n_phone("phone")},
    "rule_2": {"Email": n_exact("email")},
    "rule_3": {"GST Number": n_exact("gst")},
    "rule_5": {"Name": n_exact("name"), "Contact Number": n_phone("phone")},
}


def _key_sql(rule: str) -> str:
    own = "'_raw_row_' || source_file || '_' || sheet_name || '_' || rn"
    return f"coalesce(nullif({joined_parts(_RULE_PARTS[rule])}, ''), {own})"


def _entity_sql(rule: str) -> str:
    def first(c):
        return f"arg_min({c}, ord) filter (where trim(coalesce({c}, '')) <> '') as {c}"

    fields = ["name", "address", "city", "state", "phone", "email", "company", "gst"]
    return f"""{RECORDS_SQL}, kr as (select *, {_key_sql(rule)} as key from rec),
      ent as (select key, min(ord) as first_ord, count(*) as n, list_sort(list(distinct source_file)) as sources, {', '.join(first(c) for c in fields)} from kr group by key),
      e as (select *, row_number() over (order by first_ord) as no, 'M' || lpad(cast(row_number() over (order by first_ord) as varchar), 6, '0') as master_id from ent)"""


_MASTER_COLUMNS = f"""master_id, {n_clean("coalesce(name, company)")} as name, {n_clean("address")} as address, {n_clean("city")} as city, {n_clean("state")} as state,
  {n_clean("phone")} as contact_number, {n_clean("email")} as email, {n_clean("company")} as company, {n_clean("gst")} as gst_number, '' as customer_id,
  len(sources) as source_count, n - 1 as duplicate_count, n as total_occurrences"""


def _run(spark, sf, rule="rule_5"):
    return mdm.consolidate(sm.canonical_records(contact_sheets(spark, sf)), rule, run_date=RUN_DATE)


def _shown(masters):
    return masters.drop("created_date").withColumn("sources", F.array_join("sources", ", "))


def _key_query(rule: str):
    name = f"k1_match_key_{rule}"
    sql = f"with {RECORDS_SQL} select ord, {_key_sql(rule)} as key from rec"

    @query(name, sql)
    def run(spark, sf):
        records = sm.canonical_records(contact_sheets(spark, sf))
        return records.select("ord", mdm.match_key(records, rule).alias("key"))


for _r in _RULE_PARTS:
    _key_query(_r)


_CUSTOMER_ID = "case when {rn} % 5 = 0 then '' else ' C' || ({rn} % 40) || ' ' end"


@query("k1_match_key_rule_4", f"""with {RECORDS_SQL}, r as (select *, {_CUSTOMER_ID.format(rn="rn")} as cid from rec)
  select ord, coalesce(nullif({joined_parts({'Customer ID': n_exact('cid')})}, ''), '_raw_row_' || source_file || '_' || sheet_name || '_' || rn) as key from r""")
def k1_rule_4(spark, sf):
    records = sm.canonical_records(contact_sheets(spark, sf)).withColumn("Customer ID", F.expr(_CUSTOMER_ID.format(rn="row_number")))
    return records.select("ord", mdm.match_key(records, "rule_4").alias("key"))


@query("k1_match_key_custom", f"with {RECORDS_SQL} select ord, coalesce(nullif({joined_parts({'City': n_exact('city'), 'State': n_exact('state')})}, ''), '_raw_row_' || source_file || '_' || sheet_name || '_' || rn) as key from rec")
def k1_custom(spark, sf):
    records = sm.canonical_records(contact_sheets(spark, sf))
    return records.select("ord", mdm.match_key(records, None, ["City", "State"]).alias("key"))


@query("k2_entities", f"with {_entity_sql('rule_1')} select master_id, first_ord, n as total_occurrences from e")
def k2(spark, sf):
    run = _run(spark, sf, "rule_1")
    return run._entities.select("master_id", "first_ord", "total_occurrences")


@query("k3_golden_records", f"with {_entity_sql('rule_5')} select {_MASTER_COLUMNS}, array_to_string(sources, ', ') as sources from e")
def k3(spark, sf):
    return _shown(_run(spark, sf).masters)


@query("k3_golden_by_email", f"with {_entity_sql('rule_2')} select {_MASTER_COLUMNS}, array_to_string(sources, ', ') as sources from e")
def k3_email(spark, sf):
    return _shown(_run(spark, sf, "rule_2").masters)


@query("k4_references", f"with {_entity_sql('rule_5')} select master_id, source_file, sheet_name, rn as row_number, folder_path, '{RUN_DATE}' as import_date from kr join e using (key)")
def k4(spark, sf):
    return _run(spark, sf).references


_CHECKS = {"Phone Number": "phone", "Email": "email", "Address": "address", "City": "city", "State": "state"}
_CONFLICTS = f"""{_entity_sql('rule_5')}, firsts as (select key, ord as ford, name as fname, phone as fphone, email as femail, address as faddress, city as fcity, state as fstate,
  source_file as ffile, sheet_name as fsheet, rn as frn from kr where ord in (select first_ord from e)),
  raw as ({' union all '.join(f'''select e.no, e.master_id, coalesce(e.name, e.company, e.master_id) as entity_name, kr.ord, {i} as fno, '{label}' as field_name, f{c} as value_a, ffile as source_a,
    fsheet as sheet_a, frn as row_a, kr.{c} as value_b, kr.source_file as source_b, kr.sheet_name as sheet_b, kr.rn as row_b from kr join firsts on firsts.key = kr.key and kr.ord > ford join e on e.key = kr.key
    where {n_exact('f' + c)} <> '' and {n_exact('kr.' + c)} <> '' and {n_exact('f' + c)} <> {n_exact('kr.' + c)}''' for i, (label, c) in enumerate(_CHECKS.items()))}),
  conf as (select 'CONF-' || lpad(cast(row_number() over (order by no, ord, fno) as varchar), cast(greatest(5, length(cast(row_number() over (order by no, ord, fno) as varchar))) as integer), '0') as conflict_id,
    master_id, entity_name, field_name, value_a, source_a, sheet_a, row_a, value_b, source_b, sheet_b, row_b, 'pending' as status from raw)"""


@query("k5_conflicts", f"with {_CONFLICTS} select * from conf")
def k5(spark, sf):
    return _run(spark, sf).conflicts


@query("k6_unique_records", f"with {_entity_sql('rule_5')} select {_MASTER_COLUMNS} from e where n = 1")
def k6(spark, sf):
    return _run(spark, sf).unique_records.drop("created_date", "sources")


@query("k6_duplicate_groups", f"with {_entity_sql('rule_5')} select {_MASTER_COLUMNS} from e where n > 1")
def k6_groups(spark, sf):
    return _run(spark, sf).duplicate_groups.drop("created_date", "sources")


@query("k7_run_statistics", f"""with {_CONFLICTS}, miss as (select count(*) as m from ({MISSING_SQL}))
  select 2 as total_files, 2 as total_worksheets, cast(sum(n) as bigint) as total_records, 14 as total_columns, 1500 as processing_size_bytes, count(*) as master_records_count,
  count(*) filter (where n > 1) as duplicate_groups_count, cast(sum(n - 1) as bigint) as duplicate_records_count, count(*) filter (where n = 1) as unique_records_count,
  (select count(*) from conf) as conflicting_records_count, (select m from miss) as missing_records_count from e""")
def k7(spark, sf):
    sheets = contact_sheets(spark, sf)
    return mdm.mdm_summary(_run(spark, sf), sheets, xf.missing_cells(sheets))


@query("k8_resolve_conflicts", f"""with {_CONFLICTS} select conflict_id, case when conflict_id = 'CONF-00001' then 'resolved_merged' when field_name = 'Email' then 'resolved_keep_second'
  else status end as status from conf""")
def k8(spark, sf):
    conflicts = _run(spark, sf).conflicts
    decisions = conflicts.select("conflict_id", F.when(F.col("conflict_id") == "CONF-00001", "resolved_merged").when(F.col("field_name") == "Email", "keep_second").alias("action"))
    return mdm.resolve(conflicts, decisions.filter("action is not null")).select("conflict_id", "status")


@query("k8_resolve_all", f"with {_CONFLICTS} select conflict_id, 'resolved_keep_first' as status from conf")
def k8_all(spark, sf):
    decisions = spark.createDataFrame([("", "apply_all")], "conflict_id string, action string")
    return mdm.resolve(_run(spark, sf).conflicts, decisions).select("conflict_id", "status")


@query("k9_search_masters", f"""with {_entity_sql('rule_5')}, m as (select {_MASTER_COLUMNS} from e) select * from m where
  (contains(lower(name), 'user1') or contains(lower(email), 'user1') or contains(lower(address), 'user1') or contains(lower(company), 'user1') or contains(contact_number, 'user1'))
  and contains(lower(city), 'city 1') and duplicate_count >= 1""")
def k9(spark, sf):
    return mdm.search_masters(_run(spark, sf).masters, "User1", city="city 1", min_dup=1).drop("created_date", "sources")


@query("k9_master_page", f"with {_entity_sql('rule_5')}, m as (select {_MASTER_COLUMNS} from e) select * from m where contains(lower(state), 'build') order by master_id limit 20 offset 20")
def k9_page(spark, sf):
    return mdm.search_masters(_run(spark, sf).masters, state="BUILD", page=2, size=20).drop("created_date", "sources")


@query("k9_stored_page", f"with {_entity_sql('rule_5')}, m as (select {_MASTER_COLUMNS} from e) select * from m order by master_id limit 20 offset 60")
def k9_stored(spark, sf):
    return mdm.store_masters(_run(spark, sf).masters).page(3, 20).drop("created_date", "sources")


@query("k9_search_references", f"""with {_entity_sql('rule_5')} select master_id, source_file, sheet_name, rn as row_number, folder_path, '{RUN_DATE}' as import_date from kr join e using (key)
  where contains(lower(source_file), 'vendors') or contains(lower(folder_path), 'vendors') or contains(lower(sheet_name), 'vendors')""")
def k9_references(spark, sf):
    return mdm.search_references(_run(spark, sf).references, "Vendors")


_RAW_DIGITS = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
# Only the header lists of this variant apply: "Mail ID" and "Mobile" are in them.
_LOW = {c: f"lower(trim(coalesce({c}, '')))" for c in ("name", "address", "city", "state", "email", "gst")}
_COALESCED = f"""{RECORDS_SQL}, kr as (select *, case when coalesce(name, '') <> '' or coalesce(phone, '') <> '' then 'nc:' || {_LOW['name']} || '|' || {_RAW_DIGITS}
    else 'prof:' || {_LOW['name']} || '|' || {_LOW['address']} || '|' || {_LOW['city']} || '|' || {_LOW['state']} || '|' || {_RAW_DIGITS} end as key from rec),
  ent as (select key, min(ord) as first_ord, count(*) as n, count(distinct source_file) as files from kr group by key),
  cm as (select 'M' || lpad(cast(row_number() over (order by first_ord) as varchar), 6, '0') as master_id, coalesce(name, '') as name, coalesce(address, '') as address, coalesce(city, '') as city,
    coalesce(state, '') as state, coalesce(phone, '') as contact_number, coalesce(email, '') as email, coalesce(company, '') as company, coalesce(gst, '') as gst_number, '' as customer_id,
    files as source_count, n - 1 as duplicate_count, n as total_occurrences from ent join kr on kr.ord = ent.first_ord)"""


@query("k10_coalesced_masters", f"with {_COALESCED} select * from cm")
def k10(spark, sf):
    return mdm.consolidate_coalesced(contact_sheets(spark, sf), "rule_5")


@query("k10_coalesced_references", f"""with {_COALESCED} select 'M' || lpad(cast(no as varchar), 6, '0') as master_id, source_file, sheet_name, folder_path, ord, key
  from kr join (select key, row_number() over (order by first_ord) as no from ent) using (key)""")
def k10_references(spark, sf):
    return mdm.coalesced_references(contact_sheets(spark, sf), "rule_5")


_COALESCED_KEYS = {"rule_1": "''", "rule_2": f"'email:' || nullif({_LOW['email']}, '')", "rule_3": f"'gst:' || nullif({_LOW['gst']}, '')", "rule_4": "'cid:' || nullif(cid, '')"}
_PROFILE_KEY = f"'prof:' || {_LOW['name']} || '|' || {_LOW['address']} || '|' || {_LOW['city']} || '|' || {_LOW['state']} || '|' || {_RAW_DIGITS}"
_SHEET_ID = "case when {k} % 5 = 0 then '' else 'C' || ({k} % 40) end"


@query("k10_coalesced_keys", f"with {RECORDS_SQL}, r as (select *, lower({_SHEET_ID.format(k='k')}) as cid from rec) " + " union all ".join(
    f"select '{rule}' as rule, ord, coalesce(nullif({key}, ''), {_PROFILE_KEY}) as key from r" for rule, key in _COALESCED_KEYS.items()))
def k10_keys(spark, sf):
    """The keys by e-mail, tax number, customer id, and whole profile."""
    sheets = [sm.Sheet(s.df.withColumn("Customer ID", F.expr(_SHEET_ID.format(k=s.order_by[0]))), s.order_by, s.file, s.sheet, s.folder) for s in contact_sheets(spark, sf)]
    parts = [mdm.coalesced_records(sheets, rule).select(F.lit(rule).alias("rule"), "ord", "key") for rule in _COALESCED_KEYS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("k10_coalesced_summary", f"""with {_COALESCED} select cast(sum(total_occurrences) as bigint) as total_records, count(*) as master_records_count, count(*) filter (where duplicate_count > 0) as duplicate_groups_count,
  cast(sum(total_occurrences) as bigint) as duplicate_records_count, count(*) filter (where duplicate_count = 0) as unique_records_count,
  count(*) filter (where contact_number = '' or email = '') as missing_records_count from cm""")
def k10_summary(spark, sf):
    return mdm.coalesced_summary(mdm.consolidate_coalesced(contact_sheets(spark, sf), "rule_5"))


# ---------------------------------------------------------------- reports


@query("e1_exact_duplicates", f"""with x as ({_EXACT_MATCHES}), {RECORDS_SQL} select x.group_id as "Group", coalesce(nullif(name, ''), nullif(company, ''), '') as "Name", coalesce(address, '') as "Address",
  coalesce(email, '') as "Email", coalesce(phone, '') as "Phone", x.source_file as "Source File", x.sheet_name as "Sheet", x.row_number as "Row", x.match_level as "Match Type",
  '100%' as "Confidence Score" from x join rec using (ord)""")
def e1(spark, sf):
    return reports.DuplicateReport(contact_sheets(spark, sf)).exact_duplicates


_SPOT = "source_file || ' (' || sheet_name || ':L' || rn || ')'"
_SPOT_B = "file_b || ' (' || replace(file_b, '.csv', '') || ':L' || rn_b || ')'"
_BOTH = "''' || nm || ''' vs ''' || nm_b || '''"
_PAIR_COLUMNS = "ord, ord_b, nm, nm_b, source_file, sheet_name, rn, file_b, rn_b"


@query("e1_similar_records", f"""with {_SIMILAR}, found as (
    select {_PAIR_COLUMNS}, cast(97 as double) as c, 'Name/Company' as f, 'Case/formatting difference only ({_BOTH})' as d from pairs where {_HIGH}
    union all select {_PAIR_COLUMNS}, score, 'Name/Company', 'Minor spelling difference (' || printf('%.0f', score) || '% similarity: {_BOTH})' from alike
    union all select {_PAIR_COLUMNS}, cast(75 as double), 'Name', 'Same Name (''' || nm || '''), but differing details across files' from pairs where {_SAME})
  select (select coalesce(max(group_id), 0) from groups) + row_number() over (order by ord, ord_b) as "Group ID", nm as "Name / Primary Entity", printf('%.1f', c) || '%' as "Similarity",
    f as "Matching Fields", {_SPOT} || ' | ' || {_SPOT_B} as "Source Files", d as "Details" from found""")
def e1_similar(spark, sf):
    return reports.DuplicateReport(contact_sheets(spark, sf), xf.WINDOW).similar_records


@query("e1_conflicting_records", f"""with {_SURVIVORS}, c as (select * from pairs where {_SAME}), d as (select nm, 'Email' as f, email as va, email_b as vb, source_file, sheet_name, rn, file_b, rn_b from c
    where em <> '' and em_b <> '' and em <> em_b union all select nm, 'Phone Number', phone, phone_b, source_file, sheet_name, rn, file_b, rn_b from c where ph <> '' and ph_b <> '' and ph <> ph_b)
  select nm as "Entity Name", f as "Field", va as "Old Value", vb as "New Value", source_file || ' (' || sheet_name || ':L' || rn || ')' as "Source A",
  file_b || ' (' || replace(file_b, '.csv', '') || ':L' || rn_b || ')' as "Source B" from d""")
def e1_conflicts(spark, sf):
    return reports.DuplicateReport(contact_sheets(spark, sf), xf.WINDOW).conflicting_records


@query("e1_missing_data", f"""select source_file as "File", sheet_name as "Sheet", row_number as "Row", missing_column as "Missing Column", details as "Details" from ({MISSING_SQL})""")
def e1_missing(spark, sf):
    return reports.DuplicateReport(contact_sheets(spark, sf)).missing_data


_METRICS = {
    "total_files": "Total Files Processed", "total_worksheets": "Total Worksheets Analyzed", "total_records": "Total Records Analyzed",
    "exact_duplicates": "Exact Duplicate Records", "similar_records": "Similar Match Records", "possible_matches": "Possible Match Records",
    "unique_records": "Unique Records", "conflicting_records": "Conflicting Records Flagged", "missing_records": "Missing Data Instances",
}


@query("e1_summary", f"with x as ({SUMMARY_SQL}) " + " union all ".join(f"select '{label}' as metric, cast({c} as varchar) as value from x" for c, label in _METRICS.items()))
def e1_summary(spark, sf):
    return reports.DuplicateReport(contact_sheets(spark, sf), xf.WINDOW).summary


def _all_report(part: str) -> None:
    """A sheet of the report over all pairs of records, at any distance."""
    query(f"e1_all_{part}", unbounded(ORACLES[f"e1_{part}"]))(lambda spark, sf: getattr(reports.DuplicateReport(contact_sheets(spark, sf)), part))


for _part in ("similar_records", "conflicting_records", "summary"):
    _all_report(_part)


def _master_table(spark, sf, name):
    return getattr(reports.MasterReport(_run(spark, sf), contact_sheets(spark, sf), "rule_5"), name)


_TITLES = {"master_id": "Master ID", "name": "Name", "address": "Address", "city": "City", "state": "State", "contact_number": "Contact Number", "email": "Email", "company": "Company",
           "gst_number": "GST Number", "customer_id": "Customer ID", "source_count": "Source Count", "duplicate_count": "Duplicate Count", "total_occurrences": "Total Occurrences"}
_TITLED = ", ".join(f'{c} as "{t}"' for c, t in _TITLES.items()) + f", '{RUN_DATE}' as \"Created Date\""


@query("e2_master_records", f"with {_entity_sql('rule_5')} select {_TITLED} from (select {_MASTER_COLUMNS} from e)")
def e2(spark, sf):
    return _master_table(spark, sf, "master_records")


@query("e2_unique_records", f"with {_entity_sql('rule_5')} select {_TITLED} from (select {_MASTER_COLUMNS} from e where n = 1)")
def e2_unique(spark, sf):
    return _master_table(spark, sf, "unique_records")


@query("e2_duplicate_references", f"""with {_entity_sql('rule_5')} select master_id as "Master ID", source_file as "Source File", sheet_name as "Worksheet", rn as "Row Number",
  folder_path as "Folder Path", '{RUN_DATE}' as "Import Date" from kr join e using (key)""")
def e2_references(spark, sf):
    return _master_table(spark, sf, "duplicate_references")


@query("e2_conflicting_records", f"""with {_CONFLICTS} select conflict_id as "Conflict ID", master_id as "Master ID", entity_name as "Entity Name", field_name as "Field Name", value_a as "Value A",
  source_a || ' (' || sheet_a || ':L' || row_a || ')' as "Source A (Sheet:Row)", value_b as "Value B", source_b || ' (' || sheet_b || ':L' || row_b || ')' as "Source B (Sheet:Row)", status as "Status" from conf""")
def e2_conflicts(spark, sf):
    return _master_table(spark, sf, "conflicting_records")


@query("e2_missing_data", f"""select source_file as "File", sheet_name as "Worksheet", row_number as "Row Number", folder_path as "Folder Path", missing_column as "Missing Column", details as "Details"
  from ({MISSING_SQL})""")
def e2_missing(spark, sf):
    return _master_table(spark, sf, "missing_data")


@query("e2_statistics", f"""with {_CONFLICTS}, miss as (select count(*) as m from ({MISSING_SQL}))
  select 'Total Spreadsheets Found' as metric, '2' as value union all select 'Total Worksheets Scanned', '2' union all select 'Total Indexed Records', cast(cast(sum(n) as bigint) as varchar) from e
  union all select 'Total Unique Columns', '14' union all select 'Processing Data Size (MB)', '0.00 MB' union all select 'Master Dataset Records', cast(count(*) as varchar) from e
  union all select 'Duplicate Record Groups', cast(count(*) as varchar) from e where n > 1 union all select 'Total Duplicate References', cast(cast(sum(n - 1) as bigint) as varchar) from e
  union all select 'Unique Records (Non-Duplicate)', cast(count(*) as varchar) from e where n = 1 union all select 'Conflicting Field Instances', cast(count(*) as varchar) from conf
  union all select 'Missing Field Entries', cast(m as varchar) from miss""")
def e2_statistics(spark, sf):
    return _master_table(spark, sf, "statistics")
