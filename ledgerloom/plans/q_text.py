"""Cleaning, normalising and header alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean as cl
from ..operators import schema_map as sm
from .registry import query
from .sheets import CHECKED, CRM, RECORDS_SQL, VENDORS, contact_sheets, frame, n_clean, n_exact, n_hc, n_phone, select_sql, table

# White space as Unicode defines it, for the oracle's regex engine.
_WS = r"[\t-\r \x{0085}\p{Z}]"
_INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{00AD}]"
_STRIPPED = f"regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', '')"


def _documents(spark, sf, fn):
    return table(spark, sf, "documents").select("doc_id", fn(F.col("text")).alias("text"))


def _documents_sql(expr: str) -> str:
    return f"select doc_id, {expr} as text from (select doc_id, text as x from documents)"


@query("c1_strip_invisible", _documents_sql(f"regexp_replace(x, '{_INVISIBLE}', '', 'g')"))
def c1(spark, sf):
    return _documents(spark, sf, tx.strip_invisible)


@query("c2_nfkc", _documents_sql("nfc_normalize(x)"))
def c2(spark, sf):
    return _documents(spark, sf, tx.nfkc)


@query("c3_squeeze_spaces", _documents_sql(f"regexp_replace(x, '{_WS}+', ' ', 'g')"))
def c3(spark, sf):
    return _documents(spark, sf, tx.squeeze)


@query("c4_trim", _documents_sql(_STRIPPED))
def c4(spark, sf):
    return _documents(spark, sf, tx.strip)


@query("c5_title_case", """select s_suppkey, array_to_string(list_transform(regexp_extract_all(x, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), '') as title,
  lower(x) as lower_form, upper(x) as upper_form from (select s_suppkey, 'o''NEIL ' || s_name || '-jones 3rd' as x from supplier)""")
def c5(spark, sf):
    x = F.concat(F.lit("o'NEIL "), F.col("s_name"), F.lit("-jones 3rd"))
    forms = {"title": "title", "lower_form": "lower", "upper_form": "upper"}
    return table(spark, sf, "supplier").select("s_suppkey", *[tx.fix_case(x, m).alias(n) for n, m in forms.items()])


_CLEAN_SQL = " , ".join(
    f'{e} as "{n}"' for n, e in {
        "row_id": "row_id", "contact_name": "regexp_replace(\"contact_name\", '[^0-9+]', '', 'g')",
        "contact_email": "regexp_replace(lower(\"contact_email\"), '[^0-9+]', '', 'g')",
        "phone": "regexp_replace(\"phone\", '[^0-9+]', '', 'g')", "gst_no": "gst_no", "shipping_zip": "shipping_zip",
        "created_date": "created_date", "column_9": "column_9", "balance": "balance",
    }.items()
)


@query("c8_clean_table", f"with t as ({select_sql('customer', CHECKED)}) select {_CLEAN_SQL} from t")
def c8(spark, sf):
    return cl.clean(frame(spark, sf, "customer", CHECKED))


_CLEAN_CRM = {n: f'"{n}"' for n in CRM}
for _n in ("Customer Name", "Office Address", "Town", "Province", "Mail ID"):
    _CLEAN_CRM[_n] = f"upper(trim(regexp_replace(\"{_n}\", '\\s+', ' ', 'g')))"
_CLEAN_CRM["Contact Number"] = "regexp_replace(\"Contact Number\", '[^0-9+]', '', 'g')"


@query("c8_clean_upper", f"with t as ({select_sql('customer', CRM)}) select " + ", ".join(f'{e} as "{n}"' for n, e in _CLEAN_CRM.items()) + " from t")
def c8_upper(spark, sf):
    return cl.clean(frame(spark, sf, "customer", CRM), fix_case="upper")


_EMAILS = {"row_id": "c_custkey", "work_email": CHECKED["contact_email"], "Mobile No": CHECKED["phone"]}


@query("c6_c7_email_and_phone", f"with t as ({select_sql('customer', _EMAILS)}) select row_id, lower(work_email) as work_email, regexp_replace(\"Mobile No\", '[^0-9+]', '', 'g') as \"Mobile No\" from t")
def c6(spark, sf):
    return cl.clean(frame(spark, sf, "customer", _EMAILS))


@query("c9_key_normalisers", f"""with t as ({select_sql('customer', CRM)}) select c_custkey, {n_clean('"Office Address"')} as cleaned, {n_exact('"Customer Name"')} as exact,
  {n_hc('"Customer Name"')} as high, {n_phone('"Contact Number"')} as phone, {n_exact('"Mail ID"')} as email from t""")
def c9(spark, sf):
    return frame(spark, sf, "customer", CRM).select(
        "c_custkey", tx.clean_text(F.col("`Office Address`")).alias("cleaned"), tx.norm_exact(F.col("`Customer Name`")).alias("exact"),
        tx.norm_high_confidence(F.col("`Customer Name`")).alias("high"), tx.norm_phone(F.col("`Contact Number`")).alias("phone"),
        tx.norm_email(F.col("`Mail ID`")).alias("email"))


@query("c10_valid_email", f"""with t as ({select_sql('customer', CRM)}) select c_custkey, coalesce(regexp_matches("Mail ID", '^[\\w.+\\-]+@[\\w\\-]+\\.[\\w\\-.]+$'), false) as valid from t""")
def c10(spark, sf):
    return frame(spark, sf, "customer", CRM).select("c_custkey", tx.is_valid_email(F.col("`Mail ID`")).alias("valid"))


@query("s3_normal_headers", 'select r_regionkey as "column", r_name as "column_1", r_regionkey + 1 as "id", r_name as "ID_1" from region')
def s3(spark, sf):
    df = table(spark, sf, "region").selectExpr("r_regionkey", "r_name", "r_regionkey + 1 as a", "r_name as b")
    return cl.normalize_headers(df.toDF(" ", "Unnamed: 3", " id", "ID "))


@query("s5_drop_blank_rows", """select * from (select case when l_quantity > 10 then l_quantity end as q, case when l_returnflag = 'N' then '  ' else l_returnflag end as flag from lineitem)
  where q is not null or trim(coalesce(flag, '')) <> ''""")
def s5(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("q"), F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("flag"))
    return cl.drop_blank_rows(df)


@query("m1_canonical_headers", f"""with t as ({select_sql('supplier', VENDORS)}) select s_suppkey, "Full Name" as "Name", "Company", "Address", "City", "State", "Mobile" as "Phone Number",
  "Email Address" as "Email", "GST Number" from t""")
def m1(spark, sf):
    return sm.canonicalise(frame(spark, sf, "supplier", VENDORS), {"s_suppkey": ["s_suppkey"]})


@query("m2_canonical_records", f"""with {RECORDS_SQL} select ord, source_file, sheet_name, folder_path, rn as row_number, name as "Name", address as "Address", city as "City",
  state as "State", phone as "Phone Number", email as "Email", company as "Company", gst as "GST Number" from rec""")
def m2(spark, sf):
    return sm.canonical_records(contact_sheets(spark, sf))


@query("m3_stack_sheets", f"""with {RECORDS_SQL} select source_file as "Source_File", sheet_name as "Source_Sheet",
  case when src = 0 then name end as "Customer Name", case when src = 0 then address end as "Office Address", case when src = 0 then city end as "Town",
  case when src = 0 then state end as "Province", case when src = 0 then phone end as "Contact Number", case when src = 0 then email end as "Mail ID",
  case when src = 1 then name end as "Full Name", company as "Company", case when src = 1 then address end as "Address", case when src = 1 then city end as "City",
  case when src = 1 then state end as "State", case when src = 1 then phone end as "Mobile", case when src = 1 then email end as "Email Address", gst as "GST Number" from rec""")
def m3(spark, sf):
    return sm.stack(contact_sheets(spark, sf))
