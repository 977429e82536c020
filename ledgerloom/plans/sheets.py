"""Business sheets derived from the given tables, as Spark frames and as SQL.

The tables have no contact columns, so names, e-mails and phones are derived from
keys with expressions that mean the same in Spark SQL and in the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.schema_map import Sheet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _contact(key: str) -> dict[str, str]:
    """Expressions over an integer key; 150 identities repeat with varied spelling."""
    b = f"({key} % 150)"
    h = f"md5(cast({b} as string))"
    return {
        "name": f"case when {key} % 5 = 0 then upper(substr({h}, 1, 12)) when {key} % 11 = 0 then substr({h}, 1, 6) || '-' || "
                f"substr({h}, 7, 6) when {key} % 13 = 0 then substr({h}, 1, 10) else substr({h}, 1, 12) end",
        "email": f"case when {key} % 10 = 0 then '' when {key} % 7 = 0 then 'ALT' || {b} || '@X.com' else 'user' || {b} || '@x.com' end",
        "phone": f"case when {key} % 9 = 0 then null when {key} % 9 = 1 then '+91 ' || lpad(cast({b} as string), 10, '8') "
                 f"when {key} % 9 = 2 then '(' || lpad(cast({b} as string), 10, '8') || ')' else lpad(cast({b} as string), 10, '8') end",
        "city": f"'City ' || ({b} % 25)",
        "address": f"case when {key} % 4 = 0 then '  ' || {b} || '  Main   Street' else {b} || ' main street' end",
        "gst": f"case when {key} % 6 = 0 then 'bad' else '27ABCDE' || lpad(cast({b} as string), 4, '1') || 'F1Z5' end",
        "zip": f"case when {key} % 8 = 0 then 'x-' || {b} else lpad(cast({b} as string), 6, '4') end",
        "date": f"case when {key} % 12 = 0 then '2024-13-01' when {key} % 12 = 1 then '5/6/2023' when {key} % 12 = 2 then '31 Jan 2022' "
                f"else '2024-0' || (1 + {key} % 9) || '-1' || ({key} % 10) end",
    }


_C, _S = _contact("c_custkey"), _contact("s_suppkey")
CRM = {
    "c_custkey": "c_custkey", "Customer Name": _C["name"], "Office Address": _C["address"], "Town": _C["city"],
    "Province": "c_mktsegment", "Contact Number": _C["phone"], "Mail ID": _C["email"],
}
VENDORS = {
    "s_suppkey": "s_suppkey", "Full Name": _S["name"], "Company": "s_name", "Address": _S["address"], "City": _S["city"],
    "State": "case when s_suppkey % 3 = 0 then 'MACHINERY' else 'BUILDING' end", "Mobile": _S["phone"],
    "Email Address": _S["email"], "GST Number": _S["gst"],
}
# A customer table with one column per validation rule.
CHECKED = {
    "row_id": "c_custkey", "contact_name": _C["name"], "contact_email": f"case when c_custkey % 23 = 0 then 'no mail' else {_C['email']} end", "phone": _C["phone"], "gst_no": _C["gst"],
    "shipping_zip": _C["zip"], "created_date": _C["date"], "column_9": "case when c_custkey % 3 = 0 then null else c_custkey end",
    "balance": "case when c_custkey % 50 = 0 then c_acctbal * 20 else c_acctbal end",
}
# Contact columns without a name, so that only exact detectors apply.
ACCOUNTS = {
    "row_id": "c_custkey", "email": _C["email"], "mobile": _C["phone"], "town": _C["city"], "segment": "c_mktsegment",
    "balance": "c_custkey % 2",
}
NAMED = {**ACCOUNTS, "full_name": _C["name"]}


def frame(spark: SparkSession, sf_dir: str, source: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[f"{e} as `{n}`" for n, e in columns.items()])


def select_sql(source: str, columns: dict[str, str]) -> str:
    return "select " + ", ".join(f'{e} as "{n}"' for n, e in columns.items()) + f" from {source}"


def contact_sheets(spark: SparkSession, sf_dir: str) -> list[Sheet]:
    return [
        Sheet(frame(spark, sf_dir, "customer", CRM), ["c_custkey"], "crm.csv", "crm", "sales", 1000),
        Sheet(frame(spark, sf_dir, "supplier", VENDORS), ["s_suppkey"], "vendors.csv", "vendors", "buying", 500),
    ]


# Canonical records of both sheets.
RECORDS_SQL = f"""
crm as ({select_sql("customer", CRM)}), ven as ({select_sql("supplier", VENDORS)}),
both_sheets as (
  select 0 as src, c_custkey as k, 'crm.csv' as source_file, 'crm' as sheet_name, 'sales' as folder_path,
    "Customer Name" as name, "Office Address" as address, "Town" as city, "Province" as state, "Contact Number" as phone,
    "Mail ID" as email, cast(null as varchar) as company, cast(null as varchar) as gst from crm
  union all
  select 1, s_suppkey, 'vendors.csv', 'vendors', 'buying', "Full Name", "Address", "City", "State", "Mobile", "Email Address",
    "Company", "GST Number" from ven),
rec as (select *, row_number() over (order by src, k) - 1 as ord, row_number() over (partition by src order by k) as rn from both_sheets)
"""


def n_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def n_exact(x: str) -> str:
    return f"lower({n_clean(x)})"


def n_hc(x: str) -> str:
    return f"trim(regexp_replace({n_exact(x)}, '[^\\w\\s]', '', 'g'))"


def n_digits(x: str) -> str:
    return f"regexp_replace({n_clean(x)}, '[^0-9]', '', 'g')"


def n_phone(x: str) -> str:
    d = n_digits(x)
    return f"(case when length({d}) = 12 and {d} like '91%' then substr({d}, 3) else {d} end)"


def joined_parts(parts: dict[str, str]) -> str:
    """Sorted ``label:value`` parts of non-empty values; empty text when there are none."""
    items = ", ".join(f"case when {v} <> '' then '{label}:' || {v} end" for label, v in parts.items())
    return f"array_to_string(list_sort(list_filter([{items}], lambda p: p is not null)), '||')"
