"""Consolidation of records into one master row per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stable
from .crossfile import with_fields
from .ordering import first_by, with_position
from .schema_map import Sheet

# Matching rules, phone and conflict fields, header candidates.
RULES = {
    "rule_1": ["Name", "Address", "City", "State", "Contact Number"],
    "rule_2": ["Email"],
    "rule_3": ["GST Number"],
    "rule_4": ["Customer ID"],
    "rule_5": ["Name", "Contact Number"],
}
RULE_NAMES = {
    "rule_1": "Full Profile Match (Name + Address + City + State + Contact)",
    "rule_2": "Email Only Match",
    "rule_3": "GST Number Match",
    "rule_4": "Customer ID Match",
    "rule_5": "Name & Contact Match",
}
PHONE_FIELDS = ("Phone Number", "Mobile", "Contact Number")
CONFLICT_FIELDS = ("Contact Number", "Phone Number", "Email", "Address", "City", "State")
MASTER_FIELDS = ("Name", "Address", "City", "State", "Contact Number", "Phone Number", "Email", "Company", "GST Number", "Customer ID")
HEADER_CANDIDATES = {
    "name": ("Customer Name", "Full Name", "Name", "name", "Title", "Product", "Item"),
    "address": ("Office Address", "Customer Address", "Address", "address", "Location"),
    "city": ("City", "Town", "city"),
    "state": ("State", "Province", "state"),
    "contact": ("Contact Number", "Phone Number", "Mobile", "phone"),
    "email": ("Email", "Mail ID", "Email Address", "email"),
    "company": ("Company", "company", "Vendor", "Supplier"),
    "gst": ("GST Number", "GST", "gst", "ID", "Code"),
    "customer_id": ("Customer ID", "customer_id", "ID", "Code", "SKU"),
}


def rule_fields(rule: str | None = "rule_1", fields: list[str] | None = None) -> list[str]:
    """Fields of a rule; custom fields win, an unknown rule means name and contact."""
    return list(fields) if fields else RULES.get(rule, RULES["rule_5"])


def match_key(records: DataFrame, rule: str | None = "rule_1", fields: list[str] | None = None, strict: bool = False) -> Column:
    """Key expression: sorted ``field:value`` parts, or a key of its own for a row without any.

    Headers meaning a contact number are mapped to "Phone Number", so that column
    also serves the field "Contact Number" unless ``strict``.
    """
    parts = []
    for f in rule_fields(rule, fields):
        source = f
        if f == "Contact Number" and not strict and f not in records.columns:
            source = "Phone Number"
        if source not in records.columns:
            continue
        c = F.col(tx.quoted(source))
        value = tx.norm_phone(c) if f in PHONE_FIELDS else tx.norm_email(c) if f == "Email" else tx.norm_exact(c)
        parts.append(F.when(value != "", F.concat(F.lit(f"{f}:"), value)))
    own = F.concat_ws("_", F.lit("_raw_row"), "source_file", "sheet_name", F.col("row_number").cast("string"))
    if not parts:
        return own
    present = F.array_sort(F.array_compact(F.array(*parts)))
    return F.when(F.size(present) > 0, F.array_join(present, "||")).otherwise(own)


class Consolidation:
    """Outputs of one consolidation run; each attribute is a DataFrame.

    The keyed records are checkpointed once, because four outputs read them.
    """

    def __init__(self, records: DataFrame, rule: str | None = "rule_1", fields: list[str] | None = None,
                 strict: bool = False, run_date: str | None = None):
        self.run_date = F.lit(run_date) if run_date else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        keyed = records.withColumn("key", match_key(records, rule, fields, strict))
        self.records = stable(with_fields(keyed, MASTER_FIELDS))
        self._entities = self._build_entities()

    def _build_entities(self) -> DataFrame:
        columns = [c for c in self.records.columns if c not in
                   ("ord", "source_file", "sheet_name", "folder_path", "row_number", "key", "raw_data")]
        golden = [first_by(F.col(tx.quoted(c)), F.col("ord"), ~tx.is_blank(F.col(tx.quoted(c)))).alias(c) for c in columns]
        firsts = [F.min_by(F.struct(*[F.col(tx.quoted(f)) for f in CONFLICT_FIELDS], "source_file", "sheet_name", "row_number"),
                           F.col("ord")).alias("_first")]
        entities = self.records.groupBy("key").agg(
            F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("total_occurrences"),
            # One entry per file.
            F.sort_array(F.collect_set("source_file")).alias("sources"), *golden, *firsts,
        )
        placed = with_position(entities, ["first_ord"], "master_no", 1)
        return placed.withColumn("master_id", F.format_string("M%06d", "master_no"))

    @property
    def masters(self) -> DataFrame:
        """Golden record per entity: each field is the first non-blank value in record order."""
        clean = lambda *names: tx.clean_text(F.coalesce(*[F.col(tx.quoted(n)) for n in names]))
        return self._entities.select(
            "master_id", clean("Name", "Company").alias("name"), clean("Address").alias("address"), clean("City").alias("city"),
            clean("State").alias("state"), clean("Contact Number", "Phone Number").alias("contact_number"),
            clean("Email").alias("email"), clean("Company").alias("company"), clean("GST Number").alias("gst_number"),
            clean("Customer ID").alias("customer_id"), F.size("sources").alias("source_count"),
            (F.col("total_occurrences") - 1).alias("duplicate_count"), "total_occurrences", "sources",
            self.run_date.alias("created_date"),
        )

    @property
    def references(self) -> DataFrame:
        """Audit trail: every record with the id of its master."""
        extra = ["raw_data"] if "raw_data" in self.records.columns else []
        return self.records.join(self._entities.select("key", "master_id"), "key").select(
            "master_id", "source_file", "sheet_name", "row_number", "folder_path", self.run_date.alias("import_date"), *extra
        )

    @property
    def unique_records(self) -> DataFrame:
        return self.masters.filter("duplicate_count = 0")

    @property
    def duplicate_groups(self) -> DataFrame:
        return self.masters.filter("duplicate_count > 0")

    @property
    def conflicts(self) -> DataFrame:
        """First record of an entity against every other one, per field; numbered in record order."""
        groups = self._entities.filter("total_occurrences > 1").select(
            "key", "master_no", "master_id", "first_ord", "_first",
            F.coalesce("Name", "Company", "master_id").alias("entity_name"),
        )
        rows = self.records.join(groups, "key").filter("ord > first_ord")
        checks = []
        for i, f in enumerate(CONFLICT_FIELDS):
            a, b = F.col(f"_first.{tx.quoted(f)}"), F.col(tx.quoted(f))
            na, nb = tx.norm_exact(a), tx.norm_exact(b)
            item = F.struct(F.lit(i).alias("no"), F.lit(f).alias("field_name"), a.alias("value_a"), b.alias("value_b"))
            checks.append(F.when((na != "") & (nb != "") & (na != nb), item))
        found = rows.select(
            "master_no", "master_id", "entity_name", "ord",
            F.col("_first.source_file").alias("source_a"), F.col("_first.sheet_name").alias("sheet_a"),
            F.col("_first.row_number").alias("row_a"), F.col("source_file").alias("source_b"),
            F.col("sheet_name").alias("sheet_b"), F.col("row_number").alias("row_b"),
            F.explode(F.array_compact(F.array(*checks))).alias("x"),
        ).select("*", "x.*")
        placed = with_position(found, ["master_no", "ord", "no"], "_c", 1)
        return placed.select(
            F.format_string("CONF-%05d", "_c").alias("conflict_id"), "master_id", "entity_name", "field_name",
            "value_a", "source_a", "sheet_a", "row_a", "value_b", "source_b", "sheet_b", "row_b", F.lit("pending").alias("status"),
        )


def consolidate(records: DataFrame, rule: str | None = "rule_1", fields: list[str] | None = None, strict: bool = False,
                run_date: str | None = None) -> Consolidation:
    return Consolidation(records, rule, fields, strict, run_date)


def mdm_summary(run: Consolidation, sheets: list[Sheet], missing: DataFrame) -> DataFrame:
    """Run statistics as one row."""
    count = F.count(F.lit(1))
    files = {s.file for s in sheets}
    sizes = {s.file: s.file_size for s in sheets}
    duplicate = F.col("duplicate_count") > 0
    return run.masters.agg(
        F.lit(len(files)).alias("total_files"), F.lit(len(sheets)).alias("total_worksheets"),
        F.sum("total_occurrences").alias("total_records"),
        F.lit(len({c for s in sheets for c in s.columns})).alias("total_columns"),
        F.lit(sum(sizes.values())).cast("long").alias("processing_size_bytes"),
        count.alias("master_records_count"), F.count_if(duplicate).alias("duplicate_groups_count"),
        F.sum("duplicate_count").alias("duplicate_records_count"), F.count_if(~duplicate).alias("unique_records_count"),
    ).select(
        "*", run.conflicts.agg(count).scalar().alias("conflicting_records_count"),
        missing.agg(count).scalar().alias("missing_records_count"),
    )


def resolve(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply a table of (conflict_id, action); ``apply_all`` keeps the first value everywhere."""
    action = F.when(F.col("action").startswith("resolved_"), F.col("action")).otherwise(F.concat(F.lit("resolved_"), "action"))
    chosen = decisions.groupBy("conflict_id").agg(F.max(action).alias("_status"))
    everywhere = F.coalesce(decisions.agg(F.max(F.col("action") == "apply_all")).scalar(), F.lit(False))
    out = conflicts.join(chosen, "conflict_id", "left")
    status = F.when(everywhere, "resolved_keep_first").otherwise(F.coalesce("_status", "status"))
    return out.withColumn("status", status).select(*conflicts.columns)


SEARCHED = ("master_id", "name", "address", "city", "state", "company", "contact_number", "email")
SEARCHED_REFERENCES = ("master_id", "source_file", "sheet_name", "folder_path")


def _contains(columns, q: str) -> Column:
    q = q.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)) for c in columns])


def _by_number() -> list:
    return [F.length("master_id"), "master_id"]


def search_masters(masters: DataFrame, q: str = "", city: str = "", state: str = "", min_dup: int = 0,
                   page: int | None = None, size: int = 50) -> DataFrame:
    """Case-insensitive search over eight fields with city, state and duplicate filters; pages count from 1.

    Pages follow the numbers of the ids, also where they have more than six digits.
    """
    from .query import page as take_page

    if q.strip():
        masters = masters.filter(_contains(SEARCHED, q))
    if city.strip():
        masters = masters.filter(_contains(["city"], city))
    if state.strip():
        masters = masters.filter(_contains(["state"], state))
    if min_dup > 0:
        masters = masters.filter(F.col("duplicate_count") >= min_dup)
    return masters if page is None else take_page(masters, _by_number(), page - 1, size)


def store_masters(masters: DataFrame, path: str | None = None):
    """Masters as a ``PagedTable`` by the numbers of their ids; its pages count from 0."""
    from .query import PagedTable

    return PagedTable.store(masters, _by_number(), path)


def search_references(references: DataFrame, q: str = "") -> DataFrame:
    return references.filter(_contains(SEARCHED_REFERENCES, q)) if q.strip() else references


def coalesced_records(sheets: list[Sheet], rule: str = "rule_1") -> DataFrame:
    """Records by fixed header lists instead of aliases, with their simpler match key."""
    parts = []
    depth = max(len(s.order_by) for s in sheets)
    for i, s in enumerate(sheets):
        def pick(headers, fallback=()):
            filled = [F.when(tx.text_of(s.df, h) != "", tx.text_of(s.df, h)) for h in (*headers, *fallback) if h in s.columns]
            return F.coalesce(*filled, F.lit(""))

        attrs = {a: pick(h, s.columns[:1] if a == "name" else ()) for a, h in HEADER_CANDIDATES.items()}
        low = {a: F.lower(tx.strip(c)) for a, c in attrs.items()}
        digits = F.regexp_replace(attrs["contact"], r"\D", "")
        profile = F.concat(F.lit("prof:"), F.concat_ws("|", low["name"], low["address"], low["city"], low["state"], digits))
        special = {
            "rule_2": (attrs["email"] != "", F.concat(F.lit("email:"), low["email"])),
            "rule_3": (attrs["gst"] != "", F.concat(F.lit("gst:"), low["gst"])),
            "rule_4": (attrs["customer_id"] != "", F.concat(F.lit("cid:"), low["customer_id"])),
            "rule_5": ((attrs["name"] != "") | (attrs["contact"] != ""), F.concat(F.lit("nc:"), F.concat_ws("|", low["name"], digits))),
        }
        key = F.when(special[rule][0], special[rule][1]).otherwise(profile) if rule in special else profile
        place = [
            (F.col(tx.quoted(s.order_by[k])) if k < len(s.order_by) else F.lit(None).cast("long")).alias(f"_o{k}") for k in range(depth)
        ]
        parts.append(s.df.select(F.lit(i).alias("_src"), *place, F.lit(s.file).alias("source_file"), F.lit(s.sheet).alias("sheet_name"),
                                 F.lit(s.folder).alias("folder_path"), key.alias("key"), *[c.alias(a) for a, c in attrs.items()]))
    union = reduce(DataFrame.unionByName, parts)
    return with_position(union, ["_src"] + [f"_o{k}" for k in range(depth)], "ord").drop(*[f"_o{k}" for k in range(depth)])


def _coalesced_entities(records: DataFrame) -> DataFrame:
    entities = records.groupBy("key").agg(
        F.min("ord").alias("first"), F.count(F.lit(1)).alias("total_occurrences"),
        F.count_distinct("source_file").alias("source_count"), F.min_by(F.struct(*HEADER_CANDIDATES), F.col("ord")).alias("g"),
    )
    return with_position(entities, ["first"], "_no", 1)


def coalesced_references(sheets: list[Sheet], rule: str = "rule_1") -> DataFrame:
    """Where each master of ``consolidate_coalesced`` occurs: one row per record."""
    records = coalesced_records(sheets, rule)
    masters = _coalesced_entities(records).select("key", F.format_string("M%06d", "_no").alias("master_id"))
    return records.join(masters, "key").select("master_id", "source_file", "sheet_name", "folder_path", "ord", "key")


def consolidate_coalesced(sheets: list[Sheet], rule: str = "rule_1") -> DataFrame:
    """Masters of ``coalesced_records``: the first record of a key is the golden one."""
    placed = _coalesced_entities(coalesced_records(sheets, rule))
    attrs = list(HEADER_CANDIDATES)
    renamed = {"contact": "contact_number", "gst": "gst_number"}
    return placed.select(
        F.format_string("M%06d", "_no").alias("master_id"), *[F.col(f"g.{a}").alias(renamed.get(a, a)) for a in attrs],
        "source_count", (F.col("total_occurrences") - 1).alias("duplicate_count"), "total_occurrences",
    )


def coalesced_summary(masters: DataFrame) -> DataFrame:
    duplicate = F.col("duplicate_count") > 0
    return masters.agg(
        F.sum("total_occurrences").alias("total_records"), F.count(F.lit(1)).alias("master_records_count"),
        F.count_if(duplicate).alias("duplicate_groups_count"), F.sum("total_occurrences").alias("duplicate_records_count"),
        F.count_if(~duplicate).alias("unique_records_count"),
        F.count_if((F.col("contact_number") == "") | (F.col("email") == "")).alias("missing_records_count"),
    )
