"""Report tables assembled from the matching and consolidation operators."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import crossfile as xf
from ..operators import dedupe, profile, validate
from ..operators.mdm import RULE_NAMES, Consolidation, mdm_summary, rule_fields
from ..operators.ordering import with_position
from ..operators.schema_map import Sheet, canonical_records
from ..session import stable
from ..sources import sinks


def _place(file: str, sheet: str, row: str) -> Column:
    return F.format_string("%s (%s:L%d)", file, sheet, row)


def _filled(*names: str) -> Column:
    parts = [F.when(F.col(tx.quoted(n)) != "", F.col(tx.quoted(n))) for n in names]
    return F.coalesce(*parts, F.lit(""))


def metric_rows(summary: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One KPI row as (metric, value) rows with report labels."""
    wide = summary.select(*[F.col(tx.quoted(c)).cast("string").alias(label) for c, label in labels.items()])
    return wide.unpivot([], [tx.quoted(label) for label in labels.values()], "metric", "value")


class DuplicateReport:
    """Tables of the cross-file report; each is built when it is first asked for.

    """

    NAMES = ("exact_duplicates", "similar_records", "conflicting_records", "missing_data", "summary")

    def __init__(self, sheets: list[Sheet], window: int | None = None):
        self.sheets, self.window = sheets, window

    @cached_property
    def records(self) -> DataFrame:
        return stable(canonical_records(self.sheets))

    @cached_property
    def exact(self) -> DataFrame:
        return xf.exact_matches(self.records)

    @cached_property
    def pairs(self) -> DataFrame:
        return stable(xf.near_matches(self.records, self.window, classes=self.classes if self.window is None else None))

    @cached_property
    def classes(self) -> xf.NearClasses:
        return xf.near_classes(self.records)

    @cached_property
    def missing(self) -> DataFrame:
        return xf.missing_cells(self.sheets)

    @cached_property
    def exact_duplicates(self) -> DataFrame:
        fields = xf.with_fields(self.records, xf.FIELDS).select("ord", *[tx.quoted(f) for f in xf.FIELDS])
        return self.exact.join(fields, "ord").select(
            F.col("group_id").alias("Group"), _filled("Name", "Company").alias("Name"), _filled("Address").alias("Address"),
            _filled("Email").alias("Email"), _filled("Phone Number").alias("Phone"), F.col("source_file").alias("Source File"),
            F.col("sheet_name").alias("Sheet"), F.col("row_number").alias("Row"), F.col("match_level").alias("Match Type"),
            F.format_string("%.0f%%", "confidence").alias("Confidence Score"),
        )

    @cached_property
    def similar_records(self) -> DataFrame:
        """Similar and possible pairs; their ids continue those of the exact groups in pair order."""
        offset = self.exact.agg(F.coalesce(F.max("group_id"), F.lit(0))).scalar()
        sources = F.array_distinct(F.array(_place("source_file_a", "sheet_name_a", "row_number_a"),
                                           _place("source_file_b", "sheet_name_b", "row_number_b")))
        return with_position(self.pairs, ["ord_a", "ord_b"], "_n", 1).select(
            (F.col("_n") + offset).alias("Group ID"), F.col("name_a").alias("Name / Primary Entity"),
            F.format_string("%.1f%%", "confidence").alias("Similarity"), F.col("matching_fields").alias("Matching Fields"),
            F.array_join(sources, " | ").alias("Source Files"), F.col("reason").alias("Details"),
        )

    @cached_property
    def conflicting_records(self) -> DataFrame:
        return xf.match_conflicts(self.pairs).select(
            F.col("entity_name").alias("Entity Name"), F.col("field_name").alias("Field"), F.col("value_a").alias("Old Value"),
            F.col("value_b").alias("New Value"), _place("source_file_a", "sheet_name_a", "row_number_a").alias("Source A"),
            _place("source_file_b", "sheet_name_b", "row_number_b").alias("Source B"),
        )

    @cached_property
    def missing_data(self) -> DataFrame:
        return self.missing.select(
            F.col("source_file").alias("File"), F.col("sheet_name").alias("Sheet"), F.col("row_number").alias("Row"),
            F.col("missing_column").alias("Missing Column"), F.col("details").alias("Details"),
        )

    @cached_property
    def summary(self) -> DataFrame:
        labels = {
            "total_files": "Total Files Processed", "total_worksheets": "Total Worksheets Analyzed",
            "total_records": "Total Records Analyzed", "exact_duplicates": "Exact Duplicate Records",
            "similar_records": "Similar Match Records", "possible_matches": "Possible Match Records",
            "unique_records": "Unique Records", "conflicting_records": "Conflicting Records Flagged",
            "missing_records": "Missing Data Instances",
        }
        size = len({s.file for s in self.sheets}), len(self.sheets)
        if self.window is None:
            counts = xf.class_summary(self.records, self.exact, self.classes, self.missing, *size)
        else:
            counts = xf.cross_summary(self.records, self.exact, self.pairs, xf.match_conflicts(self.pairs), self.missing, *size)
        return metric_rows(counts, labels)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}


class MasterReport:
    """Tables of a consolidation run; each is built when it is first asked for."""

    NAMES = ("master_records", "duplicate_references", "unique_records", "conflicting_records", "missing_data", "statistics",
             "analysis_summary")

    def __init__(self, run: Consolidation, sheets: list[Sheet], rule: str | None = "rule_1", fields: list[str] | None = None):
        self.run, self.sheets, self.rule, self.fields = run, sheets, rule, fields

    @cached_property
    def missing(self) -> DataFrame:
        return xf.missing_cells(self.sheets)

    @cached_property
    def master_records(self) -> DataFrame:
        titles = {
            "master_id": "Master ID", "name": "Name", "address": "Address", "city": "City", "state": "State",
            "contact_number": "Contact Number", "email": "Email", "company": "Company", "gst_number": "GST Number",
            "customer_id": "Customer ID", "source_count": "Source Count", "duplicate_count": "Duplicate Count",
            "total_occurrences": "Total Occurrences", "created_date": "Created Date",
        }
        return self.run.masters.select(*[F.col(c).alias(t) for c, t in titles.items()])

    @cached_property
    def duplicate_references(self) -> DataFrame:
        return self.run.references.select(
            F.col("master_id").alias("Master ID"), F.col("source_file").alias("Source File"), F.col("sheet_name").alias("Worksheet"),
            F.col("row_number").alias("Row Number"), F.col("folder_path").alias("Folder Path"), F.col("import_date").alias("Import Date"),
        )

    @cached_property
    def unique_records(self) -> DataFrame:
        return self.master_records.filter(F.col("Duplicate Count") == 0)

    @cached_property
    def conflicting_records(self) -> DataFrame:
        return self.run.conflicts.select(
            F.col("conflict_id").alias("Conflict ID"), F.col("master_id").alias("Master ID"), F.col("entity_name").alias("Entity Name"),
            F.col("field_name").alias("Field Name"), F.col("value_a").alias("Value A"),
            _place("source_a", "sheet_a", "row_a").alias("Source A (Sheet:Row)"), F.col("value_b").alias("Value B"),
            _place("source_b", "sheet_b", "row_b").alias("Source B (Sheet:Row)"), F.col("status").alias("Status"),
        )

    @cached_property
    def missing_data(self) -> DataFrame:
        return self.missing.select(
            F.col("source_file").alias("File"), F.col("sheet_name").alias("Worksheet"), F.col("row_number").alias("Row Number"),
            F.col("folder_path").alias("Folder Path"), F.col("missing_column").alias("Missing Column"), F.col("details").alias("Details"),
        )

    @cached_property
    def statistics(self) -> DataFrame:
        labels = {
            "total_files": "Total Spreadsheets Found", "total_worksheets": "Total Worksheets Scanned",
            "total_records": "Total Indexed Records", "total_columns": "Total Unique Columns", "size_mb": "Processing Data Size (MB)",
            "master_records_count": "Master Dataset Records", "duplicate_groups_count": "Duplicate Record Groups",
            "duplicate_records_count": "Total Duplicate References", "unique_records_count": "Unique Records (Non-Duplicate)",
            "conflicting_records_count": "Conflicting Field Instances", "missing_records_count": "Missing Field Entries",
        }
        megabytes = F.format_string("%.2f MB", F.col("processing_size_bytes") / (1024 * 1024))
        return metric_rows(mdm_summary(self.run, self.sheets, self.missing).withColumn("size_mb", megabytes), labels)

    @cached_property
    def analysis_summary(self) -> DataFrame:
        name = "Custom Matching Fields" if self.fields else RULE_NAMES.get(self.rule, "Default Match (Name + Contact)")
        rows = [("Matching Rule Name", name), ("Matching Fields Evaluated", ", ".join(rule_fields(self.rule, self.fields)))]
        return self.run.records.sparkSession.createDataFrame(rows, "metric string, value string")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}


def report_package(datasets: dict[str, DataFrame], row_ids: dict[str, str], out: str, threshold: float = 88.0) -> dict[str, str]:
    """KPI JSON, duplicate and validation tables of a set of tables, and their display extracts."""
    data = {n: df.drop(row_ids[n]) for n, df in datasets.items()}
    sinks.write_summary(profile.summarise(data), f"{out}/summary")
    found, issues = [], []
    for name, df in datasets.items():
        rid = row_ids[name]
        groups = dedupe.detect_smart(df, rid, threshold).withColumnRenamed(rid, "row_index").withColumn("dataset", F.lit(name))
        found.append(groups)
        issues.append(validate.validate(df, rid).withColumn("dataset", F.lit(name)))
    groups = stable(reduce(DataFrame.unionByName, found))
    problems = stable(reduce(DataFrame.unionByName, issues))
    shown = groups.select("dataset", "detector", "group_first", "method", "group_size", "confidence", "reason").distinct()
    written = sinks.write_tables(
        {
            "duplicates": sinks.duplicates_or_info(groups), "validation": sinks.validation_or_info(problems),
            "top_groups": shown, "top_issues": problems.select("dataset", "row", "column", "severity", "rule", "message"),
        },
        out, "parquet",
    )
    return {"summary": f"{out}/summary", **written}
