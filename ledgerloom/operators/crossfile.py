"""Matching of records across files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scoring import ratio as ratio_of
from ..session import stable
from .ordering import spread, with_position
from .profile import unpivot_text
from .schema_map import PROVENANCE, Sheet
from .similarity import distinct_values, value_pairs

# Compared fields, comparison window and levels.
FIELDS = ("Name", "Company", "Email", "Phone Number", "Address", "Customer ID", "GST Number")
WINDOW = 200
LENGTH_GAP = 10
SIMILAR_FROM, SIMILAR_BELOW = 80.0, 95.0
EXACT_LEVEL = "Exact Match (100%)"
NEAR_LEVEL = "High Confidence Match (95-99%)"
SIMILAR_LEVEL = "Similar Match (80-95%)"
POSSIBLE_LEVEL = "Possible Match"


def with_fields(records: DataFrame, fields) -> DataFrame:
    """Add canonical columns that no sheet has, as null."""
    for f in fields:
        if f not in records.columns:
            records = records.withColumn(f, F.lit(None).cast("string"))
    return records


def _exact_keys(records: DataFrame) -> DataFrame:
    """(ord, key): sorted ``field:value`` parts of the non-blank fields; null without any."""
    records = with_fields(records, FIELDS)
    parts = F.array(*[
        F.when(~tx.is_blank(F.col(tx.quoted(f))), F.concat(F.lit(f"{f}:"), tx.norm_exact(F.col(tx.quoted(f))))) for f in FIELDS
    ])
    present = F.array_sort(F.array_compact(parts))
    names = F.array_distinct(F.transform(present, lambda p: F.substring_index(p, ":", 1)))
    return records.select(*PROVENANCE, F.when(F.size(present) > 0, F.array_join(present, "||")).alias("key"), names.alias("fields"))


def exact_matches(records: DataFrame) -> DataFrame:
    """Records equal on all their non-blank fields, one row per member, groups numbered from 1."""
    keyed = _exact_keys(records).filter(F.col("key").isNotNull())
    groups = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("group_size"), F.min("ord").alias("first"), F.first("fields").alias("_f")
    ).filter("group_size > 1").drop("_f")
    numbered = with_position(groups, ["first"], "group_id", 1)
    names = F.array_join("fields", ", ")
    reason = F.concat(F.lit("Identical values across "), F.size("fields").cast("string"), F.lit(" canonical field(s): "), names)
    return keyed.join(numbered, "key").select(
        "group_id", *PROVENANCE, F.lit(EXACT_LEVEL).alias("match_level"), F.lit(100.0).alias("confidence"),
        names.alias("matching_fields"), reason.alias("reason"), "group_size",
    )


def _survivors(records: DataFrame) -> DataFrame:
    """Records outside exact groups with their comparison forms and contiguous ``pos``.

    The forms are computed before the checkpoint inside the numbering, so the
    NFKC function runs once per record and not once per pair.
    """
    records = with_fields(records, FIELDS)
    keys = _exact_keys(records).select("ord", "key")
    copied = keys.groupBy("key", spread("key")).agg(F.count(F.lit(1)).alias("n")).filter("key is not null and n > 1").select("key")
    exact = keys.join(copied, "key", "left_semi").select("ord")
    rest = records.join(exact, "ord", "left_anti")
    name = tx.clean_text(F.coalesce(F.when(F.col("Name") != "", F.col("Name")), F.col("Company")))
    slim = rest.select(
        *PROVENANCE, name.alias("name"), F.col("Email").alias("email_raw"), F.col("`Phone Number`").alias("phone_raw"),
        tx.norm_exact(F.col("Email")).alias("email"), tx.norm_high_confidence(F.col("`Phone Number`")).alias("phone"),
    ).withColumn("plain", tx.strip(F.regexp_replace(F.lower("name"), r"(?U)[^\w\s]", ""))).withColumn("lower", F.lower("name"))
    return with_position(slim, ["ord"], "pos")


def _window_pairs(rows: DataFrame, window: int) -> DataFrame:
    """Candidate pairs less than ``window`` apart in the global order, with their ratio.

    The pairs come from a join on ``pos div window``, where a record also stands in
    the bucket before its own, so a bucket holds at most two windows of records.
    """
    bucket = F.floor(F.col("pos") / window)
    letters = F.array_distinct(F.split("lower", ""))
    rows = rows.withColumn("letters", letters)
    cols = rows.columns
    left = rows.select(bucket.alias("bucket"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = rows.select(F.explode(F.array(bucket, bucket - 1)).alias("bucket"), *[F.col(c).alias(f"{c}_b") for c in cols])
    gap = F.col("pos_b") - F.col("pos_a")
    pairs = left.join(right, "bucket").filter((gap >= 1) & (gap < window))
    high = (F.col("plain_a") != "") & (F.col("plain_a") == F.col("plain_b")) & (F.col("name_a") != F.col("name_b"))
    same = F.col("lower_a") == F.col("lower_b")
    a, b = F.length("lower_a"), F.length("lower_b")
    # A ratio of 80 leaves at most this many letters of either side unmatched.
    floor_lcs = F.ceil((a + b) * (SIMILAR_FROM / 200) - 1e-6)
    close = (
        (F.abs(a - b) <= LENGTH_GAP) & (F.least(a, b) >= floor_lcs)
        & (F.size(F.array_except("letters_a", "letters_b")) <= a - floor_lcs)
        & (F.size(F.array_except("letters_b", "letters_a")) <= b - floor_lcs)
    )
    pairs = pairs.filter(high | same | close).withColumn("_high", high).withColumn("_same", same)
    # Pairs already decided hand nulls to the scorer.
    open_ = ~F.col("_high") & ~F.col("_same")
    ratio = ratio_of(F.when(open_, F.col("lower_a")), F.when(open_, F.col("lower_b")))
    return pairs.withColumn("ratio", F.when(F.col("_same"), F.lit(100.0)).otherwise(ratio))


@dataclass(frozen=True)
class NearClasses:
    """Near matches as classes of records and links between classes, without their pairs.

    What a pair is follows from its two names alone, so it is decided once for all
    records of a class. ``members`` has one row per record with its three class
    keys: ``plain`` (cleaned name), ``lower`` (name in lower case) and ``same``
    (records that are possible matches of each other). ``names`` counts records per
    name. ``links`` has one row (match_level, key_a, key_b, ratio, pairs) per

    - ``plain`` with more than one name: high confidence, any two records of different names;
    - ``same`` with more than one record: possible matches, any two records;
    - two values of ``lower`` of similar spelling: similar matches, each record with each.

    Size and work grow with the records and with the links of different texts: a
    name on m records is one link of m(m-1)/2 pairs. ``expand`` writes the pairs out.
    """

    members: DataFrame
    names: DataFrame
    links: DataFrame

    def partners(self) -> DataFrame:
        """Per name: records, and how many other records one of them matches at each level."""
        def sums(*groups: str) -> DataFrame:
            return self.names.groupBy(*groups, spread(*groups)).agg(F.sum("n").alias(f"_{groups[0]}")).drop("_spread")

        similar = self.links.filter(F.col("match_level") == SIMILAR_LEVEL)
        both = similar.select("key_a", "key_b").unionAll(similar.select("key_b", "key_a")).toDF("lower", "other")
        texts = self.names.groupBy(F.col("lower").alias("other")).agg(F.sum("n").alias("n"))
        near = both.join(texts, "other").groupBy("lower").agg(F.sum("n").alias("_near"))
        out = self.names.join(sums("plain"), "plain").join(sums("same"), "same").join(near, "lower", "left")
        return out.select(
            "name", "n", F.when(F.col("plain") != "", F.col("_plain") - F.col("n")).otherwise(0).alias("high_partners"),
            (F.col("_same") - 1).alias("possible_partners"),
            F.coalesce("_near", F.lit(0)).alias("similar_partners"),
        )

    def per_record(self) -> DataFrame:
        """The number of partners at each level of every record that has a name."""
        return self.members.select("ord", "name").join(self.partners().drop("n"), "name").drop("name")

    def conflicts(self) -> DataFrame:
        """Differing e-mails and phones inside a class of possible matches, one row per class and field:
        its different values, the records that have one, and the pairs of records that differ."""
        fields = F.explode(F.array(
            F.struct(F.lit("Email").alias("field_name"), F.col("email").alias("value")),
            F.struct(F.lit("Phone Number").alias("field_name"), F.col("phone").alias("value")),
        ))
        values = self.members.select("same", fields.alias("x")).filter("x.value <> ''").groupBy("same", "x.field_name", "x.value").agg(F.count(F.lit(1)).alias("n"))
        return values.groupBy("same", "field_name").agg(
            F.count(F.lit(1)).alias("values"), F.sum("n").alias("records"), _unequal_pairs().alias("pairs")
        ).filter(F.col("values") > 1).withColumnRenamed("same", "entity_key")

    def expand(self) -> DataFrame:
        """All pairs of records, the earlier one first."""
        a, b = (self.members.select(*[F.col(c).alias(f"{c}_{s}") for c in self.members.columns]) for s in "ab")
        links = self.links.select("match_level", "key_a", "key_b", "ratio")
        flipped = links.select("match_level", F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "ratio")
        parts = []
        for level, key in ((NEAR_LEVEL, "plain"), (POSSIBLE_LEVEL, "same"), (SIMILAR_LEVEL, "lower")):
            found = (links.unionAll(flipped) if level == SIMILAR_LEVEL else links).filter(F.col("match_level") == level)
            pairs = found.join(a, F.col("key_a") == F.col(f"{key}_a")).join(b, F.col("key_b") == F.col(f"{key}_b")).filter("pos_b > pos_a")
            parts.append(pairs.filter("name_a <> name_b") if level == NEAR_LEVEL else pairs)
        return reduce(DataFrame.unionByName, parts).drop("match_level", "key_a", "key_b").withColumn(
            "_high", (F.col("plain_a") != "") & (F.col("plain_a") == F.col("plain_b")) & (F.col("name_a") != F.col("name_b"))
        ).withColumn("_same", F.col("lower_a") == F.col("lower_b"))


def _unequal_pairs() -> Column:
    """Pairs of rows in different subgroups of ``n`` rows each, beyond the range of a long too."""
    n = F.col("n").cast("decimal(18,0)")
    return ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).cast("decimal(38,0)")


def near_classes(records: DataFrame, similar_below: float = SIMILAR_BELOW) -> NearClasses:
    """Near matches of records at any distance, left as classes and links. Records without a name have none."""
    same = F.when(F.col("plain") != "", F.col("name")).otherwise(F.col("lower"))
    members = stable(_survivors(records).filter(F.col("name") != "").withColumn("same", same))
    names = stable(members.groupBy("name", "lower", "plain", "same").agg(F.count(F.lit(1)).alias("n")))
    none = F.lit(None).cast("double")

    def own(level: str, key: str, pairs: Column, keep: Column) -> DataFrame:
        groups = names.groupBy(F.col(key).alias("key_a")).agg(pairs.alias("pairs"), keep.alias("_keep")).filter("_keep")
        return groups.select(F.lit(level).alias("match_level"), "key_a", F.col("key_a").alias("key_b"), none.alias("ratio"), "pairs")

    total = F.sum("n").cast("decimal(18,0)")
    high = own(NEAR_LEVEL, "plain", _unequal_pairs(), F.count(F.lit(1)) > 1).filter("key_a <> ''")
    possible = own(POSSIBLE_LEVEL, "same", (total * (total - 1) / 2).cast("decimal(38,0)"), F.sum("n") > 1)
    texts = names.groupBy("lower", "plain").agg(F.sum("n").alias("n"))
    a, b = (texts.select(F.col("lower").alias(f"key_{s}"), F.col("plain").alias(f"plain_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    found = value_pairs(distinct_values(names, "lower"), None, "ratio", SIMILAR_FROM)
    found = found.filter((F.abs(F.length("vl") - F.length("vr")) <= LENGTH_GAP) & (F.col("score") < similar_below))
    found = found.select(F.least("vl", "vr").alias("key_a"), F.greatest("vl", "vr").alias("key_b"), F.col("score").alias("ratio"))
    similar = found.join(a, "key_a").join(b, "key_b").filter((F.col("plain_a") != F.col("plain_b")) | (F.col("plain_a") == "")).select(
        F.lit(SIMILAR_LEVEL).alias("match_level"), "key_a", "key_b", "ratio",
        (F.col("n_a").cast("decimal(18,0)") * F.col("n_b").cast("decimal(18,0)")).cast("decimal(38,0)").alias("pairs"),
    )
    return NearClasses(members, names, stable(high.unionByName(possible).unionByName(similar)))


def near_matches(
    records: DataFrame, window: int | None = None, similar_below: float = SIMILAR_BELOW, classes: NearClasses | None = None
) -> DataFrame:
    """Pairs of near-equal records: high confidence, similar or possible, in that order.

    All pairs of records are considered, by writing out ``classes`` (see
    ``near_classes``, which has the same result without a row per pair); with a
    ``window``, each record meets only the next ``window - 1`` records of the global order.
    """
    if window is None:
        pairs = (classes or near_classes(records, similar_below)).expand()
    else:
        pairs = _window_pairs(_survivors(records).filter(F.col("name") != ""), window)
    similar = (F.col("ratio") >= SIMILAR_FROM) & (F.col("ratio") < similar_below)
    level = F.when(F.col("_high"), NEAR_LEVEL).when(similar & ~F.col("_same"), SIMILAR_LEVEL).when(F.col("_same"), POSSIBLE_LEVEL)
    score = F.when(F.col("_high"), F.lit(97.0)).when(F.col("_same"), F.lit(75.0)).otherwise(F.round("ratio", 1))
    quote = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    reason = (
        F.when(F.col("_high"), F.concat(F.lit("Case/formatting difference only ("), quote("name_a"), F.lit(" vs "), quote("name_b"), F.lit(")")))
        .when(F.col("_same"), F.concat(F.lit("Same Name ("), quote("name_a"), F.lit("), but differing details across files")))
        .otherwise(F.concat(F.lit("Minor spelling difference ("), F.bround("ratio", 0).cast("int").cast("string"), F.lit("% similarity: "),
                            quote("name_a"), F.lit(" vs "), quote("name_b"), F.lit(")")))
    )
    fields = F.when(F.col("_same") & ~F.col("_high"), "Name").otherwise("Name/Company")
    out = pairs.withColumn("match_level", level).filter(F.col("match_level").isNotNull())
    sides = [f"{c}_{s}" for s in ("a", "b") for c in (*PROVENANCE, "name", "email_raw", "phone_raw", "email", "phone")]
    return out.select(*sides, "match_level", score.alias("confidence"), fields.alias("matching_fields"), reason.alias("reason"))


def match_conflicts(pairs: DataFrame) -> DataFrame:
    """Email and phone differences of possible matches."""
    sides = ("source_file", "sheet_name", "row_number")

    def check(field: str, name: str) -> Column:
        a, b = F.col(f"{field}_a"), F.col(f"{field}_b")
        item = F.struct(
            F.lit(name).alias("field_name"), F.col(f"{field}_raw_a").alias("value_a"), F.col(f"{field}_raw_b").alias("value_b")
        )
        return F.when((a != "") & (b != "") & (a != b), item)

    found = F.array_compact(F.array(check("email", "Email"), check("phone", "Phone Number")))
    rows = pairs.filter(F.col("match_level") == POSSIBLE_LEVEL).select(
        F.col("name_a").alias("entity_name"), "ord_a", "ord_b", *[f"{c}_{s}" for s in "ab" for c in sides], F.explode(found).alias("x")
    )
    return rows.select("entity_name", "x.*", "ord_a", "ord_b", *[f"{c}_{s}" for s in "ab" for c in sides])


def missing_cells(sheets: list[Sheet], row_number: str | None = None) -> DataFrame:
    """One row per null or blank cell.

    Row numbers come from ``row_number`` when the sheets carry one, else from the
    order columns of each sheet.
    """
    parts = []
    for s in sheets:
        if row_number is None:
            df = with_position(s.df.select(*{*s.order_by, *s.columns}), s.order_by, "_row", 1)
        else:
            df = s.df.withColumn("_row", F.col(row_number))
        cells = unpivot_text(df, s.columns, ["_row"], "missing_column", "value").filter(tx.is_blank(F.col("value")))
        parts.append(cells.select(
            F.lit(s.file).alias("source_file"), F.lit(s.sheet).alias("sheet_name"), F.col("_row").alias("row_number"),
            F.lit(s.folder).alias("folder_path"), "missing_column",
            F.concat(F.lit("Field '"), F.col("missing_column"), F.lit("' is empty")).alias("details"),
        ))
    return reduce(DataFrame.unionByName, parts)


def cross_summary(records: DataFrame, exact: DataFrame, pairs: DataFrame, conflicts: DataFrame, missing: DataFrame,
                  files: int, worksheets: int) -> DataFrame:
    """Counts of the cross-file run as one row."""
    flagged = (
        exact.select("ord").unionAll(pairs.select(F.col("ord_a").alias("ord"))).unionAll(pairs.select(F.col("ord_b").alias("ord"))).distinct()
    )
    level = F.col("match_level")
    count = F.count(F.lit(1))
    near = pairs.agg(
        F.struct((2 * F.count_if(level != POSSIBLE_LEVEL)).alias("similar"), F.count_if(level == POSSIBLE_LEVEL).alias("possible"))
    ).scalar()
    row = records.agg(
        F.lit(files).alias("total_files"), F.lit(worksheets).alias("total_worksheets"), count.alias("total_records")
    ).withColumn("_near", near).withColumn("_flagged", flagged.agg(count).scalar())
    return row.select(
        "total_files", "total_worksheets", "total_records", exact.agg(count).scalar().alias("exact_duplicates"),
        F.col("_near.similar").alias("similar_records"), F.col("_near.possible").alias("possible_matches"),
        F.greatest(F.lit(0), F.col("total_records") - F.col("_flagged")).alias("unique_records"),
        conflicts.agg(count).scalar().alias("conflicting_records"), missing.agg(count).scalar().alias("missing_records"),
    )


def class_summary(records: DataFrame, exact: DataFrame, near: NearClasses, missing: DataFrame, files: int, worksheets: int) -> DataFrame:
    """The row of ``cross_summary`` counted from classes and links; no pair of records is built."""
    count = F.count(F.lit(1))
    level = F.col("match_level")
    zero = F.lit(0).cast("long")
    pairs = near.links.agg(
        F.coalesce(F.sum(F.when(level != POSSIBLE_LEVEL, F.col("pairs"))).cast("long"), zero).alias("unlike"),
        F.coalesce(F.sum(F.when(level == POSSIBLE_LEVEL, F.col("pairs"))).cast("long"), zero).alias("possible"),
    ).select(F.struct("unlike", "possible")).scalar()
    # Records of exact groups are no members, so the two counts of flagged records share none.
    matched = near.partners().filter("high_partners + possible_partners + similar_partners > 0").agg(F.coalesce(F.sum("n"), zero)).scalar()
    conflicts = near.conflicts().agg(F.coalesce(F.sum("pairs").cast("long"), zero)).scalar()
    row = records.agg(
        F.lit(files).alias("total_files"), F.lit(worksheets).alias("total_worksheets"), count.alias("total_records")
    ).withColumn("_pairs", pairs).withColumn("exact_duplicates", exact.agg(count).scalar())
    return row.select(
        "total_files", "total_worksheets", "total_records", "exact_duplicates",
        (2 * F.col("_pairs.unlike")).alias("similar_records"), F.col("_pairs.possible").alias("possible_matches"),
        (F.col("total_records") - F.col("exact_duplicates") - matched).alias("unique_records"),
        conflicts.alias("conflicting_records"), missing.agg(count).scalar().alias("missing_records"),
    )


# Headers that identify a row, in order of preference.
MATCH_HEADERS = ("Booking number", "Email address", "Email", "customer_id", "Customer ID")


def cross_match(sheets: list[Sheet]) -> DataFrame:
    """Keys that occur more than once over all sheets, with the first row that has them.

    The key is the first filled identifying column, else all filled cells of a
    row that has at least three.
    """
    parts = []
    depth = max(len(s.order_by) for s in sheets)
    for i, s in enumerate(sheets):
        text = {c: tx.text_of(s.df, c) for c in s.columns}
        named = [F.when(text[h] != "", text[h]) for h in MATCH_HEADERS if h in s.columns]
        cells = F.array_compact(F.array(*[F.when(~tx.is_blank(t), tx.strip(t)) for t in text.values()]))
        fallback = F.when(F.size(cells) > 2, F.array_join(cells, "|"))
        raw = F.coalesce(*named, fallback)
        place = [
            (F.col(tx.quoted(s.order_by[k])) if k < len(s.order_by) else F.lit(None).cast("long")).alias(f"_o{k}") for k in range(depth)
        ]
        parts.append(s.df.select(
            F.lower(tx.strip(raw)).alias("key"), F.lit(i).alias("_src"), *place,
            *[t.alias(c) for c, t in text.items()],
        ))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    shown = [c for c in union.columns if c not in ("key", "_src") and c not in [f"_o{k}" for k in range(depth)]]
    place = F.struct("_src", *[f"_o{k}" for k in range(depth)])
    first = F.min_by(F.struct(*[F.col(tx.quoted(c)) for c in shown]), place)
    # The sheets that hold a key are a bit map, 63 sheets to a number.
    words = range((len(sheets) + 62) // 63)
    none = F.lit(0).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_src"), F.lit(63)))
    maps = [F.bit_or(F.when(F.floor(F.col("_src") / 63) == w, bit).otherwise(none)).alias(f"_w{w}") for w in words]
    out = union.groupBy("key").agg(F.count_if(F.col("key") != "").alias("Match_Occurrences"), *maps, first.alias("_row"))
    labels = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.col(f"_w{i // 63}").bitwiseAND(F.lit(1 << (i % 63)).cast("long")) != 0, F.lit(f"{s.file} ({s.sheet})"))
        for i, s in enumerate(sheets)
    ])))
    return out.filter("Match_Occurrences > 1").select("key", "Match_Occurrences", F.array_join(labels, "; ").alias("Matched_In_Files"), "_row.*")
