"""Exact and near duplicate groups as flat tables.

A group table has one row per member: key, detector, group_first, row_id column,
similarity, confidence, method, reason, group_size. ``group_first`` is the
smallest row id of the group, so (detector, group_first) orders the groups.

Members find their group by a join on the key of a pre-aggregated group table, not
by a window, so that a key holding a large share of the rows is split at run time
(see ``ordering.spread``).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import stable
from .graph import components
from .ordering import spread, with_position
from .similarity import _key, value_pairs

# Header words by kind of column, and the order of detectors.
COLUMN_HINTS = {
    "email": ("email", "e-mail", "mail", "email_address", "emailid"),
    "phone": ("phone", "mobile", "contact", "tel", "telephone", "phone_no", "mobile_no"),
    "id": ("id", "customer_id", "cust_id", "user_id", "record_id"),
    "invoice": ("invoice", "invoice_no", "invoice_id", "bill_no", "bill_id"),
    "gst": ("gst", "gstin", "tax_id", "vat", "gst_no"),
    "product": ("product", "product_code", "sku", "item_code", "product_id"),
    "name": ("name", "full_name", "customer_name", "company", "company_name"),
    "address": ("address", "addr", "street", "location"),
    "city": ("city", "town"),
    "state": ("state", "province", "region"),
    "country": ("country", "nation"),
    "zip": ("zip", "postcode", "postal_code", "pincode", "pin"),
    "date": ("date", "created", "updated", "timestamp", "dob", "birthday"),
    "amount": ("amount", "price", "cost", "total", "value", "salary"),
}
EXACT_KINDS = ("email", "phone", "id", "invoice", "gst")
FUZZY_KINDS = ("product", "name")
# Cell separator inside a row text while it is normalised as one string.
_CELL = "\u0001"


def row_text(df: DataFrame, columns: list[str], norm: str = "full") -> Column:
    """Normalised cells of a row in one string.

    ``full`` normalises the joined row at once, which equals joining normalised
    cells: the separator is no white space and composes with nothing.
    """
    if norm == "light":
        cells = []
        for c in columns:
            text = tx.text_of(df, c)
            dtype = df.schema[c].dataType
            if isinstance(dtype, T.NumericType):
                text = F.when(F.col(tx.quoted(c)) != 0, text)
            elif isinstance(dtype, T.BooleanType):
                text = F.when(F.col(tx.quoted(c)), text)
            cells.append(tx.norm_light(text))
        return F.concat_ws("||", *cells)
    joined = F.concat_ws(_CELL, *[F.coalesce(tx.text_of(df, c), F.lit("")) for c in columns])
    packed = F.regexp_replace(tx.squeeze(tx.nfkc(joined)), f" ?{_CELL} ?", _CELL)
    return F.translate(F.lower(tx.strip(packed)), _CELL, "|")


def _groups(keyed: DataFrame, row_id: str, method: str, reason: str, detector: int) -> DataFrame:
    """Members of keys with more than one row; ``keyed`` has (row_id, key)."""
    sizes = keyed.groupBy("key", spread("key")).agg(F.count(F.lit(1)).alias("group_size"), F.min(row_id).alias("group_first"))
    return keyed.join(sizes.filter("group_size > 1").drop("_spread"), "key").select(
        "key", F.lit(detector).alias("detector"), "group_first", row_id, F.lit(100.0).alias("similarity"),
        F.lit(100.0).alias("confidence"), F.lit(method).alias("method"), F.lit(reason).alias("reason"), "group_size",
    )


def detect_exact(df: DataFrame, row_id: str, subset: list[str] | None = None, norm: str = "full", detector: int = 0) -> DataFrame:
    """Rows equal over ``subset`` after normalisation, keyed by SHA-1 of the row text."""
    columns = subset or [c for c in df.columns if c != row_id]
    keyed = df.select(row_id, F.sha1(row_text(df, columns, norm)).alias("key"))
    return _groups(keyed, row_id, "hash", f"Identical values across {len(columns)} columns", detector)


def detect_by_column(df: DataFrame, row_id: str, column: str, detector: int = 0) -> DataFrame:
    """Rows with the same normalised non-blank value of one column."""
    keyed = df.select(row_id, tx.norm_exact(tx.text_of(df, column)).alias("key")).filter("key != ''")
    return _groups(keyed, row_id, "column_exact", f"Same '{column}' value", detector)


#: Rounds in which all nodes are decided at once, before components are looked for; most edges of a component decided in one task.
QUICK_ROUNDS, GROUP_EDGES = 4, 1 << 20


def _round(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Followers of the nodes without an earlier neighbour, and the edges between nodes that stay undecided."""
    heads = active.select("lo").distinct().join(active.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
    covered = stable(active.join(heads, "lo", "left_semi").select("hi").distinct())
    gone = covered.withColumnRenamed("hi", "lo")
    return covered, stable(active.join(covered, "hi", "left_anti").join(gone, "lo", "left_anti").select("lo", "hi"))


def _in_order(table: pa.Table) -> pa.Table:
    """Followers of one component: its nodes in order, each one not yet taken takes its later neighbours."""
    table = table.sort_by([("lo", "ascending")])
    covered: set = set()
    for lo, hi in zip(table["lo"].to_pylist(), table["hi"].to_pylist(), strict=True):
        if lo not in covered:
            covered.add(hi)
    return pa.table({"hi": pa.array(sorted(covered), type=table.schema.field("hi").type)})


def elect_leaders(edges: DataFrame) -> DataFrame:
    """Greedy leaders over similar pairs: (follower, leader, score).

    ``edges`` is (lo, hi, score) with lo before hi. Taking nodes in order, each node
    not yet taken leads and takes its later neighbours. A few rounds decide many
    nodes at once: a node without an undecided or leading earlier neighbour leads,
    its neighbours follow, and edges of decided nodes leave the table. What is left
    are long chains of dependence. Their components are found in a logarithmic
    number of rounds, and each component of up to ``GROUP_EDGES`` edges is decided in
    order by one task. Rounds go on for components that are larger. Rounds are
    checkpointed, so lineage stays short.
    """
    edges = stable(edges)
    active, followers, rounds = edges.select("lo", "hi"), None, 0

    def add(covered: DataFrame) -> None:
        nonlocal followers
        followers = covered if followers is None else followers.unionAll(covered)

    while not active.isEmpty():
        if rounds == QUICK_ROUNDS:
            roots = components(active)
            placed = stable(active.join(roots.withColumnRenamed("node", "lo"), "lo").select("lo", "hi", "root"))
            sizes = placed.groupBy("root", spread("root")).agg(F.count(F.lit(1)).alias("n")).drop("_spread")
            small = sizes.where(F.col("n") <= GROUP_EDGES)
            kind = active.schema["hi"].dataType.simpleString()
            add(stable(placed.join(small, "root", "left_semi").groupBy("root").applyInArrow(_in_order, f"hi {kind}")))
            active = stable(placed.join(small, "root", "left_anti").select("lo", "hi"))
            if active.isEmpty():
                break
        covered, active = _round(active)
        add(covered)
        rounds += 1
    if followers is None:
        return edges.select(F.col("hi").alias("follower"), F.col("lo").alias("leader"), "score").limit(0)
    led = edges.join(followers, "hi", "left_semi")
    led = led.join(followers.withColumnRenamed("hi", "lo"), "lo", "left_anti")
    first = F.min_by(F.struct("lo", "score"), F.col("lo"))
    return led.groupBy("hi").agg(first.alias("x")).select(F.col("hi").alias("follower"), F.col("x.lo").alias("leader"), F.col("x.score").alias("score"))


def detect_fuzzy(
    df: DataFrame, row_id: str, column: str, threshold: float = 88.0, scorer: str = "weighted_ratio", detector: int = 0,
) -> DataFrame:
    """Groups of near-equal values of one column.

    Distinct normalised values, in order of first row, either lead or follow the
    first leader they resemble; confidence is the mean similarity of the rows.
    """
    keyed = df.select(row_id, tx.norm_exact(tx.text_of(df, column)).alias("key")).filter("key != ''")
    values = stable(
        keyed.groupBy("key").agg(F.min(row_id).alias("first"), F.count(F.lit(1)).alias("n"))
    )
    similar = value_pairs(values.select(_key(F.col("key")).alias("k"), F.col("key").alias("v"), "n"), None, scorer, threshold)
    rank = values.select(F.col("key").alias("v"), "first")
    edges = (
        similar.select("vl", "vr", "score")
        .join(rank.withColumnsRenamed({"v": "vl", "first": "fl"}), "vl")
        .join(rank.withColumnsRenamed({"v": "vr", "first": "fr"}), "vr")
        .select(F.least("fl", "fr").alias("lo"), F.greatest("fl", "fr").alias("hi"), "score")
    )
    led = elect_leaders(edges)
    placed = values.join(led, values["first"] == led["follower"], "left").select(
        "key", "first", "n", F.coalesce("leader", "first").alias("lead"), F.coalesce("score", F.lit(100.0)).alias("similarity")
    )
    groups = placed.groupBy("lead", spread("lead")).agg(
        F.sum("n").alias("group_size"), F.min("first").alias("group_first"),
        (F.sum(F.col("similarity") * F.col("n")) / F.sum("n")).alias("confidence"),
        F.min_by("key", "first").alias("group_key"),
    ).filter("group_size > 1").drop("_spread")
    members = placed.join(groups, "lead").select("key", "group_key", "group_first", "similarity", "confidence", "group_size")
    reason = f"'{column}' similarity ≥ {threshold:.0f}%"
    return keyed.join(members, "key").select(
        F.col("group_key").alias("key"), F.lit(detector).alias("detector"), "group_first", row_id, "similarity", "confidence",
        F.lit(f"fuzzy:{scorer}").alias("method"), F.lit(reason).alias("reason"), "group_size",
    )


def semantic_columns(columns: list[str]) -> dict[str, list[str]]:
    """Kind -> columns whose header contains one of the hint words."""
    found: dict[str, list[str]] = {}
    for kind, hints in COLUMN_HINTS.items():
        hits = [c for c in columns if any(h in c.lower().replace(" ", "_") for h in hints)]
        if hits:
            found[kind] = hits
    return found


def resolve_overlaps(groups: DataFrame, row_id: str) -> DataFrame:
    """Keep a group only if none of its rows is in any earlier group.

    The window over a row holds at most one entry per detector.
    """
    order = F.struct("detector", "group_first")
    marked = groups.withColumn("_own", order == F.min(order).over(W.partitionBy(row_id)))
    kept = marked.groupBy("detector", "group_first", spread("detector", "group_first")).agg(F.bool_and("_own").alias("_keep")).filter("_keep")
    return groups.join(kept.select("detector", "group_first"), ["detector", "group_first"]).select(*groups.columns)


def detect_smart(df: DataFrame, row_id: str, threshold: float = 88.0, scorer: str = "weighted_ratio") -> DataFrame:
    """All detectors chosen by column names, then whole rows, overlaps resolved."""
    kinds = semantic_columns([c for c in df.columns if c != row_id])
    parts = []
    for kind in EXACT_KINDS + FUZZY_KINDS:
        for column in kinds.get(kind, []):
            if kind in EXACT_KINDS:
                parts.append(detect_by_column(df, row_id, column, len(parts)))
            else:
                parts.append(detect_fuzzy(df, row_id, column, threshold, scorer, len(parts)))
    parts.append(detect_exact(df, row_id, detector=len(parts)))
    return resolve_overlaps(stable(reduce(DataFrame.unionByName, parts)), row_id)


def number_groups(groups: DataFrame, start: int = 0) -> DataFrame:
    """Add consecutive ``group_id`` in (detector, first row) order."""
    heads = groups.groupBy("detector", "group_first").agg(F.first("group_size").alias("_n")).drop("_n")
    numbered = with_position(heads, ["detector", "group_first"], "group_id", start)
    return groups.join(numbered, ["detector", "group_first"])


def duplicate_report(df: DataFrame, groups: DataFrame, row_id: str) -> DataFrame:
    """Rows of the duplicate groups with ``_group_id``, ``_group_size``, ``_confidence``, ``_method``, ``_reason``, ``_row_index``."""
    marks = number_groups(groups).select(
        F.col("group_id").alias("_group_id"), F.col("group_size").alias("_group_size"),
        F.round("confidence", 2).alias("_confidence"), F.col("method").alias("_method"), F.col("reason").alias("_reason"),
        F.col(row_id).alias("_row_index"),
    )
    shown = [c for c in df.columns if c != row_id and not c.startswith("_")]
    rows = df.select(F.col(row_id).alias("_row_index"), *[F.col(tx.quoted(c)) for c in shown])
    return rows.join(marks, "_row_index").select(*shown, "_group_id", "_group_size", "_confidence", "_method", "_reason", "_row_index")


def report_top(groups: DataFrame, row_id: str, max_groups: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Numbered groups with ranked rows; all of them, or the first ``max_groups`` and up to ``max_rows`` rows of each.

    Spark applies a rank limit before the shuffle. Without one, ranks come from
    row positions, so that a group of any size is never in one task.
    """
    numbered = number_groups(groups)
    if max_groups is not None:
        numbered = numbered.filter(F.col("group_id") < max_groups)
    if max_rows is None:
        ranked = _ranked(numbered, ["group_id"], [F.desc("similarity"), F.col(row_id)])
        return ranked.select("group_id", "group_size", F.round("confidence", 2).alias("confidence"), "method", "reason", "rank", row_id)
    order = W.partitionBy("group_id").orderBy(F.desc("similarity"), row_id)
    top = numbered.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_rows)
    return top.select("group_id", "group_size", F.round("confidence", 2).alias("confidence"), "method", "reason", "rank", row_id)


def group_totals(groups: DataFrame) -> DataFrame:
    """Number of groups and flagged rows over all groups, as one row."""
    sizes = groups.groupBy("detector", "group_first").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("total_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows_flagged"))


def _ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds ``rank`` from 1 inside each group: the row's position less that of the group's first row."""
    placed = with_position(rows, [*keys, *order], "_at")
    first = placed.groupBy(*keys, spread(*keys)).agg(F.min("_at").alias("_first")).drop("_spread")
    return placed.join(first, keys).withColumn("rank", (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_first")


def sample_rows(groups: DataFrame, row_id: str, n: int | None = None) -> DataFrame:
    """Ranked rows of each group with the group's size; all of them, or up to ``n``."""
    if n is None:
        return _ranked(groups, ["detector", "group_first"], [F.col(row_id)])
    order = W.partitionBy("detector", "group_first").orderBy(row_id)
    return groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
