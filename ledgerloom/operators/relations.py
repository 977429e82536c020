"""Foreign-key discovery over several tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted, text_of
from .profile import unpivot_text

# Header endings, thresholds.
KEY_ENDINGS = ("_id", "id", "_no", "_code", "_key")
FREE_TEXT_UNIQUE = 0.95
FREE_TEXT_LENGTH = 40
CONTAINED = 0.98
RELATION_SCHEMA = ("left string, right string, cardinality string, confidence double, shared long, reason string")


def names_compatible(a: str, b: str) -> bool:
    a, b = a.lower(), b.lower()
    if a == b or a.replace("_", "").replace("-", "") == b.replace("_", "").replace("-", ""):
        return True
    return any(a == b + end or b == a + end for end in KEY_ENDINGS)


def fk_candidates(df: DataFrame) -> list[str]:
    """Columns that may be keys: no floating columns, no near-unique free text.

    One aggregate measures text lengths; distinct counts follow only for long texts.
    """
    usable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    strings = [c for c in usable if isinstance(df.schema[c].dataType, T.StringType)]
    if not strings:
        return usable
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(F.length(quoted(c))).alias(c) for c in strings]).first()
    long = [c for c in strings if (row[c] or 0) > FREE_TEXT_LENGTH]
    if not long:
        return usable
    # Two hashes stand for the text, so that free text is not shuffled.
    texts = unpivot_text(df, long)
    hashed = texts.select("column", F.xxhash64("value").alias("a"), F.xxhash64(F.lit("second"), "value").alias("b"),
                          F.col("value").isNull().alias("empty"))
    unique = hashed.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    free = {r["column"] for r in unique.collect() if r["n"] / max(1, row["_rows"]) > FREE_TEXT_UNIQUE}
    return [c for c in usable if c not in free]


def discover_relationships(datasets: dict[str, DataFrame], min_overlap: float = 0.6, min_shared: int = 5) -> DataFrame:
    """Value overlap between name-compatible columns of different tables.

    An inverted index: every distinct value is marked with the columns that hold it
    (combined on the map side), and column and pair counts are read off those
    marks in one aggregate. No value is joined with another table.
    """
    candidates = {name: fk_candidates(df) for name, df in datasets.items()}
    pairs = [
        (a, ca, b, cb)
        for a, b in combinations(datasets, 2)
        for ca in candidates[a]
        for cb in candidates[b]
        if names_compatible(ca, cb)
    ]
    spark = next(iter(datasets.values())).sparkSession
    schema = ("left_dataset string, left_column string, right_dataset string, right_column string, overlap double, "
              "reverse_overlap double, shared_values long, cardinality string, confidence double, reason string")
    if not pairs:
        return spark.createDataFrame([], schema)
    ids: dict[tuple[str, str], int] = {}
    for a, ca, b, cb in pairs:
        ids.setdefault((a, ca), len(ids))
        ids.setdefault((b, cb), len(ids))
    long = None
    for name, df in datasets.items():
        used = [c for c in candidates[name] if (name, c) in ids]
        if not used:
            continue
        cells = F.array(*[F.struct(F.lit(ids[name, c]).alias("col"), text_of(df, c).alias("value")) for c in used])
        part = df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("value").isNotNull())
        long = part if long is None else long.unionByName(part)
    # Column sets are bit maps, 63 columns to a number: a fixed-width aggregate.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("col"), F.lit(63)))
    words = range((len(ids) + 62) // 63)
    none = F.lit(0).cast("long")
    maps = [F.bit_or(F.when(F.floor(F.col("col") / 63) == w, bit).otherwise(none)).alias(f"w{w}") for w in words]
    holders = long.groupBy("value").agg(*maps)

    def holds(column: int):
        return F.col(f"w{column // 63}").bitwiseAND(F.lit(1 << (column % 63)).cast("long")) != 0

    wanted = [(c, -1) for c in ids.values()] + sorted({(ids[a, ca], ids[b, cb]) for a, ca, b, cb in pairs})
    tests = [F.count_if(holds(x) if y < 0 else holds(x) & holds(y)).alias(f"n{i}") for i, (x, y) in enumerate(wanted)]
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"n{i}").alias("n")) for i, (x, y) in enumerate(wanted)]
    counts = holders.agg(*tests).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    # From here on every table has one row per column or per column pair.
    sizes = counts.filter("b = -1").select(F.col("a").alias("col"), F.col("n").alias("size"))
    names = spark.createDataFrame(
        [(ids[a, ca], ids[b, cb], a, ca, b, cb, ca.lower() == cb.lower()) for a, ca, b, cb in pairs],
        "a int, b int, left_dataset string, left_column string, right_dataset string, right_column string, same boolean",
    )
    found = (
        counts.filter((F.col("b") >= 0) & (F.col("n") >= min_shared))
        .join(F.broadcast(names), ["a", "b"])
        .join(F.broadcast(sizes.withColumnsRenamed({"col": "a", "size": "left_size"})), "a")
        .join(F.broadcast(sizes.withColumnsRenamed({"col": "b", "size": "right_size"})), "b")
        .withColumn("ab", F.col("n") / F.col("left_size"))
        .withColumn("ba", F.col("n") / F.col("right_size"))
        .filter(F.greatest("ab", "ba") >= min_overlap)
    )
    left_in, right_in = F.col("ab") > CONTAINED, F.col("ba") > CONTAINED
    cardinality = F.when(left_in & right_in, "1:1").when(right_in, "N:1").when(left_in, "1:N").otherwise("N:N")
    share = lambda c: F.concat(F.bround(F.col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))
    same = F.concat(F.lit("Same column name; "), share("ab"), F.lit(" / "), share("ba"), F.lit(" value overlap"))
    near = F.concat(F.lit("Compatible names ("), F.col("left_column"), F.lit(" ~ "), F.col("right_column"), F.lit("); overlaps "),
                    share("ab"), F.lit(" / "), share("ba"))
    return found.select(
        "left_dataset", "left_column", "right_dataset", "right_column",
        F.round("ab", 4).alias("overlap"), F.round("ba", 4).alias("reverse_overlap"),
        F.col("n").alias("shared_values"), cardinality.alias("cardinality"),
        F.round(100.0 * (F.col("ab") + F.col("ba")) / 2, 2).alias("confidence"),
        F.when(F.col("same"), same).otherwise(near).alias("reason"),
    ).orderBy(F.desc("confidence"), "left_dataset", "left_column", "right_dataset", "right_column")


def relationship_table(relations: DataFrame) -> DataFrame:
    """Edge list with ``dataset.column`` on both sides; the schema holds for empty input."""
    return relations.select(
        F.concat_ws(".", "left_dataset", "left_column").alias("left"),
        F.concat_ws(".", "right_dataset", "right_column").alias("right"),
        "cardinality", "confidence", F.col("shared_values").alias("shared"), "reason",
    )
