"""Similarity joins between the distinct values of two columns.

No pair of values is scored unless it can reach the threshold. Candidates come
from equi-joins on the rarest grams of a value (prefix filtering), and the number
of grams taken follows from the edits that the threshold allows, so no qualifying
pair is lost. Copies of a value are collapsed before anything is joined; results
carry the number of rows on each side.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import ngrams, quoted, soundex_code, tokens
from ..session import stable, written
from .ordering import spread

# How far the parts of the combined score are scaled down.
TOKEN = scoring.TOKEN_SCALE
PART = scoring.PARTIAL_SCALE


def _key(c: Column) -> Column:
    """128-bit stand-in for a value, so that candidate pairs stay narrow."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(k, v, n): every non-null value once, with its row count."""
    v = F.col(quoted(column)).cast("string")
    values = df.select(v.alias("v")).filter(F.col("v").isNotNull())
    return values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(_key(F.col("v")).alias("k"), "v", "n")


# ---------------------------------------------------------------- signatures


def _bits(grams: Column, seed: str) -> Column:
    """64-bit map of a gram set. A bit set on one side only means a gram on one side only."""
    one = F.lit(1).cast("long")
    place = lambda g: F.pmod(F.xxhash64(F.lit(seed), g), F.lit(64)).cast("int")
    return F.aggregate(grams, F.lit(0).cast("long"), lambda acc, g: acc.bitwiseOR(F.call_function("shiftleft", one, place(g))))


def _signature(values: DataFrame) -> DataFrame:
    """Words, within-word letter pairs, letters, lengths and bit maps of each value."""
    words = scoring.split_words(F.col("v"))
    pairs = F.flatten(F.transform(
        F.col("words"),
        lambda w: F.when(
            F.length(w) > 1,
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2))),
        ).otherwise(F.array().cast("array<string>")),
    ))
    letters = F.array_distinct(F.filter(F.split(F.regexp_replace("v", r"(?U)\s", " "), ""), lambda ch: ch != ""))

    def joined(ws: Column) -> Column:
        return F.aggregate(ws, F.lit(0), lambda acc, w: acc + F.length(w) + 1) - F.when(F.size(ws) > 0, 1).otherwise(0)

    sets = (
        values.select("k", "v", "n", F.length("v").alias("m"), letters.alias("letters"), words.alias("words"))
        .withColumn("uwords", F.array_distinct("words"))
        .withColumn("pairs", F.array_distinct(pairs))
    )
    return sets.select(
        "k", "v", "n", "m", joined(F.col("words")).alias("ms"), joined(F.col("uwords")).alias("mt"), F.col("uwords").alias("words"),
        "pairs", "letters", _bits(F.col("letters"), "letter").alias("lb"), _bits(F.col("pairs"), "pair one").alias("pa"),
        _bits(F.col("pairs"), "pair two").alias("pb"),
    )


def _edits(size: Column, tau: float) -> tuple[Column, Column]:
    """Most letter pairs, and most letters, of a string that a match at ``tau`` may lack.

    With D unmatched letters here and I there, D = m - L and I = n - L where the
    threshold asks L >= tau (m + n) / 200. A deletion breaks two letter pairs and
    an insertion one, so 2D + I pairs can be lost; it is linear in n and largest
    at one end of the lengths that the threshold allows.
    """
    part = tau / 200.0
    low, high = tau / (200.0 - tau), (200.0 - tau) / tau
    n = low if 1 - 3 * part < 0 else high
    eps = 1e-6
    pairs = F.floor(size * ((2 - 3 * part) + n * (1 - 3 * part)) + eps)
    # One more letter: a space at the edge of a value is not in its word form.
    letters = F.floor(size * (1 - part * (1 + low)) + eps) + 1
    return pairs, letters


def _ranked(sig: DataFrame, grams: str, frequency: DataFrame, keep: list[str]) -> DataFrame:
    """One row per gram of a value with its place ``r`` in rarest-first order.

    The window holds the grams of one value only.
    """
    rows = sig.select("k", *keep, F.explode(grams).alias("g"))
    order = W.partitionBy("k").orderBy("f", "g")
    return rows.join(frequency, "g").withColumn("r", F.row_number().over(order))


def _frequency(left: DataFrame, right: DataFrame, grams: str) -> DataFrame:
    both = left.select(F.explode(grams).alias("g")).unionAll(right.select(F.explode(grams).alias("g")))
    return both.groupBy("g", spread("g")).agg(F.count(F.lit(1)).alias("f")).drop("_spread")


def _lost(bits: str) -> tuple[Column, Column]:
    """Grams that only the left, and only the right, value has; at least the bits that differ."""
    l, r = F.col(f"l.{bits}"), F.col(f"r.{bits}")
    both = l.bitwiseAND(r)
    return F.bit_count(l) - F.bit_count(both), F.bit_count(r) - F.bit_count(both)


def _full_fit(tau: float, column: str) -> Column:
    """Lengths and bit maps allow a ratio of ``tau``: exact bounds, so no match is refused."""
    a, b = F.col(f"l.{column}"), F.col(f"r.{column}")
    least = F.ceil((a + b) * (tau / 200.0) - 1e-6)
    d, i = a - least, b - least
    (xl, xr), (al, ar), (bl, br) = _lost("lb"), _lost("pa"), _lost("pb")
    return (
        (d >= 0) & (i >= 0) & (xl <= d + 1) & (xr <= i + 1)
        & (F.greatest(al, bl) <= 2 * d + i) & (F.greatest(ar, br) <= 2 * i + d)
    )


def _meet(left: DataFrame, right: DataFrame, fits: Column) -> DataFrame:
    """Pairs that share a gram and fit.

    A frequent gram is dealt over several tasks: each left row is in one part of it, each right row in all.
    """
    on = F.col("l.g") == F.col("r.g")
    if "f" in left.columns and "f" in right.columns:
        parts = F.least(F.floor(F.col("f") / PART_ROWS) + 1, F.lit(MOST_PARTS)).cast("int")
        left = left.withColumn("c", F.pmod(F.xxhash64("k"), parts).cast("int"))
        right = right.withColumn("c", F.explode(F.sequence(F.lit(0), parts - 1)))
        on = on & (F.col("l.c") == F.col("r.c"))
        # By number: the rows are few bytes, but their pairs are the work, so partitions must not be merged by size.
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, "g", "c"), right.repartition(n, "g", "c")
    joined = left.alias("l").join(right.alias("r"), on & fits)
    texts = [F.col("l.t").alias("tl"), F.col("r.t").alias("tr")] if "t" in left.columns else []
    return joined.select(F.col("l.k").alias("kl"), F.col("r.k").alias("kr"), *texts)


def _new() -> Column:
    """Keeps a pair only at its first shared gram, as far as grams have a bit of their own.

    Other repeats are left to the final distinct.
    """
    return F.col("l.earlier").bitwiseAND(F.col("r.own")) == 0


def _swap(pairs: DataFrame) -> DataFrame:
    other = {"kl": "kr", "kr": "kl", "tl": "tr", "tr": "tl"}
    return pairs.select(*[F.col(other[c]).alias(c) for c in pairs.columns])


FACTS = ["m", "ms", "mt", "lb", "pa", "pb"]
#: Rows of a gram that one part of it is meant for, and most parts of a gram.
PART_ROWS, MOST_PARTS = 512, 64
#: Scorers that are a ratio of one form of the values; the form travels with the grams and is compared where they meet.
EARLY = ("ratio", "quick_ratio", "token_sort")


def _facts(sig: DataFrame) -> list[str]:
    return FACTS + [c for c in ("t",) if c in sig.columns]


def _rules(scorer: str, threshold: float) -> dict:
    """What a qualifying pair must satisfy, as alternatives.

    ``full``/``partial`` map a length column to the ratio needed over that form;
    ``contain`` is the share needed from common words; ``word`` means any common
    word is enough.
    """
    t = threshold
    if scorer in ("ratio", "quick_ratio"):
        return {"full": {"m": t}}
    if scorer == "token_sort":
        return {"full": {"ms": t}}
    if scorer == "token_set":
        return {"full": {"mt": t}, "contain": t}
    if scorer == "partial":
        return {"partial": {"m": t}}
    if scorer == "weighted_ratio":
        rules = {"full": {"m": t}, "partial": {}}
        if t / TOKEN <= 100:
            rules["full"] |= {"ms": t / TOKEN, "mt": t / TOKEN}
            rules["contain"] = t / TOKEN
        if t / PART <= 100:
            rules["partial"]["m"] = t / PART
        if t / (TOKEN * PART) <= 100:
            rules["partial"] |= {"ms": t / (TOKEN * PART), "mt": t / (TOKEN * PART)}
            rules["word"] = True
        return rules
    raise ValueError(f"unknown scorer {scorer!r}, use one of {scoring.SCORERS}")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


class _Grams:
    """One kind of gram over both sides: frequencies, prefixes and whole sets."""

    def __init__(self, left: DataFrame, right: DataFrame, kind: str):
        self.kind = kind
        self.frequency = _frequency(left, right, kind)
        # The 63 commonest grams cause most repeats; each gets a bit of its own.
        common = [row["g"] for row in self.frequency.orderBy(F.desc("f"), "g").limit(63).collect()]
        self.common = F.array(*[F.lit(g) for g in common]) if common else F.array(F.lit(""))

    def bit(self, g: Column) -> Column:
        place = F.array_position(self.common, g)
        return F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))).otherwise(F.lit(0).cast("long"))

    def every(self, sig: DataFrame) -> DataFrame:
        own = F.aggregate(self.kind, F.lit(0).cast("long"), lambda acc, g: acc.bitwiseOR(self.bit(g)))
        return sig.select("k", *_facts(sig), own.alias("own"), F.explode(self.kind).alias("g")).join(self.frequency, "g")

    def prefix(self, sig: DataFrame, enough: Column) -> DataFrame:
        """Leading grams of each value, rarest first, with the bits of those before."""
        ranked = _ranked(sig.withColumn("size", F.size(self.kind)), self.kind, self.frequency, _facts(sig) + ["dp", "dl", "size"])
        w = W.partitionBy("k").orderBy("r")
        earlier = F.bit_or(self.bit(F.col("g"))).over(w.rowsBetween(W.unboundedPreceding, -1))
        rows = ranked.filter(enough).withColumn("earlier", F.coalesce(earlier, F.lit(0).cast("long")))
        own = F.bit_or(self.bit(F.col("g"))).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return rows.withColumn("own", own)


def _limits(sig: DataFrame, needs: dict[str, float]) -> DataFrame:
    """Grams each value may lack; a value with more letter pairs than that is strong."""
    allowed = [_edits(F.col(c), tau) for c, tau in needs.items()]
    pairs, letters = [F.greatest(*x) if len(x) > 1 else x[0] for x in zip(*allowed)]
    return sig.withColumn("dp", pairs).withColumn("dl", letters).withColumn("strong", F.size("pairs") > F.col("dp"))


def _candidates(left: DataFrame, right: DataFrame, scorer: str, threshold: float, own: bool) -> DataFrame:
    """(kl, kr) pairs among which every qualifying pair is found, in either order when ``own``."""
    rules = _rules(scorer, threshold)
    out = []
    turns = [(left, right, False)] if own else [(left, right, False), (right, left, True)]
    pairs, letters = _Grams(left, right, "pairs"), _Grams(left, right, "letters")
    enough_pairs = F.col("r") <= F.col("dp") + 1
    # A weak value takes enough of its rarest letters, or all when none can be spared.
    enough_letters = (F.col("size") <= F.col("dl")) | (F.col("r") <= F.col("dl") + 1)

    def weak(sig: DataFrame) -> DataFrame:
        return letters.prefix(sig.filter(~F.col("strong")), enough_letters)

    def strong(sig: DataFrame) -> DataFrame:
        return pairs.prefix(sig.filter("strong"), enough_pairs)

    def full(a: DataFrame, b: DataFrame, column: str, tau: float) -> None:
        fits = _new() & _full_fit(tau, column)
        l, r = _limits(a, {column: tau}), _limits(b, {column: tau})
        out.append(_meet(strong(l), strong(r), fits))
        out.append(_meet(weak(l), letters.every(r), fits))
        if not own or a is not b:
            out.append(_swap(_meet(weak(r), letters.every(l), fits)))

    needs = rules.get("full", {})
    for column, tau in needs.items():
        if "m" not in needs or column == "m":
            full(left, right, column, tau)
            continue
        # Where a word form is as long as the value on both sides, the rule on "m"
        # is the weaker one and has found the pair.
        differs = F.col(column) != F.col("m")
        full(left.filter(differs), right, column, tau)
        if not own:
            full(left, right.filter(differs), column, tau)
    if rules.get("partial"):
        needs = rules["partial"]
        for a, b, turn in turns:
            # The grams of the shorter string must be found in the longer one.
            shorter = _any([F.col(f"l.{c}") <= F.col(f"r.{c}") for c in needs])
            if scorer == "weighted_ratio":
                # Raw lengths choose this branch; a word form may be the shorter one on either side.
                shorter = shorter & (F.greatest("l.m", "r.m") >= F.least("l.m", "r.m") * scoring.PARTIAL_FROM)
            lost = (_lost("lb")[0] <= F.col("l.dl")) & (F.greatest(_lost("pa")[0], _lost("pb")[0]) <= F.col("l.dp"))
            s = _limits(a, needs)
            fits = _new() & shorter & lost
            found = _meet(strong(s), pairs.every(b), fits).unionAll(_meet(weak(s), letters.every(b), fits))
            out.append(_swap(found) if turn else found)
    if "contain" in rules or "word" in rules:
        words = _frequency(left, right, "words")
        slack = 2 * (1 - rules.get("contain", 100.0) / 100.0)
        longest, shortest = F.greatest("l.m", "r.m"), F.least("l.m", "r.m")
        near = longest < shortest * scoring.PARTIAL_FROM if scorer == "weighted_ratio" else F.lit(True)

        def every_word(sig: DataFrame) -> DataFrame:
            return sig.select("k", "m", F.explode("words").alias("g"))

        for a, b, turn in turns:
            if "contain" in rules:
                rows = a.select("k", "m", "mt", F.explode("words").alias("g")).join(words, "g")
                w = W.partitionBy("k").orderBy("f", "g").rowsBetween(W.unboundedPreceding, -1)
                before = F.coalesce(F.sum(F.length("g") + 1).over(w), F.lit(0))
                prefix = rows.withColumn("before", before).filter(F.col("before") <= F.col("mt") * slack + 1e-6)
                found = _meet(prefix, every_word(b), near)
                out.append(_swap(found) if turn else found)
        if "word" in rules:
            out.append(_meet(every_word(left), every_word(right), longest >= shortest * scoring.PARTIAL_FROM))
    if scorer in ("ratio", "token_sort", "partial"):
        # Empty forms match each other and nothing else.
        size = {"ratio": "m", "token_sort": "ms", "partial": "m"}[scorer]
        texts = [F.lit("").alias("t")] if scorer in EARLY else []
        blank = [s.filter(F.col(size) == 0).select("k", F.lit("").alias("g"), *texts) for s in (left, right)]
        out.append(_meet(blank[0], blank[1], F.lit(True)))
    return reduce(DataFrame.unionAll, out)


def _check(threshold: float) -> None:
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be in (0, 100]")


def value_pairs(left: DataFrame, right: DataFrame | None, scorer: str, threshold: float) -> DataFrame:
    """Pairs (kl, vl, nl, kr, vr, nr, score) of ``distinct_values`` tables at or above the threshold.

    With ``right=None`` the values of ``left`` are paired with each other, each
    unordered pair once and without a value paired with itself.
    """
    _check(threshold)
    own = right is None
    early = scorer in EARLY
    text = F.array_join(F.array_sort(scoring.split_words(F.col("v"))), " ") if scorer == "token_sort" else F.col("v")

    def signed(values: DataFrame) -> DataFrame:
        # The signed values are read several times, so they are written once.
        return stable(_signature(values).withColumn("t", text) if early else _signature(values))

    left = signed(left)
    right = left if own else signed(right)
    pairs = _candidates(left, right, scorer, threshold, own)
    if own:
        pairs = pairs.filter("kl != kr")
        pairs = pairs.select(F.least("kl", "kr").alias("kl"), F.greatest("kl", "kr").alias("kr"), "tl", "tr") if early else pairs.select(F.least("kl", "kr").alias("kl"), F.greatest("kl", "kr").alias("kr"))
    if early:
        # Pairs are scored where they meet; only those that reach the threshold go on.
        score = (scoring.quick_ratio if scorer == "quick_ratio" else scoring.ratio)(F.col("tl"), F.col("tr"))
        pairs = pairs.withColumn("score", score).filter(F.col("score") >= threshold).select("kl", "kr", "score")
        pairs = pairs.dropDuplicates(["kl", "kr"])
    else:
        pairs = pairs.distinct()
    forms = [] if early else scoring.forms(F.col("v"))
    sides = [
        sig.select(F.col("k").alias(f"k{s}"), F.col("v").alias(f"v{s}"), F.col("n").alias(f"n{s}"), *[c.alias(f"{name}_{s}") for name, c in zip(scoring.FORMS, forms)])
        for sig, s in ((left, "l"), (right, "r"))
    ]
    both = pairs.join(sides[0], "kl").join(sides[1], "kr")
    if not early:
        score = scoring.score(scorer, threshold, *[F.col(c) for c in ("vl", "vr", "sorted_l", "sorted_r", "unique_l", "unique_r")])
        both = both.withColumn("score", score).filter(F.col("score") >= threshold)
    return both.select("kl", "kr", "vl", "nl", "vr", "nr", "score")


def similarity_join(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str,
    scorer: str = "weighted_ratio", threshold: float = 80.0,
) -> DataFrame:
    """All pairs of distinct values scoring at least ``threshold``.

    Columns: left_value, right_value, left_rows, right_rows, score. Nulls score 0
    and never appear.
    """
    found = value_pairs(distinct_values(left, left_col), distinct_values(right, right_col), scorer, threshold)
    return _named(found)


def _named(found: DataFrame, *extra: str) -> DataFrame:
    return found.select(
        F.col("vl").alias("left_value"), F.col("vr").alias("right_value"),
        F.col("nl").alias("left_rows"), F.col("nr").alias("right_rows"), "score", *extra,
    )


def top_matches(
    needles: DataFrame, haystack: DataFrame, needle_col: str, hay_col: str,
    k: int = 5, scorer: str = "weighted_ratio", threshold: float = 60.0,
) -> DataFrame:
    """The ``k`` best haystack values per needle value; ties go to the smaller value.

    Spark applies the rank limit on the map side before the window's shuffle.
    """
    found = similarity_join(needles, haystack, needle_col, hay_col, scorer, threshold)
    order = W.partitionBy("left_value").orderBy(F.desc("score"), "right_value")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_match(
    needles: DataFrame, haystack: DataFrame, needle_col: str, hay_col: str,
    scorer: str = "weighted_ratio", threshold: float = 80.0,
) -> DataFrame:
    return top_matches(needles, haystack, needle_col, hay_col, 1, scorer, threshold).drop("rank")


def phonetic_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Values that sound like a value of the other table: (side, value, code, partners).

    Every left value equals every right value of its code, so the pairs are the two
    lists of a code. They are returned as such, with the number of partners, because
    writing a frequent code out in pairs would square its size.
    """
    sides = [
        distinct_values(df, c).select(F.lit(side).alias("side"), F.col("v").alias("value"), soundex_code(F.col("v")).alias("code"))
        for df, c, side in ((left, left_col, "left"), (right, right_col, "right"))
    ]
    both = sides[0].unionAll(sides[1])
    sizes = both.groupBy("code", spread("code")).agg(
        F.count_if(F.col("side") == "left").alias("lefts"), F.count_if(F.col("side") == "right").alias("rights")
    ).filter("lefts > 0 and rights > 0").drop("_spread")
    partners = F.when(F.col("side") == "left", F.col("rights")).otherwise(F.col("lefts"))
    return both.join(sizes, "code").select("side", "value", "code", partners.alias("partners"))


# ---------------------------------------------------------------- set overlap


#: Most grams of which every task knows the frequency.
KNOWN = 1 << 17
#: Leading grams that one cell of the set join is meant for.
CELL_GRAMS = 1 << 21


class _Overlap:
    """What two sets need in common: ``share`` of their union, as bounds on sizes, places and differences."""

    def __init__(self, threshold: float):
        self.share = threshold / 100.0
        self.width = -np.log(self.share) + 1e-6

    def size_class(self, size: np.ndarray) -> np.ndarray:
        """Sets that match are in one class of sizes or in neighbouring ones."""
        return np.floor(np.log(np.maximum(size, 1)) / self.width).astype(np.int64)

    def need(self, sizes: np.ndarray) -> np.ndarray:
        """Least number of common grams, by the sum of both sizes."""
        return np.ceil(sizes * (self.share / (1 + self.share)) - 1e-9)

    def leading(self, size: np.ndarray) -> np.ndarray:
        """So many of its rarest grams hold one that a set shares with any match that is not larger."""
        return (size - np.ceil(size * self.share - 1e-9) + 1).astype(np.int64)

    def first(self, size: np.ndarray) -> np.ndarray:
        """As ``leading``, with any match that is not smaller."""
        return (size - self.need(2 * size) + 1).astype(np.int64)

    def words(self, size_class: np.ndarray) -> np.ndarray:
        """64-bit words of a sketch: about two to four bits for each gram of the largest sets of a class."""
        upper = np.exp(np.minimum((size_class + 1) * self.width, 15.0))
        return (2 ** np.clip(np.ceil(np.log2(upper * 2 / 64)), 2, 10)).astype(np.int64)


def _sketch(row: np.ndarray, grams: np.ndarray, words: np.ndarray) -> pa.Array:
    """For each set a bit map of ``words`` words in which every gram turns one bit.

    Bits in which two maps differ are grams that only one set has, so there are at most as many of them.
    """
    start = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(start[-1], np.uint64)
    spot = (grams.view(np.uint64) % (64 * words[row]).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, start[row] + spot // 64, np.uint64(1) << (spot % 64).astype(np.uint64))
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((8 * start).astype(np.int32)), pa.py_buffer(out)])


_PACKED = "k struct<a:bigint,b:bigint>, side int, size int, own binary, under binary, g array<int>"


def _packed(sets: DataFrame, known, over: _Overlap, side: int) -> DataFrame:
    """A set's size, its sketches, and the leading grams by which matches are found; copies in a batch are one row.

    Any order of grams will do, if it is the same for all sets: those that are not
    among the ``KNOWN`` most frequent ones stand first, so no set is shuffled. Grams
    that meet by 32 bits only are told apart when the pair is scored.
    """

    def run(batches):
        grams, counts = known.value
        for batch in batches:
            a, b = (c.to_numpy() for c in batch.column("k").flatten())
            order = np.lexsort((b, a))
            batch = batch.take(pa.array(order[np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]])) if len(a) else batch
            sets = batch.column("s")
            lengths, g = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), sets.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(grams, g), max(len(grams) - 1, 0))
            common = grams[at] == g if len(grams) else np.zeros(len(g), bool)
            order = np.lexsort((g, np.where(common, counts[at], 0) if len(grams) else g, row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
            use = np.where(lengths > 0, over.leading(lengths), 0)
            off = np.concatenate([[0], np.cumsum(use)]).astype(np.int32)
            classes = over.size_class(lengths)
            columns = [
                pa.array(np.full(len(lengths), side, np.int32)), pa.array(lengths.astype(np.int32)), _sketch(row, g, over.words(classes)), _sketch(row, g, over.words(classes - 1)),
                pa.ListArray.from_arrays(pa.array(off), pa.array(g[order][place <= use[row]].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], names=["k", "side", "size", "own", "under", "g"])

    return sets.select("k", "s").mapInArrow(run, _PACKED)


def _counted(sets: DataFrame) -> DataFrame:
    """(g, f): in how many rows a gram is; each task counts its batches first."""

    def run(batches):
        for batch in batches:
            g, f = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(f, pa.int64())], names=["g", "f"])

    return sets.select("s").mapInArrow(run, "g long, f long").groupBy("g").agg(F.sum("f").alias("f"))


_CELLS = "class long, part long, a long, b long, side int, size int, sketch binary, g array<int>, place array<int>"


def _cells(packed: DataFrame, over: _Overlap, parts: dict[int, int]) -> DataFrame:
    """Each set under its own size class, and under the next smaller one to look for matches there; grams are dealt over parts."""

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
            lists, keys = batch.column("g"), batch.column("k").flatten()
            lengths, g = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
            for lower, sketch in ((0, "own"), (1, "under")):
                cls = over.size_class(size) - lower
                deal = np.array([parts.get(c, 0) for c in cls.tolist()], np.int64)[row]
                on = np.flatnonzero(deal)
                part = (g[on].view(np.uint32).astype(np.int64) * 0x9E3779B1 >> 20) % deal[on]
                order = np.lexsort((place[on], part, row[on]))
                on, part = on[order], part[order]
                begin = np.flatnonzero(np.r_[True, (np.diff(row[on]) != 0) | (np.diff(part) != 0)]) if len(on) else on
                off, of = pa.array(np.r_[begin, len(on)].astype(np.int32)), row[on[begin]]
                columns = [
                    pa.array(cls[of]), pa.array(part[begin]), keys[0].take(pa.array(of)), keys[1].take(pa.array(of)), batch.column("side").take(pa.array(of)), batch.column("size").take(pa.array(of)),
                    batch.column(sketch).take(pa.array(of)), pa.ListArray.from_arrays(off, pa.array(g[on])), pa.ListArray.from_arrays(off, pa.array(place[on].astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "part", "a", "b", "side", "size", "sketch", "g", "place"])

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By number: the rows are few bytes, but their pairs are the work, so partitions must not be merged by size.
    return packed.mapInArrow(run, _CELLS).repartition(n, "class", "part").sortWithinPartitions("class", "part")


def _same(batches, keys: list[str]):
    """Rows that stand together by ``keys``, as one table."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        cols = [table[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
        if held and len(table) and any(held[-1][k][0].as_py() != c[0] for k, c in zip(keys, cols)):
            yield pa.concat_tables(held)
            held = []
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(table)]):
            if start:
                yield pa.concat_tables(held)
                held = []
            if end > start:
                held.append(table.slice(start, end - start))
    if held:
        yield pa.concat_tables(held)


_AT_ONCE = 1 << 19


def _cell_pairs(cell: pa.Table, over: _Overlap, own: bool) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Sets of a cell, and pairs of them that share a leading gram and that no bound refuses."""
    b, a, side, size = order = [cell[c].to_numpy() for c in ("b", "a", "side", "size")]
    order = np.lexsort(order)
    copy = np.all([np.diff(c[order]) == 0 for c in (a, b, side)], axis=0)
    cell = cell.take(pa.array(order[np.r_[True, ~copy]]))
    size, side, sketch, lists = cell["size"].to_numpy().astype(np.int64), cell["side"].to_numpy(), cell["sketch"].combine_chunks(), cell["g"].combine_chunks()
    n = len(size)
    doc = np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy())
    _, gram = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    place = cell["place"].combine_chunks().flatten().to_numpy()
    at = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset : sketch.offset + n + 1]
    bits = np.ascontiguousarray(np.frombuffer(sketch.buffers()[2], np.uint64, (at[-1] - at[0]) // 8, at[0]).reshape(n, -1).T)
    # The smaller set, or the one that stands first, is found by the larger one through its first grams.
    first = np.flatnonzero((over.size_class(size) == cell["class"][0].as_py())[doc] & (place <= over.first(size)[doc]))
    code = gram[first] * n + doc[first]
    order = np.argsort(code)
    first, code = first[order], code[order]
    least = np.searchsorted(size, np.ceil(size * over.share - 1e-9))
    low, high = np.searchsorted(code, gram * n + least[doc]), np.searchsorted(code, gram * n + doc)
    many = np.maximum(high - low, 0)
    ends, found, start = np.cumsum(many), [], 0
    while start < len(many):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _AT_ONCE, "right")))
        each = many[start:stop]
        larger = np.repeat(np.arange(start, stop), each)
        smaller = first[np.repeat(low[start:stop] - (ends[start:stop] - each - done), each) + np.arange(len(larger))]
        x, y = doc[smaller], doc[larger]
        need = over.need(size[x] + size[y])
        keep = np.minimum(size[x] - place[smaller], size[y] - place[larger]) + 1 >= need
        if not own:
            keep &= side[x] != side[y]
        x, y, most = x[keep], y[keep], (size[x] + size[y] - 2 * need)[keep]
        differ = np.zeros(len(x), np.int64)
        for word in bits:
            differ += np.bitwise_count(word[x] ^ word[y])
            keep = differ <= most
            x, y, most, differ = x[keep], y[keep], most[keep], differ[keep]
        found.append(np.unique(x.astype(np.int64) * n + y))
        start = stop
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return cell, pairs // n, pairs % n


def _set_pairs(cells: DataFrame, over: _Overlap, own: bool) -> DataFrame:
    """(kl, kr): pairs of keys among which all matching sets are, each once, the smaller key on the left when ``own``."""

    def run(batches):
        for cell in _same(batches, ["class", "part"]):
            cell, x, y = _cell_pairs(cell, over, own)
            a, b, side = (cell[c].to_numpy() for c in ("a", "b", "side"))
            turn = (a[x] > a[y]) | ((a[x] == a[y]) & (b[x] > b[y])) if own else side[x] > side[y]
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[x], b[x], a[y], b[y])], names=["al", "bl", "ar", "br"])

    pairs = cells.mapInArrow(run, "al long, bl long, ar long, br long").distinct()
    return pairs.select(F.struct(F.col("al").alias("a"), F.col("bl").alias("b")).alias("kl"), F.struct(F.col("ar").alias("a"), F.col("br").alias("b")).alias("kr"))


def _set_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, to_set, threshold: float) -> DataFrame:
    """Pairs of values whose gram sets have Jaccard similarity of at least ``threshold`` percent.

    With t = threshold / 100, a match of sizes a and b shares at least
    t / (1 + t) (a + b) grams. So it shares one of the ``a - ceil(t a) + 1`` rarest
    grams of the larger set with fewer of the smaller one; at the first such gram the
    grams that remain on both sides must still reach that number; and no more bits of
    the sketches may differ than grams can. Each test is a bound, so no match is
    refused. Empty sets equal each other. Sets meet as leading grams and sketches,
    a row for each part of the grams of a size class; texts travel once to their key
    and once to each pair that the bounds leave.
    """
    _check(threshold)
    over = _Overlap(threshold)
    own = left is right and left_col == right_col
    grams = lambda v: F.array_distinct(F.transform(to_set(v), lambda g: F.xxhash64(g)))

    def keyed(df: DataFrame, column: str) -> DataFrame:
        values = df.select(F.col(quoted(column)).cast("string").alias("v")).filter("v is not null")
        return values.select(_key(F.col("v")).alias("k"), "v")

    rows = [keyed(left, left_col)]
    rows += [] if own else [keyed(right, right_col)]
    sets = [r.select("k", grams(F.col("v")).alias("s")) for r in rows]
    # The order of grams follows from their frequency among all rows; it decides what is compared, not what is found.
    frequency = _counted(reduce(DataFrame.unionAll, sets)).orderBy(F.desc("f"), "g").limit(KNOWN).toPandas().sort_values("g")
    known = left.sparkSession.sparkContext.broadcast((frequency["g"].to_numpy("int64"), frequency["f"].to_numpy("int64")))
    packed = written(reduce(DataFrame.unionAll, [_packed(s, known, over, side) for side, s in enumerate(sets)]))
    counted = packed.filter("size > 0").groupBy(F.floor(F.log("size") / float(over.width)).alias("c")).agg(F.sum(F.size("g")).alias("n")).collect()
    held = {row.c: row.n for row in counted}
    parts = {c: 1 + (n + held.get(c + 1, 0)) // CELL_GRAMS for c, n in held.items()}
    # A logarithm may round apart at the edge of a class, so neighbours of a class that holds sets are there too.
    parts |= {c: 1 for near in list(held) for c in (near - 1, near + 1) if c not in parts}
    pairs = _set_pairs(_cells(packed.filter("size > 0"), over, parts), over, own)
    empty = [packed.filter(f"size = 0 and side = {side}").select("k", F.col("size").alias("g")).distinct() for side in (0, 0 if own else 1)]
    pairs = pairs.unionAll(_meet(empty[0], empty[1], F.col("l.k") < F.col("r.k") if own else F.lit(True)))
    values = [r.groupBy("k").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")) for r in rows]
    l, r = values[0].alias("l"), values[-1].alias("r")
    met = pairs.join(l, F.col("kl") == F.col("l.k")).select("kr", F.col("l.v").alias("vl"), F.col("l.n").alias("nl"))
    met = met.join(r, F.col("kr") == F.col("r.k")).select("vl", F.col("r.v").alias("vr"), "nl", F.col("r.n").alias("nr"))
    met = met.withColumns({"sl": grams(F.col("vl")), "sr": grams(F.col("vr"))})
    both = F.size(F.array_intersect("sl", "sr"))
    either = F.size("sl") + F.size("sr") - both
    score = F.when(either == 0, F.lit(100.0)).otherwise(100.0 * both / F.greatest(either, F.lit(1)))
    # Exploded, so that the texts are not split once more for a filter inside the join.
    found = met.select("vl", "vr", "nl", "nr", F.explode(F.array(score)).alias("score")).filter(F.col("score") >= threshold)
    if own:
        turned = F.explode(F.array(F.struct("vl", "vr", "nl", "nr"), F.struct(F.col("vr").alias("vl"), F.col("vl").alias("vr"), F.col("nr").alias("nl"), F.col("nl").alias("nr"))))
        found = found.select(turned.alias("p"), "score").select("p.*", "score")
        found = found.unionByName(values[0].select(F.col("v").alias("vl"), F.col("v").alias("vr"), F.col("n").alias("nl"), F.col("n").alias("nr"), F.lit(100.0).alias("score")))
    return _named(found)


def jaccard_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float = 50.0) -> DataFrame:
    """Token-set similarity join over ``[a-z0-9]+`` words."""
    return _set_join(left, right, left_col, right_col, tokens, threshold)


def ngram_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, n: int = 3, threshold: float = 50.0) -> DataFrame:
    """Character n-gram similarity join."""
    return _set_join(left, right, left_col, right_col, lambda c: ngrams(c, n), threshold)
