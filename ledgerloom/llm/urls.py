"""URL filters: rules first, else a naive Bayes verdict on words that a unigram model finds in host and path."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LONGEST_WORD = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose hosts serve as examples to block. Replace by one's own list.
BAD_WORDS = ("ads", "adserver", "banner", "bet", "bonus", "casino", "click", "jackpot", "pills", "poker", "porn", "track", "tracker", "viagra", "xxx")


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for a null url or one without ``://``."""
    at = F.instr(url_col, "://")
    rest = F.when(at > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def apply_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits, or nulls. A rule ``host/path`` fits its host
    and all subdomains where the path begins with its own; of equally long ones the first in the alphabet wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def unigrams(texts: DataFrame, text_col: str, hosts: DataFrame) -> DataFrame:
    """Counts of words in the visible text of all pages, and of the names that a hyphen sets apart in ``hosts``."""
    seen = F.regexp_replace(F.col(text_col), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    words = texts.select(F.explode(F.split(F.lower(seen), r"[^\p{L}]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label"), "n").where(F.col("label").contains("-"))
    named = labels.select(F.explode(F.split("label", r"[^\p{L}]+")).alias("word"), "n")
    return words.union(named).where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.sum("n").alias("n"))


def split_name(name: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of a name under a unigram model: Viterbi over the places where words may end.

    ``counts`` holds the count of the word at (start, length). A string that is no
    word is ten times less likely with each letter. Ties go to fewer words, then
    to the longer last word.
    """
    best = [(0.0, 0, 0)] + [(math.inf, 0, 0)] * len(name)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            length = end - start
            n = counts.get((start, length), 0)
            cost = math.log(total + 1) - math.log(n) if n else math.log(total + 1) + length * math.log(10)
            option = (best[start][0] + cost, best[start][1] + 1, start)
            if option < best[end]:
                best[end] = option
    words, end = [], len(name)
    while end:
        start = best[end][2]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segment_hosts(hosts: DataFrame, lexicon: DataFrame, total: int) -> DataFrame:
    """Distinct hosts with their words. Each distinct name is looked at once; its substrings meet the lexicon in a join."""
    named = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("at", "name")).where("name <> ''")
    names = named.select("name").distinct()
    places = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i"))
    spans = places.select("name", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("i") + 1))).alias("length"))
    known = spans.withColumn("word", F.expr("substr(name, i, length)")).join(lexicon, "word")
    inside = known.groupBy("name").agg(F.collect_list(F.struct((F.col("i") - 1).alias("i"), "length", "n")).alias("words"))

    @F.pandas_udf("array<string>")
    def viterbi(name: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([split_name(a, {(w["i"], w["length"]): w["n"] for w in ws} if ws is not None else {}, total) for a, ws in zip(name, words, strict=True)])

    split = names.join(inside, "name", "left").select("name", viterbi("name", "words").alias("parts"))
    ordered = named.join(split, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "parts"))).alias("found"))
    return ordered.select("host", F.flatten(F.col("found.parts")).alias("host_words"))


def judge(
    df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", text_col: str = "html", bad_words: tuple[str, ...] = BAD_WORDS, alpha: float = 1.0,
) -> DataFrame:
    """A verdict on the url of every row: that of the longest rule that fits, else that of multinomial naive Bayes.

    Host names are split into words by a unigram model of the pages' own text. A
    host with a word of ``bad_words`` is an example to block, any other one to
    allow; token counts of both classes are taken over all rows, so words that go
    with bad ones count as well. Urls are grouped by host and path words before
    any of this, so a host with a third of all rows weighs as one row with a count.

    Returns page_id, host, path, rule, verdict (allow or block), score (log odds
    to block), one row per input row. A null url, or one without ``://``, has an
    empty host and path, no tokens, and the verdict of the larger class. No rows
    give no rows; other columns of the input are not looked at.
    """
    pages = apply_rules(parts(df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))), rules).drop("url")
    pages = pages.withColumn("path_words", F.array_remove(F.split(F.lower("path"), r"[^\p{L}]+"), ""))
    kinds = settle(pages.groupBy("host", "path_words").agg(F.count("*").alias("n")), "urls")
    hosts = kinds.groupBy("host").agg(F.sum("n").alias("n"))
    lexicon = settle(unigrams(df, text_col, hosts), "unigrams")
    total = lexicon.agg(F.sum("n")).head()[0] or 0
    words = segment_hosts(hosts, lexicon, total)
    bad = F.arrays_overlap("host_words", F.array(*[F.lit(w) for w in bad_words]))
    tokens = F.concat(F.coalesce("host_words", F.array().cast("array<string>")), "path_words")
    labelled = settle(kinds.join(words, "host", "left").select("host", "path_words", "n", F.coalesce(bad, F.lit(False)).alias("bad"), tokens.alias("tokens")), "tokens")
    counts = labelled.select("n", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("in_bad"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("in_good"),
    )
    size = counts.agg(F.count("*"), F.sum("in_bad"), F.sum("in_good")).head()
    rows = labelled.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0))).head()
    prior = math.log((rows[0] or 0) + alpha) - math.log((rows[1] or 0) + alpha)
    odds = F.log((F.col("in_bad") + alpha) / ((size[1] or 0) + alpha * (size[0] + 1))) - F.log((F.col("in_good") + alpha) / ((size[2] or 0) + alpha * (size[0] + 1)))
    weights = counts.select("token", odds.alias("odds"))
    summed = labelled.select("host", "path_words", F.explode("tokens").alias("token")).join(weights, "token").groupBy("host", "path_words").agg(F.sum("odds").alias("odds"))
    judged = pages.join(summed, ["host", "path_words"], "left").withColumn("score", F.coalesce("odds", F.lit(0.0)) + F.lit(prior))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
