"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordering import spread


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges ``lo``, ``hi`` with the smallest node it is connected to.

    In a round every node hands its larger neighbours to the smallest node it sees,
    then the smaller ones; paths get half as long, so rounds are logarithmic in the
    longest one. Only minima are aggregated and joined back; no list of neighbours
    is built. Each round is written out.
    """
    pairs = written(edges.select(F.greatest("lo", "hi").alias("a"), F.least("lo", "hi").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a", spread("a")).agg(F.least("a", F.min("b")).alias("m")).drop("_spread")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a", spread("a")).agg(F.min("b").alias("m")).drop("_spread")
        handed = large.join(smallest, "a")
        pairs = written(handed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(handed.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
