"""Shared by the vector searches: usable rows, blocks of candidates and queries, and the merge of block results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score {}"


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """One row per id, with the smallest of its usable vectors as array<double>.

    A vector is usable if it and its components are neither null nor non-finite,
    if it is not empty, and if its length is the most common one (the smaller of
    equally common lengths). ``zero``: whether zero vectors are usable.
    """
    v = F.col("v")
    fine = F.size(v) > 0
    fine &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not zero:
        fine &= F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return rows.where(F.size("v") == (lengths.d if lengths else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def block_counts(rows: int, queries: int) -> tuple[int, int]:
    """Blocks of candidates and of queries. A block holds 4,096 to 262,144 candidates, or 1,024 to 16,384 queries,
    so that a task's memory is bounded and copies of a block are few."""
    per_block = min(max(4096, rows // 64), 1 << 18)
    per_query_block = min(max(1024, queries // 16), 1 << 14)
    return max(1, -(-rows // per_block)), max(1, -(-queries // per_query_block))


def deal(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Each row in the block of its key, and that block once for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what the blocks found for each query; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).astype(dtype).reshape(len(flat), -1)


def column_of(raw: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """Rows of a binary column, each ``width`` numbers, as a matrix."""
    return np.frombuffer(b"".join(raw.to_pylist()), dtype=dtype).reshape(len(raw), width)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores; ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
