"""Approximate nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import to_arrow
from .vectors import FOUND, best, block_counts, column_of, deal, matrix, nearest, usable

QUERY_BITS = 4
_AT_ONCE = 128


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix whose size is ``d`` rounded up to whole 64-bit words."""
    size = -(-d // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _rotated(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors after the rotation, and their lengths before it. Scaled first, so that squares stay finite."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    unit = x / scale
    norm = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    wide = np.zeros((len(x), len(turn)))
    wide[:, : x.shape[1]] = unit / norm
    return wide @ turn, (norm * scale)[:, 0]


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its sign bits, its length, and the inner product of its unit vector with the bits' own vector."""
    y, norm = _rotated(x, turn)
    return np.packbits(y > 0, axis=1, bitorder="little").view("<u8"), norm, np.abs(y).sum(axis=1) / np.sqrt(len(turn))


def estimates(q: np.ndarray, code: np.ndarray, norm: np.ndarray, corr: np.ndarray, turn: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of each query with each code, and how far above them the true ones may lie.

    The rotated query is rounded to four bits a component; its bit planes meet
    the codes in ANDs and bit counts. Dividing by the stored correction makes
    the estimate unbiased; its error shrinks with the root of the dimension.
    """
    y, q_norm = _rotated(q, turn)
    d = len(turn)
    low = y.min(axis=1, keepdims=True)
    step = np.maximum(y.max(axis=1, keepdims=True) - low, 1e-300) / (2**QUERY_BITS - 1)
    level = np.rint((y - low) / step).astype(np.uint8)
    inside = np.zeros((len(q), len(code)), np.int64)
    for bit in range(QUERY_BITS):
        plane = np.packbits((level >> bit) & 1, axis=1, bitorder="little").view("<u8")
        for word in range(code.shape[1]):
            inside += np.bitwise_count(plane[:, word, None] & code[None, :, word]).astype(np.int64) << bit
    ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
    estimate = (2 * (low * ones + step * inside) - y.sum(axis=1, keepdims=True)) / np.sqrt(d) / corr
    error = eps * np.sqrt(np.maximum(1 - corr**2, 0)) / corr / np.sqrt(max(d - 1, 1)) + 3 * step / np.sqrt(12) / corr
    scale = q_norm[:, None] * norm
    return estimate * scale, error * scale


def _search(ids, x, code, norm, corr, q_ids, q, k: int, turn: np.ndarray, eps: float) -> tuple[list, list, list]:
    out: tuple[list, list, list] = ([], [], [])
    for i in range(0, len(q), _AT_ONCE):
        estimate, error = estimates(q[i : i + _AT_ONCE], code, norm, corr, turn, eps)
        for row, (own, vector) in enumerate(zip(q_ids[i : i + _AT_ONCE], q[i : i + _AT_ONCE], strict=True)):
            guess = estimate[row]
            other = ids != own
            first = np.argpartition(-guess, min(4 * k, len(guess) - 1))[: 4 * k + 1]
            first = first[other[first]]
            exact = np.sort((x[first] * vector).sum(axis=1))
            least = exact[-k] if len(exact) >= k else -np.inf
            chosen = np.flatnonzero((guess + error[row] >= least) & other)
            chosen = np.union1d(chosen, first)
            scores = (x[chosen] * vector).sum(axis=1)
            top = best(scores, ids[chosen], k)
            for column, values in zip(out, (np.full(len(top), own), ids[chosen][top], scores[top]), strict=True):
                column.append(values)
    return out


def search(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", eps: float = 2.5, seed: int = 1) -> DataFrame:
    """The ``k`` rows of ``df`` with about the largest inner products with each row of ``queries``.

    Every vector is rotated and coded once: a bit per dimension, its length and a
    correction. Blocks of queries meet blocks of codes, each pair of blocks in a
    task of bounded size. There, ``eps`` standard errors above the estimate must
    reach the k-th best exact product of the first few, else a vector is not
    reranked; all that do are, in double precision on the original vectors.

    Rows with an unusable or zero vector take no part (see ``vectors.usable``); a
    query is never its own neighbour; fewer candidates than ``k`` are all
    returned; ties go to the smaller id; no rows give no rows.

    Returns query_id, rank (from 1), vec_id, score.
    """
    rows, asked = usable(df, id_col, vector_col, zero=False), usable(queries, id_col, vector_col, zero=False)
    candidates, query_blocks = block_counts(df.count(), queries.count())

    def encode(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            x = matrix(table["v"], np.float64)
            code, norm, corr = codes(x, rotation(x.shape[1], seed))
            yield to_arrow(coded, {"vec_id": table["vec_id"].combine_chunks(), "code": [c.tobytes() for c in code], "norm": norm, "corr": corr, "x": [v.tobytes() for v in x]})

    coded = pa.schema([("vec_id", pa.int64()), ("code", pa.binary()), ("norm", pa.float64()), ("corr", pa.float64()), ("x", pa.binary())])
    left = deal(rows.mapInArrow(encode, "vec_id long, code binary, norm double, corr double, x binary"), "vec_id", "c", candidates, "q", query_blocks)
    right = deal(asked, "vec_id", "q", query_blocks, "c", candidates)

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        asked = asked.sort_by("vec_id")
        q = matrix(asked["v"], np.float64)
        x = column_of(rows["x"], np.float64, len(rows["x"][0].as_py()) // 8)
        if x.shape[1] != q.shape[1]:
            return schema.empty_table()
        turn = rotation(q.shape[1], seed)
        found = _search(np.asarray(rows["vec_id"]), x, column_of(rows["code"], "<u8", len(turn) // 64), np.asarray(rows["norm"]), np.asarray(rows["corr"]), np.asarray(asked["vec_id"]), q, k, turn, eps)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in found], schema=schema)

    return nearest(left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(meet, FOUND.format("double")), k)
