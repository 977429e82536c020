"""Exact top-k inner products of scaled integer vectors: best-first search of M-trees."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import FOUND, block_counts, deal, matrix, nearest, usable

LEAF, FAN_OUT = 128, 32
PAGE = "tree int, page int, leaf boolean, members binary, vectors binary, radii binary, to_parent binary, extra double"
MOST_COMPONENT = 1e100
_LONG = 2**63
_PAGE_ARROW = pa.schema([("tree", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("members", pa.binary()), ("vectors", pa.binary()), ("radii", pa.binary()), ("to_parent", pa.binary()), ("extra", pa.float64())])


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate gives all vectors the same length; then a smaller distance means a larger inner product."""
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))])


def _distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(axis=1))


def build(ids: np.ndarray, x: np.ndarray, tree: int, seed: int = 1) -> list[dict]:
    """Pages of one M-tree over the rows of ``x``, bulk loaded from the top.

    An inner page holds for each child a routing vector, the covering radius and
    the distance to the page's own routing vector; a leaf holds vectors and their
    distances to it. Page 0 is the root. Copies of one vector are cut into equal
    parts, as no routing vector tells them apart.
    """
    rng, pages = np.random.default_rng(seed), []
    top = float((x * x).sum(axis=1).max())
    points = _lifted(x, top)

    def page(rows: np.ndarray, pivot: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        if len(rows) <= LEAF:
            pages[number] = {"leaf": True, "members": ids[rows], "vectors": points[rows], "radii": np.zeros(0), "to_parent": _distances(points[rows], pivot)}
            return number
        centres = points[rng.choice(rows, min(FAN_OUT, -(-len(rows) // LEAF) + 1), replace=False)]
        near = ((points[rows] ** 2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points[rows] @ centres.T).argmin(axis=1)
        parts = [(rows[near == c], centres[c]) for c in np.unique(near)]
        if len(parts) == 1:
            parts = [(part, part_pivot) for part in np.array_split(rows, min(FAN_OUT, -(-len(rows) // LEAF))) for part_pivot in (points[part[0]],)]
        children = [page(part, centre) for part, centre in parts]
        routing = np.array([centre for _, centre in parts])
        pages[number] = {
            "leaf": False, "members": np.array(children, np.int64), "vectors": routing,
            "radii": np.array([_distances(points[part], centre).max() for part, centre in parts]), "to_parent": _distances(routing, pivot),
        }
        return number

    page(np.arange(len(ids)), np.zeros(points.shape[1]))  # the root's routing vector is the origin
    return [{"tree": tree, "page": n, "extra": top} | {k: v if k == "leaf" else np.ascontiguousarray(v).tobytes() for k, v in p.items()} for n, p in enumerate(pages)]


class Tree:
    def __init__(self, rows: list[dict], width: int):
        self.pages = {
            r["page"]: (r["leaf"], np.frombuffer(r["members"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, width + 1), np.frombuffer(r["radii"], np.float64), np.frombuffer(r["to_parent"], np.float64))
            for r in rows
        }
        self.top = rows[0]["extra"]
        self.computed = 0

    def search(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, id), largest score first, ties to the smaller id.

        Pages wait in a queue by the least distance that a member can have. Before
        any distance is computed, the stored distance to the routing vector and
        the triangle inequality rule out what cannot reach the k-th best so far.
        """
        target = np.append(q, 0.0)
        length = float(q @ q)
        slack = 1e-9 * (np.sqrt(length) + np.sqrt(self.top)) + 1e-9
        queue, kept, reach = [(0.0, 0, np.sqrt(length))], [], np.inf
        ints = [int(v) for v in q] if np.abs(q).max(initial=0) * np.sqrt(self.top) * len(q) >= 2**52 else None
        while queue:
            least, number, to_routing = heapq.heappop(queue)
            if least > reach + slack:
                break
            leaf, members, vectors, radii, to_parent = self.pages[number]
            gap = np.abs(to_routing - to_parent)
            if leaf:
                chosen = np.flatnonzero((gap <= reach + slack) & (members != own))
                self.computed += len(chosen)
                if ints is None:
                    scores = (vectors[chosen, :-1] @ q).tolist()
                else:
                    scores = [sum(int(a) * b for a, b in zip(v, ints, strict=True)) for v in vectors[chosen, :-1]]
                kept = heapq.nsmallest(k, [*kept, *((-max(-_LONG, min(_LONG - 1, int(s))), int(m)) for s, m in zip(scores, members[chosen].tolist(), strict=True))])
                if len(kept) == k:
                    reach = np.sqrt(max(length + self.top + 2.0 * kept[-1][0], 0.0))
                continue
            chosen = np.flatnonzero(gap - radii <= reach + slack)
            self.computed += len(chosen)
            distances = _distances(vectors[chosen], target)
            for child, distance, radius in zip(members[chosen].tolist(), distances.tolist(), radii[chosen].tolist(), strict=True):
                if distance - radius <= reach + slack:
                    heapq.heappush(queue, (max(distance - radius, 0.0), child, distance))
        return [(-s, m) for s, m in kept]


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The ``k`` largest integer inner products of ``floor(scale * x)`` for each row of ``queries`` among all rows of ``df``.

    Inner products are no metric, so a coordinate is added that gives all vectors
    one length. Rows are dealt to trees of bounded size by a hash of their id, so
    a cluster of near vectors never meets in one task; every tree is built once,
    as a table of pages, and each block of queries searches each tree.

    Rows with an unusable vector take no part (see ``vectors.usable``; zero
    vectors do); a query is never its own neighbour; fewer candidates than ``k``
    are all returned; ties go to the smaller id; no rows give no rows. Large
    components are multiplied as whole numbers of any size, so ranks stay exact; a
    score outside of 64 bits is returned as the nearest number inside. Vectors with a
    scaled component above ``MOST_COMPONENT``, whose squares would leave the range
    of a double, take no part.

    Returns query_id, rank (from 1), vec_id, score (long).
    """
    # From 2^53 on every double is whole, and floor() would leave the range of a long.
    scaled = F.transform(F.transform("v", lambda x: x * F.lit(scale)), lambda y: F.when(F.abs(y) < 2.0**53, F.floor(F.when(F.abs(y) < 2.0**53, y)).cast("double")).otherwise(y))
    small = F.forall("v", lambda y: F.abs(y) <= MOST_COMPONENT)
    rows = usable(df, id_col, vector_col).withColumn("v", scaled).where(small)
    asked = usable(queries, id_col, vector_col).withColumn("v", scaled).where(small)
    trees, query_blocks = block_counts(df.count(), queries.count())

    def load(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        return pa.Table.from_pylist(build(np.asarray(table["vec_id"]), matrix(table["v"], np.float64), key[0].as_py()), schema=_PAGE_ARROW)

    dealt = rows.withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.lit(trees)).cast("int"))
    pages = dealt.groupBy("tree").applyInArrow(load, PAGE).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(pages: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not pages.num_rows or not asked.num_rows:
            return schema.empty_table()
        q = matrix(asked["v"], np.float64)
        rows = pages.to_pylist()
        tree, found = Tree(rows, q.shape[1]), []
        for own, vector in zip(asked["vec_id"].to_pylist(), q, strict=True):
            found += [(own, member, score) for score, member in tree.search(own, vector, k)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True) if found else [[], [], []], schema, strict=True)], schema=schema)

    meeting = pages.groupBy("tree", "q").cogroup(deal(asked, "vec_id", "q", query_blocks, "tree", trees).groupBy("tree", "q")).applyInArrow(meet, FOUND.format("long"))
    return nearest(meeting, k)
