"""Exact top-k inner-product search with a pair of cover trees.

Queries and vectors are dealt into a grid of blocks by a hash of their ids; each
cell builds one cover tree over its queries and one over its vectors and walks
both together. A pair of nodes is dropped when the largest inner product that
their covering radii allow is below the worst kth score of every query in the
query node. The cells' k best rows are then merged by rank, so no cell ever
holds more than its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
LEAF = 48


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


class CoverTree:
    """A batch-built cover tree: at each level, centres more than half the radius apart cover their node."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norm = np.sqrt((points * points).sum(axis=1))
        self.root = self._node(np.arange(len(points)), 0)

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        gap = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _node(self, rows: np.ndarray, centre: int) -> dict:
        away = self._distance(rows, centre)
        node = {"centre": centre, "radius": float(away.max()), "rows": rows, "children": ()}
        if len(rows) > LEAF and node["radius"] > 0:
            node["children"] = self._cover(rows, away, centre, node["radius"] / 2)
        return node

    def _cover(self, rows: np.ndarray, away: np.ndarray, centre: int, reach: float) -> list[dict]:
        owner, nearest, centres = np.zeros(len(rows), np.int64), away.copy(), [centre]
        while (far := int(nearest.argmax())) is not None and nearest[far] > reach:
            gap = self._distance(rows, int(rows[far]))
            closer = gap < nearest
            owner[closer], nearest[closer] = len(centres), gap[closer]
            centres.append(int(rows[far]))
        order = np.argsort(owner, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])
        small = [g for g in groups if len(g) < LEAF // 3]
        made = [self._node(rows[g], c) for g, c in zip(groups, centres, strict=True) if len(g) >= LEAF // 3]
        loose = np.concatenate(small) if small else np.zeros(0, np.int64)
        for i in range(0, len(loose), LEAF):  # sparse regions: leaves of their own, with a radius of their own
            part = rows[loose[i : i + LEAF]]
            made.append({"centre": int(part[0]), "radius": float(self._distance(part, int(part[0])).max()), "rows": part, "children": ()})
        return made


class _Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(self.score[rows, -1].min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = (scores >= self.score[rows, -1:]).any(axis=1)
        if not hit.any():
            return
        rows, scores = rows[hit], scores[hit]
        score = np.concatenate([self.score[rows], scores], axis=1)
        known = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((known, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.id[rows] = np.take_along_axis(known, order, axis=1)


def dual_tree_topk(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> _Best:
    """Each query's k best points by inner product; a point with the query's own id takes no part."""
    best = _Best(len(queries), k)
    if not len(queries) or not len(points):
        return best
    left, right = CoverTree(queries), CoverTree(points)
    span = queries.shape[1]

    def bound(q: dict, p: dict) -> float:
        a, b = q["centre"], p["centre"]
        top = queries[a] @ points[b] + q["radius"] * right.norm[b] + p["radius"] * left.norm[a] + q["radius"] * p["radius"]
        return float(top + 1e-9 * (abs(top) + left.norm[a] * right.norm[b] + span))

    stack = [(bound(left.root, right.root), left.root, right.root)]
    while stack:
        top, q, p = stack.pop()
        if top < best.worst(q["rows"]):
            continue
        if q["children"] and (not p["children"] or q["radius"] * right.norm[p["centre"]] >= p["radius"] * left.norm[q["centre"]]):
            pairs = [(bound(x, p), x, p) for x in q["children"]]
        elif p["children"]:
            pairs = [(bound(q, x), q, x) for x in p["children"]]
        else:
            scores = queries[q["rows"]] @ points[p["rows"]].T
            scores[query_ids[q["rows"]][:, None] == ids[p["rows"]][None, :]] = -np.inf
            best.offer(q["rows"], scores, ids[p["rows"]])
            continue
        stack += sorted(pairs, key=lambda x: x[0])
    return best


def _thinned(points: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the ``most`` smallest ids: with k + 1 of them no answer can change."""
    order = np.lexsort((ids,))
    points, ids = points[order], ids[order]
    if points.shape[1]:
        flat = np.ascontiguousarray(points + 0.0).view([("", points.dtype)] * points.shape[1]).ravel()
        _, kind = np.unique(flat, return_inverse=True)
    else:
        kind = np.zeros(len(ids), np.int64)
    order = np.argsort(kind, kind="stable")
    first = np.r_[0, np.flatnonzero(np.diff(kind[order])) + 1]
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    keep = np.sort(order[rank < most])
    return points[keep], ids[keep]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k best vectors by inner product, exactly.

    Both sides hold (id long, vec array<double>); other columns are ignored.
    Returns (query_id, rank, vec_id, score double), ranks from 1, ties to the
    smaller id. A vector is no candidate of the query with its own id; vectors
    of another dimension are no candidates either. Null vectors and vectors with
    null or non-finite components take no part; null ids neither. Repeated rows
    count once. An empty side gives an empty result. Scores are exact while
    they stay below 2**53.
    """
    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"))).dropDuplicates(["id", "vec"])

    data, asked = clean(vectors), clean(queries)
    n, m = max(1, -(-data.count() // block_rows)), max(1, -(-asked.count() // block_rows))
    cell = [F.size("vec").alias("dim"), "id", "vec"]
    data = data.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("col"), *cell)
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("row"), F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("col"), *cell)
    most = k + 1

    def search(points: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(found):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        p, ids = _thinned(np.stack(points["vec"].to_numpy()).astype(np.float64), points["id"].to_numpy(), most)
        q, own = np.stack(found["vec"].to_numpy()).astype(np.float64), found["id"].to_numpy()
        best = dual_tree_topk(q, own, p, ids, k)
        real = best.score > -np.inf
        return pd.DataFrame({"query_id": np.broadcast_to(own[:, None], real.shape)[real], "vec_id": best.id[real], "score": best.score[real]})

    key = ["row", "col", "dim"]
    found = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
