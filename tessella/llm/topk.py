"""Exact top-k inner-product search: a ball tree for each shard, branch and bound.

Candidates are dealt into shards, queries into blocks; a task takes one shard and one
block. It builds the shard's ball tree, bounds every node's inner product with every
query, and visits a query's leaves in the order of their bounds until the bound falls
under its kth best score. Shards come in waves, one and then four times as many as before: what
a query's kth score is after a wave goes with it into the next, over all its shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEAF = 64


class BallTree:
    """Leaves of up to LEAF rows, each with the tightest ball among itself and its ancestors."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centers, self.radii, self.parents, self.leaves = [], [], [], []
        self._split(np.arange(len(points)), -1)
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)

    def _split(self, rows: np.ndarray, parent: int) -> None:
        todo = [(rows, parent)]
        while todo:
            rows, parent = todo.pop()
            own = self.points[rows]
            center = own.mean(0)
            me = len(self.centers)
            self.centers.append(center)
            self.radii.append(float(np.sqrt(((own - center) ** 2).sum(1).max())))
            self.parents.append(parent)
            if len(rows) <= LEAF:
                self.leaves.append((me, rows))
                continue
            # Two far points give the direction to halve the rows along.
            far = own[((own - center) ** 2).sum(1).argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            order = np.argpartition(own @ (other - far), len(rows) // 2)
            todo.append((rows[order[: len(rows) // 2]], me))
            todo.append((rows[order[len(rows) // 2 :]], me))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each leaf and query, what no inner product in the leaf exceeds."""
        upper = self.centers @ queries.T + np.outer(self.radii, np.sqrt((queries**2).sum(1)))
        upper += 1e-9 * (1 + np.abs(upper))
        for k, p in enumerate(self.parents):  # parents come before their children
            if p >= 0:
                np.minimum(upper[k], upper[p], out=upper[k])
        return upper[[k for k, _ in self.leaves]]


def search(ids: np.ndarray, points: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best points, its own row aside, that reach its floor.

    Scores are integers: exact in double precision up to 2**53, in Python beyond it.
    """
    tree = BallTree(points)
    upper, out = tree.bounds(queries), []
    exact = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(points.shape[1], 1) < 2**53
    leaf_rows = [rows for _, rows in tree.leaves]
    for j in range(len(q_ids)):
        order = np.argsort(-upper[:, j], kind="stable")
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.float64 if exact else object)
        floor, at = floors[j], 0
        while at < len(order) and upper[order[at], j] >= floor:
            rows = np.concatenate([leaf_rows[x] for x in order[at : at + 4]])
            at += 4
            rows = rows[ids[rows] != q_ids[j]]
            if exact:
                scores = points[rows] @ queries[j]
            else:
                q = [int(x) for x in queries[j]]
                scores = np.array([sum(int(a) * b for a, b in zip(p, q)) for p in points[rows]], object)
            near = scores >= floor
            best_ids, best = np.concatenate([best_ids, ids[rows][near]]), np.concatenate([best, scores[near]])
            if len(best) > k:
                keep = sorted(range(len(best)), key=lambda x: (-best[x], best_ids[x]))[:k] if not exact else np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[keep], best[keep]
            if len(best) == k:
                floor = max(floor, float(min(best)))
        out += [(int(q_ids[j]), int(i), max(-(2**63), min(2**63 - 1, int(s)))) for i, s in zip(best_ids, best)]
    return out


def valid_vectors(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(id, v): ids and doubles of vectors that are not null and hold no null or non-finite component.

    An id counts once: of repeated rows the smallest vector.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _tile(k: int):
    def run(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        # Into floor(256 x) of doubles, exact up to 2**53.
        p, q = (np.floor(256 * np.stack(list(x)).astype(np.float64)) for x in (points["v"], queries["q"]))
        rows = search(points["id"].to_numpy(), p, queries["query_id"].to_numpy(), q, queries["floor"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, *, k=5, id_col="vec_id", vector_col="embedding", shard_rows=8192, block_rows=8192) -> DataFrame:
    """The k best rows for each query: query_id, rank (from 1), vec_id, score.

    Components become floor(256 x); the score is the integer inner product, ties go to
    the smaller id, and a row is no candidate for itself. is_query: a condition on the
    column id. Vectors of different lengths are not compared; null ids and invalid
    vectors take no part, repeated ids count once (the smallest vector). A score
    beyond a long is held at its limit. Other columns are not looked at.
    """
    base = staged(valid_vectors(vectors, id_col=id_col, vector_col=vector_col), "vectors")
    n, n_queries = base.count(), base.where(is_query).count()
    schema = "query_id long, vec_id long, score long"
    if not n_queries:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, blocks = -(-n // shard_rows), -(-n_queries // block_rows)
    sharded = base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    # Own names on the query side: both sides come from one table.
    blocked = base.where(is_query).select(
        F.col("id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    )
    tile, best = ["dim", "shard", "block"], base.sparkSession.createDataFrame([], schema)
    distance = lambda block, shard: F.pmod(shard - block, F.lit(shards))  # noqa: E731  # a block of queries begins in the shard of its number
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    low, high = 0, 1
    while low < shards:
        kth = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        # A long of more than 53 bits may round up as a double.
        floor = F.col("least").cast("double") - F.when(F.abs("least") >= 2**53, F.abs("least") * 1e-15).otherwise(0)
        asked = blocked.join(kth, "query_id", "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf"))))
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(min(high, shards) - 1))))
        asked = asked.select("query_id", "q", "block", "dim", F.pmod(F.col("block") + F.col("shard"), F.lit(shards)).cast("int").alias("shard"), "floor")
        own = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (distance(b, F.col("shard")) >= low) & (distance(b, F.col("shard")) < high))  # noqa: B023
        points = sharded.withColumn("block", F.explode(own))
        found = points.groupBy(tile).cogroup(asked.groupBy(tile)).applyInPandas(_tile(k), schema)
        ranked = best.unionAll(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        low, high = high, 4 * high
        if low >= shards:
            return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best = staged(ranked.select("query_id", "vec_id", "score"), "best")
