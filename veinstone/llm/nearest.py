"""Approximate nearest neighbours by low-dimensional stable projections under kd-trees, searched incrementally.

Vectors of like norms form a band, in which they are lifted so that the largest inner product is the nearest point,
projected by a Gaussian (2-stable) matrix and indexed by a kd-tree. A squared projected distance is the true one times
a chi-square variable. A query opens the leaves of a tree in order of their boxes' distance, takes the points opened so
far in order of their projected distance, verifies them by their exact inner product, and stops where a point as near
as its k-th best so far would have shown itself by now with probability CONFIDENCE. Bands go from the largest norms
down, and end where no vector of such a norm can reach the k-th best; that bound is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMS, LEAF, CONFIDENCE, SEED = 32, 64, 0.9, 3
QUERY_BLOCK = 4096  # queries, in the mean, that meet one tree at a time
SHARD = 8192  # vectors, in the mean, under one tree
BAND = 1.5  # largest norm over smallest in a band, at most
FIRST = 8  # leaves opened before the first test; half as many again each time
STEP = 96  # points verified between two tests
SCHEMA = "query_id long, vec_id long, score double, verified long, opened long, points long"


def chi_square_cdf(x: np.ndarray | float, dims: int = DIMS) -> np.ndarray | float:
    """Closed form for an even number of dimensions."""
    h = np.asarray(x) / 2
    return 1 - np.exp(-h) * sum(h**i / math.factorial(i) for i in range(dims // 2))


def quantile(p: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid) < p else (lo, mid)
    return hi


class Band:
    """Vectors of like norms in the leaves of a kd-tree over their projections; a leaf is a slice of the rows."""

    def __init__(self, rows: np.ndarray, points: np.ndarray, norms: np.ndarray, matrix: np.ndarray) -> None:
        self.top = float(norms.max())
        at = np.column_stack((points / self.top, np.sqrt(np.maximum(0, 1 - (norms / self.top) ** 2)))) @ matrix
        leaves, work = [], [np.arange(len(at))]
        while work:
            held = work.pop()
            if len(held) <= LEAF:
                leaves.append(held)
                continue
            axis = int(np.argmax(np.ptp(at[held], axis=0)))
            held = held[np.argpartition(at[held, axis], len(held) // 2)]
            work += [held[: len(held) // 2], held[len(held) // 2 :]]
        order = np.concatenate(leaves)
        self.low = np.array([at[x].min(axis=0) for x in leaves])
        self.high = np.array([at[x].max(axis=0) for x in leaves])
        self.ends = np.cumsum([len(x) for x in leaves])
        self.rows, self.points, self.at = rows[order], points[order], at[order]
        self.sizes = np.einsum("ij,ij->i", self.at, self.at)

    def nearest(self, query: np.ndarray, norm: float, best: Best, limit: float) -> tuple[int, int]:
        """Verify this band's points for best in order of projected distance; how many were verified, and how many opened."""
        # in units of the longest vector; a query as long as that tells inner products apart best
        p, unit = np.append(query / norm, 0.0) @ best.matrix, max(norm * self.top, 5e-324)
        gap = np.maximum(0, np.maximum(self.low - p, p - self.high))
        boxes = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(boxes, kind="stable")
        bound = lambda: limit * max(0.0, 2 - 2 * best.least / unit)
        waiting, apart = np.zeros(0, dtype=np.int64), np.zeros(0)
        verified = opened = done = 0
        take = FIRST
        while True:
            leaves = order[done : done + take]
            leaves = leaves[boxes[leaves] <= bound()]
            done, take = done + take, take + take // 2
            if len(leaves):
                rows = np.concatenate([np.arange(self.ends[x - 1] if x else 0, self.ends[x]) for x in leaves.tolist()])
                away = self.sizes[rows] - 2 * (self.at[rows] @ p) + p @ p
                opened += len(rows)
                live = away <= bound()
                waiting, apart = np.concatenate((waiting, rows[live])), np.concatenate((apart, away[live]))
            last = done >= len(order) or boxes[order[done]] > bound()
            # until k are known the first leaves' points go in at once; after that a point waits till no leaf can hold a nearer one
            seeds = best.short
            reach = np.inf if last or seeds else boxes[order[done]]
            now = apart <= reach
            ready, away = waiting[now], apart[now]
            turn, i = np.argsort(away, kind="stable"), 0
            while i < len(turn) and away[turn[i]] <= bound():  # beyond it the chi-square test holds for all that is left
                some = ready[turn[i : i + STEP]]
                best.add(self.rows[some], self.points[some] @ query)
                i, verified = i + len(some), verified + len(some)
            if last or (i < len(turn) and not seeds):
                return verified, opened
            rest = ~now & (apart <= bound())
            waiting, apart = np.concatenate((ready[turn[i:]], waiting[rest])), np.concatenate((away[turn[i:]], apart[rest]))


class Best:
    """The best rows of a query so far, with all that tie with the last."""

    def __init__(self, k: int, matrix: np.ndarray) -> None:
        self.k, self.matrix, self.rows, self.scores, self.least = k, matrix, np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf

    @property
    def short(self) -> bool:
        return self.least == -np.inf

    def add(self, rows: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.least
        self.rows, self.scores = np.concatenate((self.rows, rows[keep])), np.concatenate((self.scores, scores[keep]))
        if len(self.scores) > self.k:  # one more than asked for, since a query's own row is no result
            self.least = -float(np.partition(-self.scores, self.k)[self.k])
            keep = self.scores >= self.least
            self.rows, self.scores = self.rows[keep], self.scores[keep]


class Tree:
    """Distinct vectors of a shard, with the ids that carry each one, in bands of like norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.points, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        self.ids, self.starts = ids[order], np.searchsorted(which.ravel()[order], np.arange(len(self.points) + 1))
        self.matrix = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, DIMS))
        most = np.abs(self.points).max(axis=1, keepdims=True)  # squares of very small and very large values don't fit
        norms = np.linalg.norm(self.points / most, axis=1) * most[:, 0]
        level = np.floor(np.log(norms.max() / norms) / math.log(BAND) + 1e-6).astype(np.int64)
        self.bands = [Band(rows, self.points[rows], norms[rows], self.matrix) for rows in (np.flatnonzero(level == x) for x in np.unique(level))]

    def search(self, queries: np.ndarray, owns: list[int], k: int, limit: float) -> list[tuple[list[tuple[float, int]], int, int]]:
        """For each query the k best (score, id) found, by score and then smaller id, without its own id; how many points it verified, and how many it opened."""
        return [self._search(q, own, k, limit) for q, own in zip(queries, owns, strict=True)]

    def _search(self, query: np.ndarray, own: int, k: int, limit: float) -> tuple[list[tuple[float, int]], int, int]:
        best, verified, opened, norm = Best(k, self.matrix), 0, 0, float(np.linalg.norm(query / np.abs(query).max()) * np.abs(query).max())
        for band in self.bands:
            if norm * band.top * (1 + 1e-9) < best.least:
                break  # no vector of these norms, or of smaller ones, can score as high
            v, o = band.nearest(query, norm, best, limit)
            verified, opened = verified + v, opened + o
        exact = (self.points[best.rows] * query).sum(axis=1)
        out = []
        for b, s in zip(best.rows.tolist(), exact.tolist(), strict=True):
            first, last = self.starts[b], self.starts[b + 1]
            out += [(-s, int(v)) for v in self.ids[first : min(last, first + k + 1)] if v != own]
        return [(-s, v) for s, v in sorted(set(out))[:k]], verified, opened


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and its vector as doubles; null ids and null, zero or unclean vectors are left out."""
    v = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )


def candidates(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """What each query finds in each shard: query_id, vec_id, score, and how many of the shard's points it verified and opened.

    Both sides are dealt by hash, vectors to shards and queries to blocks, and every shard meets every block in a task
    of bounded size; nothing is collected or broadcast.
    """
    rows = usable(vectors)
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-counted["n"] // SHARD)), max(1, -(-counted["q"] // QUERY_BLOCK))
    limit = quantile(CONFIDENCE)
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.withColumn("shard", place(shards)).withColumn("block", every_one(blocks) if blocks > 1 else F.lit(0))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("to_block", place(blocks)).withColumn("to_shard", every_one(shards) if shards > 1 else F.lit(0))
    asked = asked.select("to_shard", "to_block", F.col("vec_id").alias("query_id"), F.col("v").alias("query"))

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(points) and len(queries):
            sizes, wanted = points["v"].map(len).to_numpy(), queries["query"].map(len).to_numpy()
            for dims in np.unique(wanted):
                at = np.flatnonzero(sizes == dims)
                if len(at):
                    tree = Tree(points["vec_id"].to_numpy(np.int64)[at], np.stack(points["v"].to_numpy()[at]))
                    ours = np.flatnonzero(wanted == dims)
                    names = queries["query_id"].to_numpy(np.int64)[ours].tolist()
                    for q, (best, verified, opened) in zip(names, tree.search(np.stack(queries["query"].to_numpy()[ours]), names, k, limit), strict=True):
                        found += [(q, v, s, verified, opened, len(tree.points)) for s, v in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "verified", "opened", "points"])

    return held.groupBy("shard", "block").cogroup(asked.groupBy("to_shard", "to_block")).applyInPandas(run, SCHEMA)


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each vec_id divisible by ``every``.

    Vectors of another dimension than a query's are no candidates of it; rows that repeat a vec_id with one vector
    count once; a vec_id with several vectors asks and is found with each, and its best score counts. Ties go to the
    smaller vec_id. Vectors null, zero or unclean and null ids take no part; an empty table has no rows; other columns
    are not read.
    """
    best = candidates(vectors, every, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
