"""Each query's nearest rows, exactly: blocks of vectors meet blocks of queries as products of matrices.

A product tells scores to within a bound on its rounding. Rows that may be among the best of their block by that bound
are scored once more term by term, as the expression in ``functions.vectors.dot`` does, and the best of all blocks are
ranked by these scores. So the order is the expression's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 16384, 2048  # vectors and queries of a block, in the mean; a task holds one block of each
CELLS = 1 << 22  # scores at a time
PLACES = 1e-6  # scores are ranked as rounded to six places
SCHEMA = "query_id long, row long, score double"


def folded(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first dimension to the last."""
    out = np.zeros(len(rows))
    with np.errstate(all="ignore"):
        for k in range(rows.shape[1]):
            out += rows[:, k] * query[k]
    return out


def _best(names: np.ndarray, points: np.ndarray, query: np.ndarray, rough: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and scores of all points that may be among the k best by rounded score and then name; of equal scores the k least names."""
    sure = np.isfinite(rough)
    if k < len(rough):
        floor = np.partition(np.where(sure, rough, -np.inf), len(rough) - k)[len(rough) - k] - 2 * PLACES - slack
        at = np.flatnonzero((rough >= floor) | ~sure)
    else:
        at = np.arange(len(rough))
    score = folded(points[at], query)
    if len(at) > k:
        order = np.lexsort((names[at], -score))  # NaN, the greatest in a ranking, comes last here and is told apart
        at, score = at[order], score[order]
        bits = score.view(np.int64)
        begin = np.concatenate(([True], bits[1:] != bits[:-1]))
        start = np.flatnonzero(begin)[np.cumsum(begin) - 1]
        live = np.arange(len(at)) - start < k
        at, score = at[live], score[live]
    return names[at], score


def _vectors(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: places and matrix of the vectors without null components; the others stand under -1."""
    sizes = np.array([-1 if v is None else len(v) for v in column], dtype=np.int64)
    out = {}
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        out[int(dims)] = (at, np.stack([np.asarray(column.iloc[i], dtype=np.float64) for i in at]) if dims >= 0 else np.zeros((len(at), 0)))
    return out


def block(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, row, score of what may be among each query's k best of a block; a null vector or one of another dimension has a null score, the last."""
    held, asked = _vectors(points["v"]), _vectors(queries["q"])
    rows, ids = points["row"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
    out_q, out_r, out_s = [], [], []
    for dims, (at, wanted) in asked.items():
        mine, matrix = held.get(dims, (np.zeros(0, dtype=np.int64), None)) if dims >= 0 else (np.zeros(0, dtype=np.int64), None)
        apart = np.ones(len(rows), dtype=bool)
        apart[mine] = False
        rest = np.sort(rows[apart])[:k]
        names = rows[mine]
        if len(mine):
            clean = matrix[np.isfinite(matrix).all(axis=1)]  # scores of the others are told from their not being finite
            with np.errstate(all="ignore"):
                longest = np.sqrt(np.einsum("ij,ij->i", clean, clean)).max(initial=0.0)
            step = max(1, CELLS // len(mine))
            for first in range(0, len(at), step):
                some = wanted[first : first + step]
                with np.errstate(all="ignore"):
                    rough, size = some @ matrix.T, np.sqrt(np.einsum("ij,ij->i", some, some))
                for i in range(len(some)):
                    bound = 4 * (dims + 2) * 2.3e-16 * size[i] * longest
                    found, score = _best(names, matrix, some[i], rough[i], bound if np.isfinite(bound) else np.inf, k)
                    out_q.append(np.full(len(found), ids[at[first + i]]))
                    out_r.append(found)
                    out_s.append(score)
        if len(rest):
            for i in at:
                out_q.append(np.full(len(rest), ids[i]))
                out_r.append(rest)
                out_s.append([None] * len(rest))
    flat = lambda x: np.concatenate(x) if x else []
    score = pd.array([], dtype="Float64")
    if out_s:
        values = np.concatenate([np.zeros(len(s)) if isinstance(s, list) else s for s in out_s])
        null = np.concatenate([np.ones(len(s), dtype=bool) if isinstance(s, list) else np.zeros(len(s), dtype=bool) for s in out_s])
        score = pd.arrays.FloatingArray(values, null)
    return pd.DataFrame({"query_id": pd.Series(flat(out_q), dtype="int64"), "row": pd.Series(flat(out_r), dtype="int64"), "score": score})


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, row, dense, rank: the k best of rows (row, embedding) for each query (query_id, vector) by the inner product rounded to six places, ties to the smaller row.

    Null vectors, null components and other dimensions give a null score, which comes last; NaN comes first. A task
    works on one block of each side whatever the table's size; blocks are dealt by hash and meet in a join.
    """
    n, q = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // ROWS)), max(1, -(-q // QUERIES))
    vector = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c).cast("array<double>"))
    deal = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.select(F.col("row").cast("long").alias("row"), vector("embedding").alias("v")).withColumn("shard", deal("row", shards)).withColumn("block", every(blocks))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), vector("vector").alias("q")).withColumn("to_block", deal("query_id", blocks)).withColumn("to_shard", every(shards))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("to_shard", "to_block")).applyInPandas(lambda p, a: block(p, a, k), SCHEMA)
    scored = found.select("query_id", "row", F.round("score", 6).alias("dense"))
    kept = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense"), "row"))).where(F.col("rank") <= k)
    return kept.select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("row").cast(rows.schema["row"].dataType).alias("row"), "dense", "rank")
