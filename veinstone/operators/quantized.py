"""A trained scalar quantizer: an int8 scan with an error bound, then an exact look at what the bound leaves open."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.shared import written
from .nearby import QUERIES, ROWS

SAMPLE_ROWS = 20_000  # rows, about, that the bounds are trained on; every row is encoded, whatever its range
LEVELS = 255


def train(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[float, float]]:
    """(least, step) of each dimension over a sample of vectors (embedding), drawn by hash of the vector; one number pair for each dimension."""
    total = vectors.count()
    drawn = vectors.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / max(total, 1))) + 1)
    found = drawn.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x")).where(~F.isnan("x")).groupBy("at").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    return [(r["lo"], (r["hi"] - r["lo"]) / LEVELS or 1.0) for r in sorted(found, key=lambda r: r["at"])]


def encode(vectors: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """row, code (a byte for each dimension) and off: how far the decoded vector is from the true one.

    Numbers outside the trained bounds take the nearest code; off, worked out from the row itself, holds what that loses.
    """
    lo, step = (F.array(*[F.lit(float(b[k])) for b in bounds]) for k in (0, 1))
    v = F.col("embedding").cast("array<double>")
    code = F.zip_with(F.zip_with(v, lo, lambda x, m: x - m), step, lambda x, s: F.greatest(F.lit(0.0), F.least(F.lit(float(LEVELS)), F.rint(x / s))))
    known = vectors.select("row", v.alias("_v"), code.alias("_c"))
    back = F.zip_with(F.zip_with("_c", step, lambda c, s: c * s), lo, lambda x, m: x + m)
    apart = F.zip_with("_v", back, lambda x, y: x - y)
    return known.select("row", F.transform("_c", lambda c: (c - 128).cast("tinyint")).alias("code"), F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)).alias("off"))


def open_rows(codes: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, row and the bounds least and most of their product, for a block's rows that its k-th greatest lower bound doesn't rule out.

    Rows or queries whose bounds aren't finite are ruled out by nothing.
    """
    out = []
    if len(codes) and len(asked):
        matrix, off, rows = np.stack(codes["code"].to_numpy()).astype(np.float64), codes["off"].to_numpy(np.float64), codes["row"].to_numpy(np.int64)
        for name, w, length, base in zip(asked["query_id"], asked["w"], asked["length"], asked["base"], strict=True):
            with np.errstate(all="ignore"):
                product, slack = base + matrix @ w, length * off + 2e-6 + 1e-12 * abs(base)  # of rounding to six places, and of summing in another order
                sure = np.isfinite(product) & np.isfinite(slack)
                least, most = np.where(sure, product - slack, -np.inf), np.where(sure, product + slack, np.inf)
            floor = np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else -np.inf
            at = np.flatnonzero(most >= floor)
            out.append(pd.DataFrame({"query_id": np.full(len(at), name), "row": rows[at], "least": least[at], "most": most[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "least": pd.Series(dtype="float64"), "most": pd.Series(dtype="float64")})


def topk(vectors: DataFrame, queries: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, row, dense, rank: exactly the k best rows of each query, by rounded inner product, ties to the smaller row.

    vectors has row and embedding, queries query_id and vector. A product with a decoded vector is off by at most the
    query's length times the row's distance from its decoded self. So the k-th greatest of the lower bounds is a floor
    that the true k-th reaches, and only rows whose upper bound reaches it are scored from their true numbers.
    """
    bounds = train(vectors, sample_rows)
    codes = encode(vectors, bounds)
    lo, step = (F.array(*[F.lit(float(b[i])) for b in bounds]) for i in (0, 1))
    v = F.col("vector").cast("array<double>")
    scaled = queries.select("query_id", F.zip_with(v, step, lambda x, s: x * s).alias("w"), F.sqrt(dot(v, v)).alias("length"), dot(v, F.transform(F.zip_with(lo, step, lambda m, s: m + 128 * s), lambda x: x)).alias("base"))
    n, q = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // ROWS)), max(1, -(-q // QUERIES))
    deal = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = codes.where("off IS NOT NULL").withColumn("shard", deal("row", shards)).withColumn("block", every(blocks))
    asked = scaled.where("base IS NOT NULL").withColumn("to_block", deal("query_id", blocks)).withColumn("to_shard", every(shards))
    scored = written(held.groupBy("shard", "block").cogroup(asked.groupBy("to_shard", "to_block")).applyInPandas(lambda c, a: open_rows(c, a, k), "query_id long, row long, least double, most double"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("least")))
    floor = scored.withColumn("_p", place).where(F.col("_p") <= k).groupBy("query_id").agg(F.min("least").alias("floor"))
    left = scored.join(floor, "query_id").where("most >= floor").select("query_id", "row")
    true = left.join(vectors, "row").join(queries, "query_id").select("query_id", "row", F.round(dot(F.col("embedding"), F.col("vector")), 6).alias("dense"))
    return true.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense"), "row"))).where(F.col("rank") <= k)
