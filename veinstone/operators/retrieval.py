"""Retrieval operators: filters, dense and lexical scores, fusion and selection, for batches of queries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers
from ..sources.shared import written
from .nearby import nearest

LEXICAL_WEIGHT, BODY, PATH, IDF_POWER, MAX_DF, POOL = 0.35, 0.45, 0.55, 2.0, 500, 600


def path_filter(path: Column, category: str | None = None, source_prefix: str | None = None, source: str | None = None, year: int | None = None, exclude: list[str] | None = None) -> Column:
    """The conjunction of the given filters; categories match whole segments, prefixes match literally. A null path is empty."""
    path, tests = F.translate(F.coalesce(path, F.lit("")), "\\", "/"), [F.lit(True)]
    if category:
        c = category.replace("\\", "/").strip("/")
        tests.append((path == c) | path.startswith(f"{c}/"))
    if source_prefix:
        tests.append(path.startswith(source_prefix.replace("\\", "/")))
    if source:
        tests.append(path == source.replace("\\", "/"))
    if year:
        tests.append(path.rlike(f"(?:^|[^0-9]){year}(?:[^0-9]|$)"))
    tests += [~path.startswith(p) for p in (x.replace("\\", "/").strip("/") for x in exclude or []) if p]
    return reduce(lambda a, b: a & b, tests)


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, dense and rank of the k best chunks of each query."""
    found = nearest(chunks.select(F.col("doc_id").alias("row"), "embedding"), queries.select("query_id", F.col("query").alias("vector")), k)
    return found.select("query_id", F.col("row").alias("doc_id"), "dense", "rank")


def postings(chunks: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """token, df and sorted doc_ids of identifiers in at most max_df chunks.

    One shuffle: of a token no task sends more than max_df + 1 rows, so a longer list is told apart but never gathered.
    """
    pairs = chunks.select("doc_id", F.explode(identifiers(F.col("text"))).alias("token"))
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("token").orderBy("doc_id"))).where(F.col("_r") <= max_df + 1)
    return first.groupBy("token").agg(F.count("*").alias("df"), F.sort_array(F.collect_list("doc_id")).alias("docs")).where(F.col("df") <= max_df)


def lexical_scores(pool: DataFrame, terms: list[str]) -> DataFrame:
    """pool's columns but for its text, with lexical: squared-IDF share of the terms in text and path, over the pool's own frequencies.

    Hits are looked for once and written without the texts, so that totals and scores read a few bits for each row.
    """
    hit = lambda c, t: F.coalesce(F.lower(c).rlike(rf"(?<![a-z0-9]){''.join(chr(92) + x if not x.isalnum() else x for x in t)}(?![a-z0-9])"), F.lit(False)).cast("int")
    marked = written(pool.withColumns({f"_{k}{i}": hit(c, t) for i, t in enumerate(terms) for k, c in (("b", "text"), ("p", "path"))}).drop("text"))
    totals = marked.agg(F.count("*").alias("_n"), *[F.sum(F.col(f"_b{i}") + F.col(f"_p{i}")).alias(f"_f{i}") for i in range(len(terms))]).first()  # one row
    w = [F.lit(math.log((totals["_n"] + 1) / (totals[f"_f{i}"] + 0.5)) ** IDF_POWER if totals["_n"] else 0.0) for i in range(len(terms))]
    total = reduce(lambda a, b: a + b, w)
    part = lambda k: reduce(lambda a, b: a + b, [w[i] * F.col(f"_{k}{i}") for i in range(len(terms))]) / total
    score = F.when(total <= 1e-9, 0.0).otherwise(F.least(F.lit(1.0), BODY * part("b") + PATH * part("p")))
    return marked.withColumn("lexical", score).select(*[c for c in pool.columns if c != "text"], "lexical")


def fuse(dense: Column, lexical: Column, weight: float = LEXICAL_WEIGHT) -> Column:
    positive = F.greatest(F.lit(0.0), dense)
    return positive if weight <= 0 else (1 - weight) * positive + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), lexical))


def best_per_source(ranked: DataFrame, source: str, score: str, tie: str, k: int) -> DataFrame:
    """The best row of each source, then the k best of these."""
    w = Window.partitionBy(source).orderBy(F.desc(score), tie)
    return ranked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc(score), tie).limit(k)
