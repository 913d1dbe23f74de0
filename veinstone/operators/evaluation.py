"""Judging results against what was wanted: first ranks, thresholds, score bands and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gates and weights that reports go through.
GATES = (0.45, 0.50, 0.55, 0.62)
WEIGHTS = (0.0, 0.2, 0.35, 0.5, 0.6, 1.0)


def relevant(source: Column, prefixes: Column, sources: Column) -> Column:
    """Whether a result's source is one of the wanted sources or lies under a wanted prefix."""
    value = F.translate(F.coalesce(source, F.lit("")), "\\", "/")
    under = F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda p: value.startswith(p) | (value == F.rtrim(p, F.lit("/"))))
    return (value != "") & (under | F.array_contains(F.coalesce(sources, F.array().cast("array<string>")), value))


def judged(results: DataFrame, golden: DataFrame) -> DataFrame:
    """results (query_id, rank, source, ...) with rel: whether golden (query_id, prefixes, sources) wants the source, as ``relevant`` says.

    A source is cut at the lengths of its query's prefixes, and the cuts are joined with the prefixes as equals.
    """
    path = lambda c: F.translate(F.coalesce(c, F.lit("")), "\\", "/")
    none = F.array().cast("array<string>")
    under = golden.select("query_id", F.explode(F.coalesce("prefixes", none)).alias("key"))
    exact = golden.select("query_id", F.explode(F.coalesce("sources", none)).alias("key")).union(under.select("query_id", F.rtrim("key", F.lit("/"))))
    wanted = under.select("query_id", "key", F.length("key").alias("n")).union(exact.select("query_id", "key", F.lit(-1))).distinct()
    lengths = wanted.groupBy("query_id").agg(F.collect_set("n").alias("lengths"))  # a query's own few
    named = results.select("query_id", "rank", path(F.col("source")).alias("value")).where("value <> ''")
    cuts = named.join(lengths, "query_id").select("query_id", "rank", "value", F.explode("lengths").alias("n")).where("n <= length(value)")
    cuts = cuts.select("query_id", "rank", "n", F.when(F.col("n") < 0, F.col("value")).otherwise(F.substring("value", F.lit(1), F.col("n"))).alias("key"))
    hits = cuts.join(wanted, ["query_id", "n", "key"], "left_semi").select("query_id", "rank", F.lit(True).alias("rel")).distinct()
    return results.join(hits, ["query_id", "rank"], "left").withColumn("rel", F.coalesce("rel", F.lit(False)))


def first_ranks(results: DataFrame) -> DataFrame:
    """query_id, first: the rank of each query's first relevant result (query_id, rank, rel); null without any."""
    return results.groupBy("query_id").agg(F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"))


def golden_report(results: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, label, first, reciprocal and outcome for every query of a golden set (query_id, label, prefixes, sources).

    Positives have a first rank and its reciprocal, 0 without a relevant result; the others have an outcome.
    """
    named = outcomes(golden.select("query_id", "label"), results).join(first_ranks(judged(results, golden)), "query_id", "left")
    positive = F.col("label") == "positive"
    return named.select("query_id", "label", F.when(positive, F.col("first")).alias("first"), F.when(positive, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("reciprocal"), "outcome")


def threshold_scan(results: DataFrame, queries: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, pos_top1, pos_mrr, neg_returned, neg_zero over queries (query_id, negative) and their results (rank, score, rel).

    Results below a threshold go; those left keep their order, so a result's rank counts the ones before it that stay.
    """
    scan = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    kept = results.select("query_id", "rank", "score", "rel", scan).where("score >= threshold")
    # scores fall with the rank, so what a threshold leaves is a prefix and ranks stay
    seen = kept.groupBy("threshold", "query_id").agg(F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), F.count("*").alias("n"))
    every = queries.select("query_id", "negative", scan).join(seen, ["threshold", "query_id"], "left")
    positive, none = ~F.col("negative"), F.coalesce("n", F.lit(0)) == 0
    return every.groupBy("threshold").agg(
        F.round(F.avg(F.when(positive, (F.coalesce("first", F.lit(0)) == 1).cast("double"))), 6).alias("pos_top1"), F.round(F.avg(F.when(positive, F.coalesce(1 / F.col("first"), F.lit(0.0)))), 6).alias("pos_mrr"),
        F.count(F.when(~positive & ~none, 1)).alias("neg_returned"), F.count(F.when(~positive & none, 1)).alias("neg_zero"),
    )


def score_band(scores: DataFrame) -> DataFrame:
    """label, n, and least, greatest and middle of dense and fused over rows (label, dense, fused)."""
    parts = [F.round(f(F.col(c)), 6).alias(f"{name}_{c}") for c in ("dense", "fused") for name, f in (("min", F.min), ("max", F.max), ("med", lambda x: F.percentile(x, 0.5)))]
    return scores.groupBy("label").agg(F.count("*").alias("n"), *parts)


def gate_tradeoff(scores: DataFrame, gates: tuple[float, ...] = GATES) -> DataFrame:
    """signal, gate, kept, inside, leaked, outside: how many rows (inside, dense, fused) reach each gate."""
    rows = scores.select("inside", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in ("dense", "fused")])).alias("s")).select("inside", "s.signal", "s.value", F.explode(F.array(*map(F.lit, gates))).alias("gate"))
    passed = F.col("value") >= F.col("gate")
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("signal", "gate").agg(count(F.col("inside") & passed).alias("kept"), count(F.col("inside")).alias("inside"), count(~F.col("inside") & passed).alias("leaked"), count(~F.col("inside")).alias("outside"))


def weight_gate(weights: DataFrame, threshold: float) -> DataFrame:
    """weight, and the dense score that passes the gate without and with full lexical hits; null where nothing can."""
    passes = F.col("weight") < 1.0
    return weights.select("weight", F.round(F.when(passes, threshold / (1 - F.col("weight"))), 6).alias("without"), F.round(F.when(passes, (threshold - F.col("weight")) / (1 - F.col("weight"))), 6).alias("with_full"))


def weight_gate_passes(scores: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """weight_gate's rows with pass_without and pass_with_full: how many of n scores (dense) pass the gate at each weight, a report's few."""
    low = lambda less: (threshold - F.col("weight") * less) / (1 - F.col("weight"))
    passes = lambda less: F.count(F.when(F.col("weight") < 1.0, F.when(F.col("dense") >= F.when(F.col("weight") < 1.0, low(less)), 1)))
    counts = scores.select("dense").crossJoin(F.broadcast(weights)).groupBy("weight").agg(passes(0).alias("pass_without"), passes(1).alias("pass_with_full"), F.count("*").alias("n"))
    return weight_gate(weights, threshold).join(counts, "weight")


def weight_warning(weight: float | None, default: float, threshold: float) -> str | None:
    """What a weight above the default does to the gate, in words."""
    if weight is None or weight <= default + 0.05:
        return None
    floor = "no score can pass" if weight >= 1 else f"a result without lexical hits needs a dense score of {threshold / (1 - weight):.3f}"
    return f"a weight of {weight:.2f} also raises the gate on the fused score: {floor} (at {default:.2f}: {threshold / (1 - default):.3f})"


def outcomes(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, label, outcome: negatives are blocked or leaked, mismatches have a neighbour or none."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0)) > 0
    name = F.when(F.col("label") == "negative", F.when(found, "leaked").otherwise("blocked")).when(F.col("label") == "mismatch", F.when(found, "neighbour").otherwise("no-neighbour"))
    return queries.join(n, "query_id", "left").select("query_id", "label", name.alias("outcome"))


def unmatched(prefixes: DataFrame, sources: DataFrame) -> DataFrame:
    """The prefixes under which no source lies; prefixes are a request's few."""
    return prefixes.join(sources.select("source"), F.col("source").startswith(F.col("prefix")), "left_anti")
