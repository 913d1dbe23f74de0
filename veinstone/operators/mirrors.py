"""Mirrors at the size of a corpus: rows whose signatures agree in all places but one, their clusters and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds as P
from ..sources.shared import written
from .recall import MIRROR_LEAST, mirror_keys


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that edges (a, b) reach from each node.

    In each round every node hooks onto its smallest neighbour, hooks are followed to their ends, and edges are drawn
    anew between these; what has no smaller neighbour is at most half of the nodes that have edges, so there are few rounds.
    """
    live = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = None
    while roots is None or not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        while True:
            on = hooks.select(F.col("a").alias("to"), F.col("to").alias("top"))
            further = written(hooks.join(on, "to").select("a", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
            hooks = further.select("a", "to")
            if further.where("moved").isEmpty():
                break
        step = hooks.select(F.col("a").alias("root"), F.col("to").alias("top"))
        roots = written(hooks.select(F.col("a").alias("node"), F.col("to").alias("root")) if roots is None else roots.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        end = lambda side: hooks.select(F.col("a").alias(side), F.col("to").alias(f"t{side}"))
        live = written(live.join(end("a"), "a").join(end("b"), "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct())
    return roots


def clusters(docs: DataFrame, least: int = MIRROR_LEAST) -> DataFrame:
    """id, cluster (its smallest id), n_links (other rows whose signature agrees in all places but one, or in all) of docs (id, text).

    Rows of one signature are one class. Each class that may have a link stands under twelve keys, its signature
    without one place (``mirror_keys``); classes under one key are linked with each other, so a star around the smallest
    joins them and no pair is ever written, however many share a key. Two classes share one key at most, so links are
    counted by key.
    Texts shorter than ``least``, and null ones, have no row.
    """
    signed = written(docs.where(F.length("text") >= least).select("id", P.signature(F.col("text")).alias("s")))
    classes = written(signed.groupBy("s").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    keyed = written(mirror_keys(classes))
    stars = keyed.groupBy("place", "rest").agg(F.min("node").alias("head"), F.sum("n").alias("total"), F.count("*").alias("m")).where("m > 1").drop("m")
    linked = written(keyed.join(stars, ["place", "rest"]).select("node", "head", (F.col("total") - F.col("n")).alias("others")))
    roots = components(linked.select(F.col("node").alias("a"), F.col("head").alias("b")))
    others = linked.groupBy("node").agg(F.sum("others").alias("others"))
    known = classes.join(roots, "node", "left").join(others, "node", "left").select("s", F.coalesce("root", "node").alias("cluster"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return signed.join(known, "s").select("id", "cluster", "n_links")
