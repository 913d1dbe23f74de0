"""The corpus-wide operators against brute force, over odd rows, and what their scans read."""

import itertools
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.functions import folds as P
from veinstone.operators import browse as B
from veinstone.operators import evaluation as E
from veinstone.operators import ingest as I
from veinstone.operators import mirrors as M
from veinstone.operators import quantized as Z
from veinstone.operators import ranges as G
from veinstone.operators import recall as R
from veinstone.operators.delta import Index

SF = "/root/testdata/sf0.01"


def plain_signature(text):
    bare = "".join((text or "").split()).lower()
    if len(bare) < P.GRAM:
        return [0] * len(P.FACTORS)
    grams = {bare[i : i + P.GRAM].encode() for i in range(len(bare) - P.GRAM + 1)}
    hashes = [((zlib.crc32(g) << 32) | zlib.adler32(g)) % P.PRIME for g in grams]
    return [min((f * h + t) % P.PRIME for h in hashes) for f, t in zip(P.FACTORS, P.TERMS, strict=True)]


def test_signatures(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()] + [None, "", "短", "é中文👍abc ñandú 12345", "abcdefgh", "a" * 50_000]
    assert list(map(P.signature_of, texts)) == list(map(plain_signature, texts))


def closure(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_mirror_clusters_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    signs = {i: np.array(P.signature_of(t)) for i, t in docs if t and len(t) >= 80}
    ids = sorted(signs)
    table = np.stack([signs[i] for i in ids])
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero((table[a + 1 :] == table[a]).sum(axis=1) >= 11) + a + 1]
    root, n = closure(ids, pairs), dict.fromkeys(ids, 0)
    for x in itertools.chain.from_iterable(pairs):
        n[x] += 1
    df = spark.createDataFrame(docs, "id long, text string")
    assert {r.id: (r.cluster, r.n_links) for r in M.clusters(df).collect()} == {i: (root[i], n[i]) for i in ids}
    assert M.clusters(df.limit(0)).count() == 0


def test_mirror_clusters_of_one_hot_half(spark, monkeypatch):
    """Signatures that share one half, some of them chained by single places: links and clusters as by all pairs."""
    rng = random.Random(3)
    signs = [[1] * 6 + [rng.randint(0, 2) for _ in range(6)] for _ in range(300)] + [[rng.randint(0, 1)] * 6 + [7] * 6 for _ in range(20)]
    monkeypatch.setattr(M.P, "signature", lambda c: F.from_json(c, "array<long>"))
    df = spark.createDataFrame([(i, str(s), "x") for i, s in enumerate(signs)], "id long, text string, node string")
    pairs = [(a, b) for a, b in itertools.combinations(range(len(signs)), 2) if sum(x == y for x, y in zip(signs[a], signs[b], strict=True)) >= 11]
    root, n = closure(range(len(signs)), pairs), [sum(i in p for p in pairs) for i in range(len(signs))]
    assert sorted(map(tuple, M.clusters(df, 1).collect())) == [(i, root[i], n[i]) for i in range(len(signs))]


def test_signatures_of_a_batch(monkeypatch):
    """texts are worked on in joined blocks, long ones cut; terms may carry a hash past the prime."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(kind) for _ in range(n)) for kind in ("ab c", "aé ", "é中👍İz\x00\x7f\x80", "中") for n in (7, 8, 9, 40, 200, 300)] + [None, "", " a b "]
    for block in (16, 64, P.BLOCK):
        monkeypatch.setattr(P, "BLOCK", block)
        assert P.signatures(texts) == list(map(plain_signature, texts))
    hashes = [P.PRIME - 1, P.PRIME - 41, 5, 0, P.PRIME - 3]
    want = [[min((h * f + t) % P.PRIME for h in some) for f, t in zip(P.FACTORS, P.TERMS, strict=True)] for some in (hashes[:2], hashes[2:])]
    assert P._least(np.array(hashes, dtype=np.uint64), [0, 2, 2, 5]).tolist() == want


def test_mirror_pairs_of_one_hot_half(spark, monkeypatch):
    """signatures are worked out once, and what meets is a pair of the result, not all that share a half."""
    rng = random.Random(6)
    signs = [[1] * 6 + [rng.randint(0, 2) for _ in range(6)] for _ in range(200)] + [[1] * 6 + [100 * i + k for k in range(6)] for i in range(200)] + [[i] + [7] * 11 for i in range(40)]
    monkeypatch.setattr(M.P, "signature", F.pandas_udf(lambda s: s.map(json.loads), "array<long>"))
    df = spark.createDataFrame([(i, str(s)) for i, s in enumerate(signs)], "id long, text string")
    least = {}
    for i, s in enumerate(signs):
        least.setdefault(tuple(s), i)
    want = [(a, b) for (x, a), (y, b) in itertools.combinations(least.items(), 2) if sum(p == q for p, q in zip(x, y, strict=True)) == 11]
    want = sorted([tuple(sorted(p)) for p in want] + [(least[tuple(s)], i) for i, s in enumerate(signs) if least[tuple(s)] != i])
    for rows in (R.KEY_ROWS, 3):
        monkeypatch.setattr(R, "KEY_ROWS", rows)
        found = R.mirror_pairs(df, 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == want and "EvalPython" not in plan and "h#" not in plan


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100 + 2 * k, 100) for k in range(1, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = M.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {n: r for n, r in closure(set(itertools.chain.from_iterable(edges)), edges).items() if n in nodes}
    assert M.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spans(spark):
    rng = random.Random(4)
    spans = [(k, b := rng.randint(0, 3000), b + rng.choice([0, 1, 2, 15, 16, 17, 300, 5000, 10**12])) for k in range(150)] + [(999, 2**40, 2**40 + 5)]
    rows = [(rng.choice([rng.randint(0, 4000), 2**40 + 2]), "x") for _ in range(400)] + [(None, "n")]
    df, sp = spark.createDataFrame(rows, "row long, note string"), spark.createDataFrame(spans, "span long, start_row long, end_row long")
    joined = G.span_join(df, sp)
    got = sorted((r.row, r.span) for r in joined.collect())
    assert got == sorted((r, k) for r, _ in rows if r is not None for k, b, e in spans if b <= r < e)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert G.span_join(df, sp.limit(0)).count() == 0


def test_a_later_stretch_replaces_an_earlier_one(spark):
    names = ["a", "a", "b", "a", None, None, "b", "b", "c", None]
    rows = spark.createDataFrame(list(enumerate(names)), "row long, source string")
    assert {(r.source, r.start_row, r.end_row) for r in G.last_runs(rows).collect()} == {("a", 3, 4), ("b", 6, 8), ("c", 8, 9), (None, 9, 10)}


def read_files(df):
    """The files whose rows a scan gives."""
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_fetch_and_narrowing_read_wanted_folders_alone(spark):
    rows = spark.range(1000).select(F.col("id").alias("row"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    laid = G.lay_out(rows, 50)
    wanted = spark.createDataFrame([(7, 1), (8, 2), (951, 3), (7, 4), (2000, 5)], "row long, rank int")
    got = G.late_fetch(laid, wanted, 50)
    assert sorted((r.rank, r.row, r.text) for r in got.collect()) == [(1, 7, "text 7"), (2, 8, "text 8"), (3, 951, "text 951"), (4, 7, "text 7")]
    scan = G._parts(laid, wanted.withColumn("_part", F.floor(F.col("row") / 50).cast("long")))
    assert (read_files(laid), read_files(scan)) == (20, 2)
    spans = spark.createDataFrame([(10, 60), (55, 120), (100, 130), (400, 400), (990, 1000)], "start_row long, end_row long")
    merged = G.merged_spans(spans, 50)
    assert sorted(r.row for r in G.narrowed(laid, merged, 50).collect()) == [*range(10, 130), *range(990, 1000)]
    assert "PartitionFilters: [isnotnull(_part" in got._jdf.queryExecution().executedPlan().toString() or "_part" in str(got._jdf.queryExecution().executedPlan())


def test_more_parts_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(G, "LISTED", 2)
    laid = G.lay_out(spark.range(100).select(F.col("id").alias("row"), F.col("id").alias("text")), 10)
    wanted = spark.range(0, 100, 9).select(F.col("id").alias("row"))
    assert sorted(r.text for r in G.late_fetch(laid, wanted, 10).collect()) == list(range(0, 100, 9))


def test_folders_do_not_grow_with_the_rows(spark, monkeypatch):
    """a folder for each stretch made thousands of files of a few rows each."""
    monkeypatch.setattr(G, "FOLDERS", 4)
    rows = [*range(0, 300), *range(10**12, 10**12 + 40), *range(-30, 0)]
    assert (G.stretch_size(spark.range(1000), 10), G.stretch_size(spark.range(1000), 300)) == (250, 300)
    laid = G.lay_out(spark.createDataFrame([(r, f"text {r}") for r in rows], "row long, text string"), 10)
    assert read_files(laid) == 4 and sorted(r.row for r in laid.collect()) == sorted(rows)
    wanted = spark.createDataFrame([(r,) for r in (5, 45, 5, 299, 10**12 + 39, -30, 300)], "row long")
    assert sorted(r.text for r in G.late_fetch(laid, wanted, 10).collect()) == sorted(f"text {r}" for r in (5, 45, 5, 299, 10**12 + 39, -30))
    spans = spark.createDataFrame([(-12, 3), (38, 81), (10**12 + 5, 10**12 + 25)], "start_row long, end_row long")
    assert sorted(r.row for r in G.narrowed(laid, G.merged_spans(spans, 10), 10).collect()) == [*range(-12, 3), *range(38, 81), *range(10**12 + 5, 10**12 + 25)]


@pytest.mark.parametrize("sample", [20_000, 5])
def test_quantized_is_exact(spark, sample):
    """Bounds from five rows leave most numbers outside: the search is exact all the same."""
    rng = np.random.default_rng(6)
    v = np.concatenate((rng.standard_normal((300, 12)), 50 * rng.standard_normal((3, 12)), np.zeros((2, 12)), np.repeat(rng.standard_normal((1, 12)), 20, axis=0)))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "row long, embedding array<double>")
    queries = df.where("row % 40 = 0").select(F.col("row").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in Z.topk(df, queries, 9, sample).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.row))
    for q in range(0, len(v), 40):
        scores = np.round(v @ v[q], 6)
        assert [row for _, row in sorted(got[q])] == sorted(range(len(v)), key=lambda i: (-scores[i], i))[:9], q


def test_index_delta(spark, tmp_path):
    derive = lambda f: f.select("path", F.length("text").alias("n"))
    files = lambda rows: spark.createDataFrame(rows, "path string, text string")
    old = [(f"p{k}", "x" * k) for k in range(200)]
    index = Index(spark, str(tmp_path), derive, 32)
    assert index.read().count() == 0
    assert index.update(files(old)) == {"added": 200, "changed": 0, "removed": 0, "same": 0, "buckets_written": 32}
    assert index.update(files(old))["buckets_written"] == 0 and index.generation() == 1
    new = [*old[1:150], ("p150", "changed"), *old[151:], ("q", None)]
    done = index.update(files(new))
    assert (done["added"], done["changed"], done["removed"], done["same"]) == (1, 1, 1, 198) and 0 < done["buckets_written"] <= 3
    want = sorted((p, None if t is None else len(t)) for p, t in new)
    assert sorted(map(tuple, index.read().select("path", "n").collect())) == want
    (tmp_path / "manifest" / "3").mkdir()  # an update that broke off
    assert index.generation() == 2 and sorted(map(tuple, index.read().select("path", "n").collect())) == want
    index.vacuum()
    assert sorted(map(tuple, index.read().select("path", "n").collect())) == want and not (tmp_path / "manifest" / "1").exists()
    index.update(files([]))
    assert index.read().count() == 0


def test_golden_judging(spark):
    golden = [(1, "positive", ["a/b/", "zz"], None), (2, "positive", None, ["x\\y.md", "x/y.md"]), (3, "negative", [], []), (4, "mismatch", ["m"], []), (5, "positive", [""], []), (6, "mismatch", None, None)]
    results = [(1, 1, "a/c"), (1, 2, "a\\b\\d"), (1, 3, "a/b"), (2, 1, "x/y.md.bak"), (2, 2, "x/y.md"), (3, 1, "q"), (4, 1, "n"), (5, 1, None), (5, 2, ""), (5, 3, "any"), (1, 4, "zzz/long")]
    g = spark.createDataFrame(golden, "query_id int, label string, prefixes array<string>, sources array<string>")
    r = spark.createDataFrame(results, "query_id int, rank int, source string")
    same = r.join(g, "query_id").select("query_id", "rank", E.relevant(F.col("source"), F.col("prefixes"), F.col("sources")).alias("rel"))
    assert sorted(map(tuple, E.judged(r, g).select("query_id", "rank", "rel").collect())) == sorted(map(tuple, same.collect()))
    got = {x.query_id: (x.first, x.reciprocal, x.outcome) for x in E.golden_report(r, g).collect()}
    assert got == {1: (2, 0.5, None), 2: (2, 0.5, None), 3: (None, None, "leaked"), 4: (None, None, "neighbour"), 5: (3, 0.333333, None), 6: (None, None, "no-neighbour")}


def test_pages(spark):
    keys = [(f"k{i:03}",) for i in range(23)] * 2 + [(None,)]
    got = sorted(map(tuple, B.listing_pages(spark.createDataFrame(keys, "k string"), "k", 10).collect()))
    assert got == [(0, 10, "k000", "k010"), (1, 10, "k010", "k020"), (2, 3, "k020", None)]
    rows = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(9)], "row long, source string")
    spans = spark.createDataFrame([("a", 0, 7), ("b", 7, 9)], "source string, start_row long, end_row long")
    assert sorted(map(tuple, B.document_pages(rows, spans, 3).collect())) == [("a", 0, 3, 0, 2, 3), ("a", 1, 3, 3, 5, 6), ("a", 2, 1, 6, 6, None), ("b", 0, 2, 7, 8, None)]


def test_template_lists(spark):
    rows = [("n", 2, ["c", "a", "d"], []), ("n", 1, ["a", "b", "a"], ["x"]), (None, 1, None, ["z", "z"]), ("m", 1, [], None)]
    got = {r.name: (r.tags, r.urls) for r in I.merged_lists(spark.createDataFrame(rows, "name string, at int, tags array<string>, urls array<string>"), ["name"], "at", ["tags", "urls"]).collect()}
    assert got == {"n": (["a", "b", "c", "d"], ["x"]), None: ([], ["z"]), "m": ([], [])}
    names = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    actions = lambda over: {r.path: r.action for r in I.init_actions(names("a", "b", "m"), names("b", "m", "m"), over, ["m"]).collect()}
    assert actions(False) == {"a": "copied", "b": "skipped", "m": "merged"} and actions(True)["b"] == "overwritten"
    assert {r.action: r.files for r in I.init_summary(I.init_actions(names("a"), names(), False, [])).collect()} == {"copied": 1, "overwritten": 0, "skipped": 0, "merged": 0}
