"""Queries of the corpus-wide operators with their SQL: spans, layouts, quantizer, mirrors, upkeep, golden sets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assemble as A
from ..functions import text as T
from ..operators import browse as B
from ..operators import evaluation as E
from ..operators import ingest as I
from ..operators import mirrors as M
from ..operators import quantized as Z
from ..operators import ranges as G
from ..operators import retrieval as R
from ..operators.delta import Index
from ..sources import CHUNKS_SQL, chunks, numbered, table
from ..sources.shared import shared_folder
from .registry import _IDS, _W, DOT, SQL, Q, query  # noqa: F401

PARTS = 64  # rows of a stretch in the small tables that queries run on; larger tables have longer ones


def _by_id(spark: SparkSession, d: str) -> DataFrame:
    """row, doc_id, source: documents in order of their ids, so that every source reappears again and again."""
    return numbered(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("row", "doc_id", "source")


_BY_ID = "(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, doc_id, source FROM documents)"
_LAST = f"""(SELECT source, max(start_row) AS start_row, max_by(end_row, start_row) AS end_row FROM (SELECT source, min(row) AS start_row, max(row) + 1 AS end_row
FROM (SELECT *, row - row_number() OVER (PARTITION BY source ORDER BY row) AS run FROM {_BY_ID}) GROUP BY source, run) GROUP BY source)"""


@query(f"SELECT source, start_row, end_row FROM {_LAST}")
def last_runs(spark, d):
    return G.last_runs(_by_id(spark, d))


@query(f"SELECT r.row, r.doc_id, s.source AS span_source, s.start_row, s.end_row FROM {_BY_ID} r JOIN (SELECT source, greatest(start_row - 3 * length(source), 0) AS start_row, end_row + length(source) AS end_row FROM {_LAST}) s ON r.row >= s.start_row AND r.row < s.end_row")
def span_interval_join(spark, d):
    """Every source's last stretch with rows around it: spans overlap, and rows stand in several."""
    rows = _by_id(spark, d)
    spans = G.last_runs(rows).select(F.col("source").alias("span_source"), F.greatest(F.col("start_row") - 3 * F.length("source"), F.lit(0)).alias("start_row"), (F.col("end_row") + F.length("source")).alias("end_row"))
    return G.span_join(rows.select("row", "doc_id"), spans)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_TOP = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, row) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id AS row, round({DOT.format('e.embedding', 'q.embedding')}, 6) AS dense FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 20)"""


@query(f"SELECT query_id, row, dense, rank FROM {_TOP}")
def quantized_topk(spark, d):
    return Z.topk(_vectors(spark, d), _queries(spark, d), 20)


@query(f"SELECT t.query_id, t.rank, t.row, sha256(c.text) AS sha FROM {_TOP} t JOIN {CHUNKS_SQL} c ON c.doc_id = t.row")
def late_fetch(spark, d):
    """Ranks first, texts after: the texts of the ranked rows alone are read."""
    texts = chunks(spark, d).select(F.col("doc_id").alias("row"), "text")
    size = G.stretch_size(texts, PARTS)
    ranked = Z.topk(_vectors(spark, d), _queries(spark, d), 20)
    return G.late_fetch(G.lay_out(texts, size), ranked.select("query_id", "rank", "row"), size).select("query_id", "rank", "row", F.sha2("text", 256).alias("sha"))


_PLACED = f"(SELECT row_number() OVER (ORDER BY path, doc_id) - 1 AS row, path AS source, embedding FROM {CHUNKS_SQL} c JOIN embeddings e ON c.doc_id = e.vec_id)"


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, row) AS rank FROM (SELECT q.vec_id AS query_id, p.row, round({DOT.format('p.embedding', 'q.embedding')}, 6) AS dense
FROM {_PLACED} p, embeddings q WHERE q.vec_id % 100 = 0 AND (starts_with(p.source, 'src4/') OR starts_with(p.source, 'src5/')) AND NOT starts_with(p.source, 'src4/fr'))) WHERE rank <= 1200""")
def narrowed_topk(spark, d):
    """The pool under filters: they see paths, and vectors are read from the folders that hold the rows left."""
    rows = numbered(chunks(spark, d).join(_vectors(spark, d), F.col("doc_id") == F.col("row")).select("doc_id", F.col("path").alias("source"), "embedding"), "source", "doc_id")
    sources = rows.groupBy("source").agg(F.min("row").alias("start_row"), (F.max("row") + 1).alias("end_row"))
    accepted = (R.path_filter(F.col("source"), category="src4") | R.path_filter(F.col("source"), category="src5")) & R.path_filter(F.col("source"), exclude=["src4/fr"])
    size = G.stretch_size(rows, PARTS)
    return G.narrowed_topk(G.lay_out(rows.select("row", "embedding"), size), sources, accepted, _queries(spark, d), G.NARROWED, size)


_SEAM = """(SELECT doc_id, left(t, 400) AS a, substring(t, CAST(least(400, length(t)) - doc_id % 350 + 1 AS BIGINT)) AS b FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE length(t) >= 400)"""


@query(rf"""WITH s AS (SELECT *, string_split(a, chr(10)) AS x, string_split(b, chr(10)) AS y, right(a, 300) AS tail FROM {_SEAM}),
n AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(x), len(y), 10) + 1), lambda k: x[len(x) - k + 1:] = y[1:k])), 0) AS run, coalesce(list_max(list_filter(range(12, least(length(tail), length(b)) + 1), lambda k: ends_with(tail, left(b, k)))), 0) AS same FROM s),
r AS (SELECT doc_id, a, b, CASE WHEN run > 1 OR (run = 1 AND length(y[1]) >= 25) THEN CASE WHEN regexp_replace(array_to_string(y[run + 1:], chr(10)), '{_W}', '', 'g') = '' THEN '' ELSE chr(10) || array_to_string(y[run + 1:], chr(10)) END ELSE substring(b, same + 1) END AS rest FROM n)
SELECT doc_id, CASE WHEN b = '' OR rest = '' THEN a ELSE a || chr(10) || chr(10) || rest END AS text FROM r""")
def seam_merge(spark, d):
    """The first 400 characters of each text and what follows them, but for up to 349 characters that stand in both, as one."""
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", t.alias("t")).where(F.length("t") >= 400)
    begin = (F.least(F.lit(400), F.length("t")) - i % 350 + 1).cast("int")
    pieces = F.array(F.left("t", F.lit(400)), F.substring(F.col("t"), begin, F.length("t")))
    return docs.select("doc_id", A.joined(pieces).alias("text"))


@query()
def mirror_clusters(spark, d):
    return M.clusters(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"SELECT path, sha256(coalesce(text, '')) AS digest, array_to_string(list_sort({_IDS}), ' ') AS ids FROM (SELECT path, doc_id, CASE WHEN doc_id % 50 = 0 THEN coalesce(text, '') || ' changed' ELSE text END AS text FROM {CHUNKS_SQL} WHERE doc_id % 7 <> 0)")
def index_delta(spark, d):
    """An index of most files, brought up to a state in which some came, some went and some have another text."""
    files = chunks(spark, d).select("doc_id", "path", "text")
    derive = lambda f: f.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.array_join(F.array_sort(T.identifiers(F.coalesce("text", F.lit("")))), " ").alias("ids"))
    index = Index(spark, f"{shared_folder(spark)}/index-{spark.sql('SELECT uuid()').first()[0]}", derive)
    index.update(files.where("doc_id % 11 <> 0").select("path", "text"))
    text = F.when(F.col("doc_id") % 50 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text")).alias("text")
    index.update(files.where("doc_id % 7 <> 0").select("path", text))
    return index.read()


_GOLD = """(SELECT vec_id AS query_id, CASE WHEN vec_id % 1000 = 300 THEN 'negative' WHEN vec_id % 1000 = 700 THEN 'mismatch' ELSE 'positive' END AS label,
CASE WHEN vec_id % 200 = 0 THEN ['src' || CAST(vec_id % 7 AS VARCHAR) || '/', 'src1'] ELSE ['src' || CAST(vec_id % 9 AS VARCHAR) || '/en/20'] END AS prefixes,
['src' || CAST((vec_id + 3) % 20 AS VARCHAR) || '/en/' || CAST(2000 + (vec_id + 3) % 25 AS VARCHAR) || '/doc-' || CAST(vec_id + 3 AS VARCHAR) || '.md'] AS sources FROM embeddings WHERE vec_id % 100 = 0)"""
_FOUND = f"(SELECT t.query_id, t.rank - 1 AS rank, c.path AS source FROM {_TOP} t JOIN {CHUNKS_SQL} c ON c.doc_id = t.row WHERE t.rank > 1)"


def _golden(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    label = F.when(i % 1000 == 300, "negative").when(i % 1000 == 700, "mismatch").otherwise("positive")
    text = lambda c: c.cast("string")
    prefixes = F.when(i % 200 == 0, F.array(F.concat(F.lit("src"), text(i % 7), F.lit("/")), F.lit("src1"))).otherwise(F.array(F.concat(F.lit("src"), text(i % 9), F.lit("/en/20"))))
    sources = F.array(F.concat(F.lit("src"), text((i + 3) % 20), F.lit("/en/"), text(2000 + (i + 3) % 25), F.lit("/doc-"), text(i + 3), F.lit(".md")))
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(i.alias("query_id"), label.alias("label"), prefixes.alias("prefixes"), sources.alias("sources"))


@query(f"""WITH g AS {_GOLD}, f AS {_FOUND}, j AS (SELECT f.*, list_contains(g.sources, f.source) OR len(list_filter(g.prefixes, lambda p: starts_with(f.source, p) OR f.source = rtrim(p, '/'))) > 0 AS rel FROM f JOIN g USING (query_id)),
a AS (SELECT g.query_id, g.label, min(j.rank) FILTER (j.rel) AS first, count(j.rank) AS n FROM g LEFT JOIN j USING (query_id) GROUP BY ALL)
SELECT query_id, label, CASE WHEN label = 'positive' THEN coalesce(first, 0) ELSE 0 END AS first, CASE WHEN label = 'positive' THEN round(coalesce(1.0 / first, 0), 6) ELSE 0 END AS reciprocal,
CASE label WHEN 'negative' THEN CASE WHEN n > 0 THEN 'leaked' ELSE 'blocked' END WHEN 'mismatch' THEN CASE WHEN n > 0 THEN 'neighbour' ELSE 'no-neighbour' END END AS outcome FROM a""")
def golden_eval(spark, d):
    """A golden set over the embeddings: prefixes and exact sources, negatives and mismatches, judged on the ranked sources."""
    named = chunks(spark, d).select(F.col("doc_id").alias("row"), F.col("path").alias("source"))
    found = Z.topk(_vectors(spark, d), _queries(spark, d), 20).where("rank > 1").join(named, "row").select("query_id", (F.col("rank") - 1).alias("rank"), "source")
    return E.golden_report(found, _golden(spark, d)).fillna(0, ["first", "reciprocal"])


@query(f"""SELECT page, count(*) AS entries, min(path) AS first, lead(min(path)) OVER (ORDER BY page) AS next_cursor FROM (SELECT path, (row_number() OVER (ORDER BY path) - 1) // 25 AS page FROM (SELECT DISTINCT path FROM {CHUNKS_SQL})) GROUP BY page""")
def listing_pages(spark, d):
    return B.listing_pages(chunks(spark, d), "path", 25)


@query("""SELECT source, k // 10 AS page, count(*) AS chunks, min(row) AS first_row, max(row) AS last_row, CASE WHEN max(k) + 1 < max(n) THEN max(row) + 1 ELSE -1 END AS next_row
FROM (SELECT source, row_number() OVER (ORDER BY source, doc_id) - 1 AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source, k // 10""")
def document_pages(spark, d):
    rows = numbered(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")
    return B.document_pages(rows, rows.groupBy("source").agg(F.min("row").alias("start_row"), (F.max("row") + 1).alias("end_row")), 10).fillna(-1, ["next_row"])



@query("""WITH i AS (SELECT source AS name, lang AS category, doc_id AS version, generate_subscripts(w, 1) AS k, unnest(w) AS item FROM (SELECT source, lang, doc_id, string_split(coalesce(text, ''), ' ')[1:5] AS w FROM documents)),
f AS (SELECT name, category, item, min((version, k)) AS first FROM i GROUP BY ALL) SELECT name, category, array_to_string(list(item ORDER BY first), ' ') AS tags FROM f GROUP BY ALL""")
def template_merge(spark, d):
    """Every document is a manifest of its source and language, whose list are its first five words: all of them folded in order."""
    tags = F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 5).alias("tags")
    made = table(spark, d, "documents").select(F.col("source").alias("name"), F.col("lang").alias("category"), F.col("doc_id").alias("version"), tags)
    return I.merged_lists(made, ["name", "category"], "version", ["tags"]).withColumn("tags", F.array_join("tags", " "))


@query(f"""WITH t AS (SELECT path FROM {CHUNKS_SQL}), r AS (SELECT path FROM {CHUNKS_SQL} WHERE doc_id % 3 <> 0), a AS (SELECT t.path, CASE WHEN r.path IS NULL THEN 'copied' WHEN starts_with(t.path, 'src7/en/2007/doc-7.') THEN 'merged' ELSE 'skipped' END AS action FROM t LEFT JOIN r ON t.path = r.path)
SELECT n.action, count(a.path) AS files FROM (SELECT unnest(['copied', 'overwritten', 'skipped', 'merged']) AS action) n LEFT JOIN a ON a.action = n.action GROUP BY n.action""")
def init_summary(spark, d):
    files = chunks(spark, d)
    return I.init_summary(I.init_actions(files.select("path"), files.where("doc_id % 3 <> 0").select("path"), overwrite=False, merge=["src7/en/2007/doc-7.md"]))
