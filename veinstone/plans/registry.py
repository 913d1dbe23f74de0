"""Queries of the retrieval operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import browse as B
from ..operators import retrieval as R
from ..sources import CHUNKS_SQL, chunks, numbered, table

Q, SQL = {}, {}
DOT = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
EXAMPLES = (7, 42, 123)


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).drop("vec_id", "label")


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id").isin(*EXAMPLES)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS rank FROM (
SELECT q.vec_id AS query_id, c.doc_id, round({DOT.format('e.embedding', 'q.embedding')}, 6) AS dense
FROM {CHUNKS_SQL} c JOIN embeddings e ON c.doc_id = e.vec_id, embeddings q WHERE q.vec_id IN {EXAMPLES})) WHERE rank <= 20""")
def dense_batch_topk(spark, d):
    return R.dense_topk(_vectors(spark, d), _examples(spark, d), 20)


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS rank FROM (
SELECT q.vec_id AS query_id, c.doc_id, round({DOT.format('e.embedding', 'q.embedding')}, 6) AS dense
FROM {CHUNKS_SQL} c JOIN embeddings e ON c.doc_id = e.vec_id, embeddings q WHERE q.vec_id IN {EXAMPLES} AND starts_with(c.path, 'src7/'))) WHERE rank <= 10""")
def dense_topk_filtered(spark, d):
    return R.dense_topk(_vectors(spark, d).where(R.path_filter(F.col("path"), category="src7")), _examples(spark, d), 10)


@query("""SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(round_even(x / scale, 0) AS INTEGER)), ',') AS q
FROM (SELECT *, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127 AS scale FROM embeddings)""")
def quantize_int8(spark, d):
    e = table(spark, d, "embeddings").withColumn("s", V.int8_scale(F.col("embedding")))
    return e.select("vec_id", F.round("s", 9).alias("scale"), F.array_join(V.int8(F.col("embedding"), F.col("s")).cast("array<string>"), ",").alias("q"))


_FILTERS = {
    "filter_category": ({"category": "src3"}, "starts_with(path, 'src3/')"), "filter_prefix": ({"source_prefix": "src1"}, "starts_with(path, 'src1')"),
    "filter_source": ({"source": "src7/en/2007/doc-7.md"}, "path = 'src7/en/2007/doc-7.md'"), "filter_year": ({"year": 2014}, "regexp_matches(path, '(?:^|[^0-9])2014(?:[^0-9]|$)')"),
    "filter_exclude": ({"exclude": ["src1/", "/src2"]}, "NOT starts_with(path, 'src1') AND NOT starts_with(path, 'src2')"), "filter_combo": ({"category": "src4", "year": 2004, "exclude": ["src4/fr"]}, "starts_with(path, 'src4/') AND regexp_matches(path, '(?:^|[^0-9])2004(?:[^0-9]|$)') AND NOT starts_with(path, 'src4/fr')"),
}
for _name, (_filter, _sql) in _FILTERS.items():
    Q[_name] = lambda spark, d, f=_filter: chunks(spark, d).where(R.path_filter(F.col("path"), **f)).select("doc_id", "path")
    SQL[_name] = f"SELECT doc_id, path FROM {CHUNKS_SQL} WHERE {_sql}"

_IDS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._+:-]*'), lambda t: len(t) >= 4 AND regexp_matches(t, '[0-9]')))"


@query(f"SELECT doc_id, array_to_string(list_sort({_IDS}), ' ') AS ids FROM documents")
def identifier_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.identifiers(F.coalesce("text", F.lit("")))), " ").alias("ids"))


@query(f"SELECT token, count(*) AS df, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM (SELECT doc_id, unnest({_IDS}) AS token FROM documents) GROUP BY token HAVING count(*) <= 500")
def postings_build(spark, d):
    return R.postings(chunks(spark, d)).withColumn("docs", F.array_join(F.col("docs").cast("array<string>"), ","))


@query(f"SELECT row_number() OVER (ORDER BY path, doc_id) - 1 AS row, doc_id, path FROM {CHUNKS_SQL}")
def row_numbers(spark, d):
    return numbered(chunks(spark, d).select("doc_id", "path"), "path", "doc_id").select("row", "doc_id", "path")


@query("SELECT source, CAST(sum(n) OVER (ORDER BY source) - n AS BIGINT) AS start_row, CAST(sum(n) OVER (ORDER BY source) AS BIGINT) AS end_row FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def source_spans(spark, d):
    return B.spans(table(spark, d, "documents"))


@query(f"SELECT split_part(path, '/', 1) AS category, count(*) AS documents, min(path) AS first_path FROM {CHUNKS_SQL} GROUP BY 1")
def corpus_index(spark, d):
    return chunks(spark, d).groupBy(F.split("path", "/")[0].alias("category")).agg(F.count("*").alias("documents"), F.min("path").alias("first_path"))


@query(f"SELECT DISTINCT path FROM {CHUNKS_SQL} WHERE path >= 'src12/en' ORDER BY path LIMIT 26")
def listing_page(spark, d):
    return chunks(spark, d).where(F.col("path") >= "src12/en").select("path").distinct().orderBy("path").limit(26)


_TERMS = ["the", "licensed", "src7"]
_HIT = lambda c, t: f"CAST(regexp_matches(lower({c}), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"
_LEX = f"""m AS (SELECT doc_id, path, source, text, {', '.join(f"{_HIT('text', t)} AS b{i}, {_HIT('path', t)} AS p{i}" for i, t in enumerate(_TERMS))} FROM {CHUNKS_SQL} WHERE text IS NOT NULL),
w AS (SELECT {', '.join(f"power(ln((count(*) + 1) / (sum(b{i} + p{i}) + 0.5)), 2) AS w{i}" for i in range(3))} FROM m),
l AS (SELECT m.*, least(1.0, 0.45 * (w0*b0 + w1*b1 + w2*b2) / (w0 + w1 + w2) + 0.55 * (w0*p0 + w1*p1 + w2*p2) / (w0 + w1 + w2)) AS lexical FROM m, w)"""


def _lexical(spark, d):
    return R.lexical_scores(chunks(spark, d).where(F.col("text").isNotNull()), _TERMS)


@query(f"WITH {_LEX} SELECT doc_id, round(lexical, 6) AS lexical FROM l")
def lexical_score(spark, d):
    return _lexical(spark, d).select("doc_id", F.round("lexical", 6).alias("lexical"))


_FUSED = f"f AS (SELECT l.doc_id, path, source, round(0.65 * greatest(0.0, {DOT.format('e.embedding', 'q.embedding')}) + 0.35 * lexical, 6) AS score FROM l JOIN embeddings e ON l.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 7)"


@query(f"WITH {_LEX}, {_FUSED} SELECT doc_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM f WHERE score >= 0.2) WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 5")
def hybrid_search(spark, d):
    """The flagship: exact dense and lexical scores, fused, gated, one row of each source, the five best."""
    q = F.broadcast(table(spark, d, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("query")))
    scored = _lexical(spark, d).join(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("doc_id") == F.col("vec_id")).crossJoin(q)
    fused = scored.withColumn("score", F.round(R.fuse(V.dot(F.col("embedding"), F.col("query")), F.col("lexical")), 6)).where("score >= 0.2")
    return R.best_per_source(fused, "source", "score", "doc_id", 5).select("doc_id", "path", "score")


_W = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_LINES = rf"list_filter(list_transform(regexp_split_to_array(t, '[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_W}+|{_W}+$', '', 'g')), lambda x: x <> '')"
_LOW = rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT *, regexp_replace(t, '{_W}', '', 'g') AS bare, {_LINES} AS lines FROM a)
SELECT doc_id, CASE WHEN bare = '' THEN 'empty' ELSE concat_ws(',',
  CASE WHEN length(bare) >= 120 AND len(list_distinct(string_split(bare, ''))) <= 12 THEN 'repetitive' END,
  CASE WHEN length(t) >= 200 AND length(bare) < 0.15 * length(t) THEN 'sparse' END,
  CASE WHEN length(t) >= 100 AND NOT regexp_matches(t, '[A-Za-z\x{{4e00}}-\x{{9fff}}]') THEN 'numeric' END,
  CASE WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: regexp_matches(x, '(?i)^([-*]{_W}+)?(https?://|\[[^\]]+\]\(https?://)'))) / len(lines) >= 0.6 THEN 'link-heavy' END,
  CASE WHEN NOT regexp_matches(t, '[0-9A-Za-z\x{{4e00}}-\x{{9fff}}]') THEN 'no-text' END,
  CASE WHEN len(lines) >= 3 AND len(list_filter(lines, lambda x: length(x) >= 64 AND regexp_full_match(x, '[A-Za-z0-9+/]+=?=?'))) / len(lines) >= 0.5 THEN 'blob-heavy' END) END AS reasons FROM b"""


@query(_LOW)
def low_information(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.low_information(F.col("text")), ",").alias("reasons"))


def _redacted_sql(t: str) -> str:
    """Redaction with a captured character in place of the look-behind."""
    t = f"regexp_replace({t}, '(?is)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----', '<REDACTED_PRIVATE_KEY>', 'g')"
    t = rf"regexp_replace({t}, '(?i)(^|[^\p{{L}}\p{{N}}_])((?:authorization{_W}*:{_W}*bearer|bearer){_W}+)[A-Za-z0-9._~+/=-]{{8,}}', '\1\2<REDACTED>', 'g')"
    secret = rf"(?i)(^|[^\p{{L}}\p{{N}}_])((?:api[_-]?key|secret[_-]?key|access[_-]?token|token|password|passwd|cookie){_W}*[:=]{_W}*[\x22\x27]?)([^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}\x22\x27]{{4,}})"
    return rf"regexp_replace({t}, '{secret}', '\1\2<REDACTED>', 'g')"


@query(f"SELECT doc_id, sha256({_redacted_sql("coalesce(text, '')")}) AS redacted_sha256 FROM documents")
def redact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.coalesce("text", F.lit(""))), 256).alias("redacted_sha256"))


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def sha_manifest(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def history_trim(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 4").select("conv_id", "turn", "role", "text")


_RANKED = f"""r AS (SELECT query_id, rank, rel FROM (SELECT q.vec_id AS query_id, CAST(e.label = q.label AS INT) AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({DOT.format('e.embedding', 'q.embedding')}, 6) DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id IN {EXAMPLES} AND e.vec_id <> q.vec_id) WHERE rank <= 10)"""


@query(f"WITH {_RANKED} SELECT count(*) AS queries, avg(CAST(coalesce(first, 0) = 1 AS DOUBLE)) AS top1, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM (SELECT query_id, min(rank) FILTER (rel = 1) AS first FROM r GROUP BY query_id)")
def eval_top1_mrr(spark, d):
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where(F.col("vec_id").isin(*EXAMPLES)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("wanted")))
    scored = e.crossJoin(q).where("vec_id <> query_id").withColumn("dense", F.round(V.dot(F.col("embedding"), F.col("query")), 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense"), "vec_id"))).where("rank <= 10")
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("first"))
    return first.agg(F.count("*").alias("queries"), F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")).alias("top1"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
