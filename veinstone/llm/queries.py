"""The operators' queries and SQL, for the entry module to add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, crosstok, decontam, htmltext, jaccard, langid, lcparse, licenses, nearest, secrets, tokencount
from .common import table


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("secrets.n_candidates").alias("n_candidates"), F.size("secrets.findings").alias("n_findings"), F.col("secrets.findings").alias("findings"), F.sha2("secrets.masked", 256).alias("masked_sha256"))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under two edits: a sentence put in at its middle, then its first ten characters deleted."""
    import public_tokenizers

    middle = F.coalesce(F.length("text"), F.lit(0)).cast("long") / 2
    edit = lambda seq, begin, end, text: F.struct(F.lit(seq).cast("long").alias("seq"), begin.cast("long").alias("begin"), end.cast("long").alias("end"), F.lit(text).alias("text"))
    docs = table(spark, sf_dir, "documents").withColumn("edits", F.array(edit(1, F.floor(middle), F.floor(middle), " An inserted sentence. "), edit(2, F.lit(0), F.lit(10), "")))
    return tokencount.counts(docs, None, public_tokenizers.path("word_bpe_49k.json"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.fold(chat.events(rows)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return crosstok.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcparse.compare(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest, "op2_language_id": op2_language_id, "op3_bpe": op3_bpe, "op4_decontamination": op4_decontamination, "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format, "op7_html_extraction": op7_html_extraction, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_license_scan": op9_license_scan, "op10_secret_scan": op10_secret_scan,
    "op11_cross_tokenizer": op11_cross_tokenizer, "op12_filter_audit": op12_filter_audit, "op13_fingerprints": op13_fingerprints,
}
SQL: dict[str, str] = {
    "op6_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + (len(role || text) - len(translate(role || text, '\<>', ''))) + 16) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op9_license_scan": licenses.sql(),
    "op12_filter_audit": audit.sql(),
}
