"""Documents to tokens: language, near duplicates, benchmark passages, secrets, encoding.

Every stage takes any extra columns along and reads doc_id and text of what its predecessor kept; null texts pass
every filter but the first. The stages but the last return the columns they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import bpe, decontam, jaccard, langid, secrets
from veinstone.llm.common import Tables, table

ORACLE_SQL = None  # no stage but the fourth's counts can be told in SQL; tests hold the stages against brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null, empty and letterless texts go. Repeated rows stay; no rows give no rows."""
    model = langid.learn(docs.where(~langid.held_out()))
    shown = langid.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text")), model)
    return shown.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, by smallest doc_id; jaccard.keep_one states nulls, ties and repeats."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate; the verdict follows the text, so null and repeated ids don't matter."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars brought up to date; null and empty texts stay as they are."""
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids of each document; null and empty texts have no tokens."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again; the last table stays."""
    tables, docs, before = Tables(spark), table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        docs = tables.write(name, stage(spark, docs, sf_dir))
        if before:
            tables.drop(before)
        before = name
    return docs
