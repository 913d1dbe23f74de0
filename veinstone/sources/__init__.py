"""Sources: Parquet tables, JSON lines, file trees and text trees; the chunk table made from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded
from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str = "text string, metadata map<string,string>") -> DataFrame:
    """Chunk lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def first_field(metadata: Column, *keys: str) -> Column:
    """The first of some keys whose value isn't empty."""
    return F.coalesce(*[F.nullif(F.element_at(metadata, F.lit(k)), F.lit("")) for k in keys])


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """id, source and text of chunk lines; the source is the first that its metadata name."""
    rows = json_lines(spark, path)
    m = F.col("metadata")
    return rows.where("text IS NOT NULL").select(first_field(m, "id", "chunk_id").alias("id"), F.translate(first_field(m, "source", "source_path", "file_name", "filename"), "\\", "/").alias("source"), "text")


def file_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, modificationTime of every file; the path is relative to the tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    return files.withColumn("path", F.expr(f"substring_index(path, '{root}/', -1)"))


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """source and text of the Markdown files of a tree, without byte order marks."""
    return file_tree(spark, path).where(F.col("path").endswith(".md")).select(F.col("path").alias("source"), decoded(F.col("content")).alias("text"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, label, prefixes, sources of a query set of JSON lines.

    A blank query, an unknown label or a positive without anything wanted is an error, and so is an empty set.
    """
    rows = spark.read.schema("query string, label string, empty boolean, source_prefixes array<string>, sources array<string>").json(path)
    none = F.array().cast("array<string>")
    label = F.coalesce("label", F.when(F.col("empty"), "negative").otherwise("positive"))
    rows = rows.select(F.xxhash64("query").alias("query_id"), F.trim("query").alias("text"), label.alias("label"), F.coalesce("source_prefixes", none).alias("prefixes"), F.coalesce("sources", none).alias("sources"))
    odd = F.coalesce(F.col("text") == "", F.lit(True)) | ~F.col("label").isin("positive", "negative", "mismatch") | ((F.col("label") == "positive") & (F.size("prefixes") + F.size("sources") == 0))
    if rows.isEmpty() or not rows.where(odd).isEmpty():
        raise ValueError(f"a query set needs queries with a text, a known label and, if positive, wanted sources: {path}")
    return rows


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with row: its place in that order from 0, without gathering the rows in one task.

    The order is dealt out once and written, since bounds that are sampled anew would give other numbers.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one number for each partition
    offsets, total = [F.lit(-1), F.lit(0)], 0
    for part, size in sizes:
        offsets += [F.lit(part), F.lit(total)]
        total += size
    return placed.withColumn("row", F.element_at(F.create_map(*[c.cast("long") for c in offsets]), F.col("_part").cast("long")) + F.col("_at")).drop("_part", "_at")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and text: the documents as chunks of files under source, language and year."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), (2000 + F.col("doc_id") % 25).cast("string"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "source", "lang", "text")


CHUNKS_SQL = "(SELECT doc_id, source || '/' || lang || '/' || CAST(2000 + doc_id % 25 AS VARCHAR) || '/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS path, source, lang, text FROM documents)"
