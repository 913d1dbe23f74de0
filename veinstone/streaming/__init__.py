"""Streams: a landing folder to cleaned chunks, and deltas to whole messages. Extensions beside the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assemble as A
from ..functions import text as T
from ..operators.ingest import should_import


def landing(spark: SparkSession, path: str) -> DataFrame:
    """path, text and arrived of the files that come into a folder and would be imported, cleaned as an import cleans them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    kept = files.where(should_import(F.col("path"), plain=True, structured=True))
    return kept.select("path", T.strip_noise(T.redact(T.decoded(F.col("content")))).alias("text"), F.col("modificationTime").alias("arrived"))


def clean_chunks(documents: DataFrame, limit: int = 500, late: str = "1 day") -> DataFrame:
    """source, at, text, sha, arrived: chunks that say something, each text once while its first arrival is within ``late``."""
    parts = documents.withWatermark("arrived", late).select(F.col("path").alias("source"), "arrived", F.posexplode(A.chunked(F.col("text"), limit)).alias("at", "text"))
    return parts.where(F.size(T.low_information(F.col("text"))) == 0).withColumn("sha", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["sha"])


def append_chunks(chunks: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Write the chunks to a folder of Parquet files, exactly once; ``once`` ends when what is there has been read."""
    writer = chunks.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def delta_of(line: Column) -> Column:
    """What a line of an event stream says: content, reasoning, finish and whether it ends the stream; null without data."""
    data = F.trim(F.regexp_extract(line, r"^data:(.*)$", 1))
    read = lambda *paths: F.coalesce(*[F.get_json_object(data, p) for p in paths])
    whole = F.struct(
        F.coalesce(read("$.choices[0].delta.content", "$.choices[0].message.content", "$.choices[0].text"), F.lit("")).alias("content"),
        F.coalesce(read("$.choices[0].delta.reasoning_content", "$.choices[0].delta.reasoning"), F.lit("")).alias("reasoning"),
        read("$.choices[0].finish_reason").alias("finish"), (data == "[DONE]").alias("done"),
    )
    return F.when(data != "", whole)


def messages(lines: DataFrame) -> DataFrame:
    """conv_id, text, reasoning_chars, finish of streamed lines (conv_id, seq, line), put together in order of seq."""
    rows = lines.select("conv_id", "seq", delta_of(F.col("line")).alias("d")).where("d IS NOT NULL")
    parts = F.sort_array(F.collect_list(F.struct("seq", F.col("d.content").alias("content"))))
    last = F.max_by("d.finish", F.when(F.col("d.finish").isNotNull(), F.col("seq")))
    folded = rows.groupBy("conv_id").agg(parts.alias("p"), F.sum(F.length("d.reasoning")).alias("reasoning_chars"), last.alias("finish"))
    return folded.select("conv_id", F.array_join(F.transform("p", lambda x: x["content"]), "").alias("text"), "reasoning_chars", "finish")
