"""Joins of rows with spans of rows, and tables laid out by row of which a scan reads the wanted parts alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written
from .nearby import nearest
from .recall import small

STEP = 4  # bits between the widths of buckets: a span lies in 17 buckets at most
PART = 4096  # rows of one stretch of a laid-out table; stretches are dealt to its folders in turn
FOLDERS = 256  # folders of a laid-out table at most, whatever its rows, since each one costs a file and a listing
LISTED = 10_000  # parts that a scan names; where more are wanted, the join alone picks the rows
NARROWED = 1200  # fixed value: rows of a query's pool under filters


def last_runs(rows: DataFrame) -> DataFrame:
    """source, start_row, end_row of each source's last stretch of neighbouring rows; rows has row, from 0 without gaps, and source.

    A stretch begins where the row before has another source, which a join with the rows moved by one tells, so that
    rows are never ordered in one task. Stretches of one source are numbered behind their beginnings.
    """
    before = rows.select((F.col("row") + 1).alias("row"), F.col("source").alias("before"))
    behind = rows.select((F.col("row") - 1).alias("row"), F.col("source").alias("behind"))
    starts = rows.join(before, "row", "left").where(~F.col("source").eqNullSafe(F.col("before")) | (F.col("row") == 0))
    ends = rows.join(behind, "row", "left_outer").where(~F.col("source").eqNullSafe(F.col("behind")) | F.col("behind").isNull())
    # the last stretch is from the last beginning to the last end
    first = starts.groupBy("source").agg(F.max("row").alias("start_row"))
    return first.join(ends.groupBy(F.col("source").alias("_s")).agg((F.max("row") + 1).alias("end_row")), F.col("source").eqNullSafe(F.col("_s"))).select("source", "start_row", "end_row")


def _level(length: Column) -> Column:
    """The least level whose buckets, 16 to its power rows wide, are as wide as the span."""
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) / STEP), F.lit(0)).cast("int")


def span_join(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (row, ...) with the columns of every span [start_row, end_row) that holds the row; spans may overlap and be of any length.

    A span stands in the buckets of its own width that it touches, a row in one bucket for each width that occurs,
    16 at most; equal buckets are joined, and the ends decide. Empty spans and null rows hold nothing.
    """
    wide = spans.where("start_row < end_row").withColumn("_level", _level(F.col("end_row") - F.col("start_row")))
    levels = sorted(r["_level"] for r in wide.select("_level").distinct().collect())  # 16 at most
    shift = lambda c, level: F.expr(f"shiftright({c}, {STEP} * {level})")
    cut = wide.withColumn("_bucket", F.explode(F.sequence(shift("start_row", "_level"), shift("(end_row - 1)", "_level"))))
    at = F.array(*[F.struct(F.lit(k).alias("_level"), shift("row", k).alias("_bucket")) for k in levels]) if levels else F.array().cast("array<struct<_level:int,_bucket:bigint>>")
    dealt = rows.select("*", F.explode(at).alias("_at")).select(*rows.columns, "_at._level", "_at._bucket")
    return dealt.join(cut, ["_level", "_bucket"]).where((F.col("row") >= F.col("start_row")) & (F.col("row") < F.col("end_row"))).drop("_level", "_bucket")


def _stretch(row: Column, size: int) -> Column:
    return F.floor(row / size).cast("long")


def _folder(stretch: Column) -> Column:
    return F.pmod(stretch, F.lit(FOLDERS)).cast("long")


def stretch_size(rows: DataFrame, least: int = PART) -> int:
    """Rows of a stretch with which a table of neighbouring rows fills its folders once, so that each holds one stretch."""
    return max(least, -(-rows.count() // FOLDERS))


def lay_out(rows: DataFrame, size: int = PART) -> DataFrame:
    """rows (row, ...) written to the shared folder, stretches of that many neighbouring rows dealt to FOLDERS folders in turn, and read again with _part, the folder's number."""
    path = f"{shared_folder(rows.sparkSession)}/laid-{uuid.uuid4().hex}"
    placed = rows.withColumn("_part", _folder(_stretch(F.col("row"), size)))
    placed.repartition("_part").sortWithinPartitions("_part", "row").write.partitionBy("_part").parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)


def _parts(laid: DataFrame, wanted: DataFrame) -> DataFrame:
    """laid, cut to the folders that wanted (_part) names, if they are few enough to be listed."""
    found = [r["_part"] for r in wanted.select("_part").distinct().limit(LISTED + 1).collect()]
    return laid.where(F.col("_part").isin(found)) if len(found) <= LISTED else laid


def late_fetch(laid: DataFrame, wanted: DataFrame, size: int = PART) -> DataFrame:
    """wanted (row, ...) with the columns of laid: text and the like are read for these rows alone, from their folders alone."""
    named = written(wanted.withColumn("_part", _folder(_stretch(F.col("row"), size))))  # read for its folders, its size and the join
    return small(named).join(_parts(laid, named), ["_part", "row"]).drop("_part")


def narrowed(laid: DataFrame, spans: DataFrame, size: int = PART) -> DataFrame:
    """The rows of laid inside disjoint spans (start_row, end_row), read from the folders that these touch alone."""
    parts = F.sequence(_stretch(F.col("start_row"), size), _stretch(F.col("end_row") - 1, size))
    cut = spans.where("start_row < end_row").select("start_row", "end_row", F.explode(parts).alias("_stretch"))
    inside = (F.col("row") >= F.col("start_row")) & (F.col("row") < F.col("end_row"))
    read = _parts(laid, cut.select(_folder(F.col("_stretch")).alias("_part"))).withColumn("_stretch", _stretch(F.col("row"), size))
    return read.join(cut, "_stretch").where(inside).drop("_part", "_stretch", "start_row", "end_row")


def merged_spans(spans: DataFrame, size: int = PART) -> DataFrame:
    """Disjoint spans of a source dimension, those of one stretch that touch each other joined to one."""
    cut = spans.where("start_row < end_row").select(F.explode(F.sequence(F.floor(F.col("start_row") / size), F.floor((F.col("end_row") - 1) / size)).cast("array<long>")).alias("_part"), "start_row", "end_row")
    own = cut.select("_part", F.greatest("start_row", F.col("_part") * size).alias("start_row"), F.least("end_row", (F.col("_part") + 1) * size).alias("end_row"))
    order = Window.partitionBy("_part").orderBy("start_row", "end_row")  # a stretch's rows at most
    reached = own.withColumn("_top", F.max("end_row").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    group = F.sum(F.when(F.col("start_row") <= F.col("_top"), 0).otherwise(1)).over(order)
    return reached.withColumn("_g", group).groupBy("_part", "_g").agg(F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row")).select("start_row", "end_row")


def narrowed_topk(laid: DataFrame, sources: DataFrame, accepted: Column, queries: DataFrame, k: int = NARROWED, size: int = PART) -> DataFrame:
    """query_id, row, dense, rank of each query's pool (query_id, vector) among the rows of the sources that a filter accepts.

    The filter sees sources (source, start_row, end_row) alone; vectors of other folders are never read.
    """
    rows = narrowed(laid, merged_spans(sources.where(accepted), size), size)
    return nearest(rows, queries, k)
