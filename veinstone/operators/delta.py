"""Upkeep of an index: what was added, changed or removed is found by digest, and only the buckets that hold it are written anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # a bucket of paths is what a change rewrites; chosen once for an index


class Index:
    """An index of files (path, text) under a folder: ``derive`` makes a bucket's rows from its files, path among their columns.

    A generation of the manifest names each file's digest, bucket and the generation whose folder holds that bucket.
    It is written last, and a generation without its mark of success doesn't count, so a broken update changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, derive: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.derive, self.buckets = spark, folder, derive, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """The last whole generation; 0 if there is none."""
        path, fs = self._path("manifest")
        found = [int(x.getPath().getName()) for x in fs.listStatus(path)] if fs.exists(path) else []
        whole = [g for g in found if fs.exists(self._path(f"manifest/{g}/_SUCCESS")[0])]
        return max(whole, default=0)

    def manifest(self) -> DataFrame:
        """path, digest, bucket, generation of every file."""
        schema, g = "path string, digest string, bucket int, generation int", self.generation()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/manifest/{g}") if g else self.spark.createDataFrame([], schema)

    def changes(self, files: DataFrame) -> DataFrame:
        """path, digest, bucket, action (added, changed, removed or same) of the files against the manifest."""
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int").alias("bucket")
        new = files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), bucket)
        old = self.manifest().select("path", F.col("digest").alias("was"), F.col("bucket").alias("old_bucket"))
        action = F.when(F.col("was").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("was"), "changed").otherwise("same")
        return new.join(old, "path", "full_outer").select("path", "digest", F.coalesce("bucket", "old_bucket").alias("bucket"), action.alias("action"))

    def update(self, files: DataFrame) -> dict[str, int]:
        """Bring the index up to the files, whose paths are distinct; the number of files by action and of buckets written."""
        g = self.generation() + 1
        diff = self.changes(files)
        counts = diff.groupBy("bucket", "action").count().collect()  # four rows for each bucket
        done = {a: sum(r["count"] for r in counts if r["action"] == a) for a in ("added", "changed", "removed", "same")}
        touched = sorted({r["bucket"] for r in counts if r["action"] != "same"})
        if touched:
            bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
            rows = self.derive(files.where(bucket.isin(touched))).withColumn("bucket", bucket)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/{g}")
            kept = self.manifest().where(~F.col("bucket").isin(touched))
            new = diff.where(F.col("bucket").isin(touched) & (F.col("action") != "removed")).select("path", "digest", "bucket", F.lit(g).alias("generation"))
            kept.union(new).write.mode("overwrite").parquet(f"{self.folder}/manifest/{g}")
        return done | {"buckets_written": len(touched)}

    def read(self) -> DataFrame:
        """The index's rows, from the folders that the manifest names."""
        held = self.manifest().select("bucket", "generation").distinct().collect()  # one row for each bucket
        empty = self.derive(self.spark.createDataFrame([], "path string, text string"))
        paths = [f"{self.folder}/rows/{r['generation']}/bucket={r['bucket']}" for r in held]
        found = [p for p in paths if self._path(p[len(self.folder) + 1 :])[1].exists(self._path(p[len(self.folder) + 1 :])[0])]  # files may derive no row
        return self.spark.read.schema(empty.schema).parquet(*found) if found else empty

    def vacuum(self) -> None:
        """Delete what earlier generations hold and this one no longer names."""
        now = self.generation()
        held = {(r["generation"], r["bucket"]) for r in self.manifest().select("bucket", "generation").distinct().collect()}
        for name in ("rows", "manifest"):
            top, fs = self._path(name)
            for x in fs.listStatus(top) if fs.exists(top) else []:
                g = int(x.getPath().getName())
                if name == "manifest" and g != now:
                    fs.delete(x.getPath(), True)
                for y in fs.listStatus(x.getPath()) if name == "rows" else []:
                    of, _, bucket = y.getPath().getName().partition("=")
                    if of == "bucket" and (g, int(bucket)) not in held:
                        fs.delete(y.getPath(), True)
