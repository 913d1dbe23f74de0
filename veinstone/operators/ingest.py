"""Import of file trees, their manifests, and the tables of an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import assemble as A
from ..functions import text as T
from ..functions import vectors as V
from ..sources import numbered
from .retrieval import postings

# Folders, names and endings that are or aren't imported.
NO_FOLDERS = ".git .github __pycache__ node_modules dist build target vendor theme images image assets"
NO_NAMES = "summary.md agents.md license license.md license.notice copying notice notice.md notice.txt"
NO_ENDINGS = (
    "py pyc ps1 psm1 sh bash zsh bat cmd js mjs cjs php pl rb go c cc cpp h hpp java class dll exe bin zip 7z rar tar gz bz2 xz png jpg jpeg gif webp svg ico pdf doc docx xls xlsx xml html css mvg avi"
)
MARKDOWN, PLAIN, STRUCTURED = "md markdown", "txt", "yml yaml"
RAW_FLAGS = "flag flag1 flag2 flag3"


def _ending(name: Column) -> Column:
    return F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)


def should_import(path: Column, plain: bool = False, structured: bool = False) -> Column:
    """Whether a relative path is safe and useful to index."""
    path = F.lower(T.path(path))
    name = F.substring_index(path, "/", -1)
    listed = lambda c, words: c.isin(*words.split())
    barred = F.exists(F.split(path, "/"), lambda s: listed(s, NO_FOLDERS)) | listed(name, NO_NAMES) | name.rlike(r"\.(idx|index)\.md$") | listed(_ending(name), NO_ENDINGS)
    kept = listed(_ending(name), MARKDOWN)
    kept = kept | (listed(_ending(name), PLAIN) & ~listed(F.substring_index(name, ".", 1), RAW_FLAGS)) if plain else kept
    return ~barred & (kept | listed(_ending(name), STRUCTURED) if structured else kept)


def destination(path: Column, strip_prefix: str | None = None, structured: bool = False) -> Column:
    """Where a path goes: without the prefix's folders; structured text as Markdown."""
    out = T.path(path)
    if strip_prefix:
        head = strip_prefix.replace("\\", "/").strip("/") + "/"
        out = F.when(out.startswith(head), F.substring(out, len(head) + 1, 2147483647)).otherwise(out)
    return F.regexp_replace(out, r"(?i)([^/.])\.ya?ml$", "$1.md") if structured else out


def without_collisions(files: DataFrame) -> DataFrame:
    """files (source_path, destination, ...) with destination made its own and collides_with: the first by path keeps the name.

    A later file of one name, whatever its case, gets its number among them behind its stem, so names stay short however
    many files share one. A file that is called like a numbered name from the start is not told apart from it.
    """
    key = Window.partitionBy(F.lower("destination")).orderBy("source_path")
    n, first = F.row_number().over(key) - 1, F.first("source_path").over(key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    name = F.regexp_extract("destination", r"^(.*?)(\.[^./]*)?$", 1)
    ending = F.regexp_extract("destination", r"^(.*?)(\.[^./]*)?$", 2)
    numbered = F.concat(name, F.lit("__duplicate_"), F.col("_n").cast("string"), ending)
    placed = files.withColumns({"_n": n, "_first": first})
    return placed.withColumn("collides_with", F.when(F.col("_n") > 0, F.col("_first"))).withColumn("destination", F.when(F.col("_n") > 0, numbered).otherwise(F.col("destination"))).drop("_n", "_first")


def imported(files: DataFrame, commit: str, retrieved_at: str, repository: str, url: str | None = None, strip_prefix: str | None = None, plain: bool = False, structured: bool = False, noise: bool = True, header: bool = True) -> DataFrame:
    """source_path, destination, collides_with, sha256, bytes, text of the files (path, content) that are imported."""
    kept = files.where(should_import(F.col("path"), plain, structured)).select(T.path(F.col("path")).alias("source_path"), "content", destination(F.col("path"), strip_prefix, structured).alias("destination"))
    text = T.redact(T.decoded(F.col("content")))
    text = T.strip_noise(text) if noise else text
    text = F.concat(T.provenance_header(F.col("source_path"), commit, retrieved_at, repository, url), text) if header else text
    # read where the files are, before names are sorted, so that only what is wanted of a file is shuffled
    read = kept.select("source_path", "destination", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), text.alias("text"))
    return without_collisions(read).select("source_path", "destination", "collides_with", "sha256", "bytes", "text")


def totals(manifest: DataFrame) -> DataFrame:
    """imported_files, bytes and the endings of a manifest (destination, bytes)."""
    return manifest.agg(F.count("*").alias("imported_files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.array_join(F.array_sort(F.collect_set(_ending(F.lower("destination")))), ",").alias("extensions"))


def stale(old: DataFrame, new: DataFrame, key: str = "destination") -> DataFrame:
    """What an earlier manifest names and the new one doesn't."""
    return old.join(new.select(key), key, "left_anti").select(key)


def upsert(runtime: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of either side; the template's fields win where they aren't null, the runtime's others stay."""
    fields = [c for c in runtime.columns if c not in keys]
    right = template.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    return runtime.join(right, keys, "full_outer").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def union_lists(existing: Column, incoming: Column) -> Column:
    """existing, then what incoming adds, each once, in order."""
    return F.concat(existing, F.filter(F.array_distinct(incoming), lambda x: ~F.array_contains(existing, x)))


def merged_lists(manifests: DataFrame, keys: list[str], order: str, lists: list[str]) -> DataFrame:
    """One row for each key of manifests (keys, order, lists): of each list its items in order of the manifests, each once, where it came first.

    Items are numbered by manifest and place, and the first place of each is kept before a key's lists are made, so
    that many manifests which say the same are not gathered.
    """
    out = manifests.select(*keys).distinct()
    for name in lists:
        items = manifests.select(*keys, F.col(order).alias("_o"), F.posexplode(name).alias("_i", "item"))
        first = items.groupBy(*keys, "item").agg(F.min(F.struct("_o", "_i")).alias("at"))
        made = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(made.select(*[F.col(k).alias(f"_{k}") for k in keys], name), same, "left").drop(*[f"_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.array().cast(manifests.schema[name].dataType)))
    return out


def init_actions(template: DataFrame, runtime: DataFrame, overwrite: bool, merge: list[str]) -> DataFrame:
    """path, action of each template file (path): copied where the runtime (path) has none, else merged, overwritten or skipped."""
    there = runtime.select("path", F.lit(True).alias("_there")).distinct()
    name = F.when(F.col("_there").isNull(), "copied").when(F.col("path").isin(merge), "merged").otherwise("overwritten" if overwrite else "skipped")
    return template.select("path").join(there, "path", "left").select("path", name.alias("action"))


def init_summary(actions: DataFrame) -> DataFrame:
    """action, files: how many files met each action, zeros included."""
    names = F.explode(F.array(*map(F.lit, ("copied", "overwritten", "skipped", "merged")))).alias("action")
    return actions.sparkSession.range(1).select(names).join(actions.groupBy("action").agg(F.count("*").alias("n")), "action", "left").select("action", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def fingerprint(files: DataFrame) -> DataFrame:
    """A tree's revision without a commit: number of files, bytes and latest change."""
    return files.agg(F.concat_ws("-", F.lit("local"), F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.unix_micros(F.max("modificationTime")), F.lit(0))).alias("revision"))


def chunked(docs: DataFrame, limit: int = 500) -> DataFrame:
    """source, at, text: the chunks of each document (source, text) in order."""
    return docs.select("source", F.posexplode(A.chunked(F.col("text"), limit)).alias("at", "text"))


def build_index(spark: SparkSession, chunks: DataFrame, path: str, model: str) -> dict[str, int]:
    """Write the tables of an index under path: chunks with unit and int8 vectors, spans, postings and the manifest.

    chunks has source, at, text and embedding. Each table appears whole or not at all; the manifest is written last, so
    a broken build is no index. A table is read again rather than worked out twice.
    """
    usable = chunks.where(F.col("embedding").isNotNull())
    numbered(usable, "source", "at").withColumn("embedding", V.normalized(F.col("embedding"))).withColumn("scale", V.int8_scale(F.col("embedding"))).withColumn("q", V.int8(F.col("embedding"), F.col("scale"))).write.mode("overwrite").parquet(f"{path}/chunks")
    rows = spark.read.parquet(f"{path}/chunks")
    rows.groupBy("source").agg(F.min("row").alias("start_row"), (F.max("row") + 1).alias("end_row")).write.mode("overwrite").parquet(f"{path}/spans")
    postings(rows.select(F.col("row").alias("doc_id"), "text")).select("token", "df", F.col("docs").alias("rows")).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    n = rows.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dims")).first()
    terms = postings_totals(spark.read.parquet(f"{path}/postings")).first()
    manifest = {"model": model, "rows": n["rows"], "dims": n["dims"] or 0, "tokens": terms["tokens"], "postings": terms["postings"]}
    spark.createDataFrame([manifest], "model string, rows long, dims int, tokens long, postings long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def postings_totals(postings: DataFrame) -> DataFrame:
    """tokens, postings and max_df of a postings table."""
    return postings.agg(F.count("*").alias("tokens"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("postings"), F.coalesce(F.max("df"), F.lit(0)).cast("long").alias("max_df"))


def index_status(spark: SparkSession, path: str, model: str) -> str:
    """ready, missing or of another model."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return "missing"
    return "ready" if spark.read.parquet(f"{path}/manifest").first()["model"] == model else "other model"


def allowed(name: str, names: list[str]) -> str:
    """The name of a corpus, if it is one of those allowed; case doesn't matter."""
    found = reduce(lambda a, n: n if n.lower() == name.lower() else a, names, None)
    if not found or not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"unknown corpus {name!r}; known: {', '.join(sorted(names))}")
    return found
