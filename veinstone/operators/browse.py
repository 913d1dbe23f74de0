"""Reading the corpus without a query: numbered rows, spans, listings, document pages, single chunks and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import assemble as A
from ..functions import text as T
from ..sources import numbered

# Characters of a listed or read text.
MOST = 8000


def spans(docs: DataFrame, source: str = "source") -> DataFrame:
    """source, start_row, end_row, from counts by source: rows are numbered in order of source, so none are sorted."""
    sizes = docs.groupBy(source).agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.orderBy(source))  # one row for each source
    return sizes.select(source, (end - F.col("n")).cast("long").alias("start_row"), end.cast("long").alias("end_row"))


def span_rows(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of chunks (row, ...) inside the spans (start_row, end_row) of wanted sources, joined by source."""
    return chunks.join(wanted, "source").where((F.col("row") >= F.col("start_row")) & (F.col("row") < F.col("end_row")))


def runs(chunks: DataFrame) -> DataFrame:
    """source, run, start_row, end_row of each stretch of neighbouring rows with one source, by the gaps in its rows."""
    island = F.col("row") - F.row_number().over(Window.partitionBy("source").orderBy("row"))
    return chunks.withColumn("run", island).groupBy("source", "run").agg(F.min("row").alias("start_row"), (F.max("row") + 1).alias("end_row")).drop("run")


def corpus_index(docs: DataFrame, path: str = "path") -> DataFrame:
    """category, documents and the first three file names of each first segment."""
    named = docs.select(F.substring_index(path, "/", 1).alias("category"), F.col(path).alias("path")).distinct()
    first = named.withColumn("at", F.row_number().over(Window.partitionBy("category").orderBy("path"))).where("at <= 3")
    names = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.substring_index("path", "/", -1).alias("name")))), lambda x: x["name"]), ", ").alias("examples"))
    return named.groupBy("category").agg(F.count("*").alias("documents")).join(names, "category")


def page(entries: DataFrame, key: str, cursor: str | None, size: int) -> tuple[DataFrame, str | None]:
    """The next entries behind a cursor in order of a distinct key, and the cursor of the page behind it."""
    if size < 1:
        raise ValueError("a page has at least one entry")
    behind = entries if cursor is None else entries.where(F.col(key) > cursor)
    rows = behind.select(key).distinct().orderBy(key).limit(size + 1)
    found = [r[0] for r in rows.collect()]  # a page, and one more
    return rows.limit(size), found[size - 1] if len(found) > size else None


def listing_pages(entries: DataFrame, key: str, size: int) -> DataFrame:
    """page, entries, first, next_cursor of every page of a listing in order of its distinct keys: the walk along all cursors as one plan.

    Keys are numbered in parallel; a page's cursor is the first key of the page behind it.
    """
    pages = numbered(entries.select(key).where(F.col(key).isNotNull()).distinct(), key).groupBy(F.floor(F.col("row") / size).alias("page")).agg(F.count("*").alias("entries"), F.min(key).alias("first"))
    behind = pages.select((F.col("page") - 1).alias("page"), F.col("first").alias("next_cursor"))
    return pages.join(behind, "page", "left").select("page", "entries", "first", "next_cursor")


def document_pages(chunks: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """source, page, chunks, first_row, last_row, next_row of every page of every document; next_row is null on the last.

    chunks has row and source, and spans where each source's rows begin and end, so a chunk's page follows from its row.
    """
    at = F.floor((F.col("row") - F.col("start_row")) / size).alias("page")
    pages = chunks.select("source", "row").join(spans, "source").groupBy("source", "end_row", at).agg(F.count("*").alias("chunks"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    return pages.select("source", "page", "chunks", "first_row", "last_row", F.when(F.col("last_row") + 1 < F.col("end_row"), F.col("last_row") + 1).alias("next_row"))


def document_page(chunks: DataFrame, source: str, cursor: int = 0, size: int = 10, most: int = MOST) -> DataFrame:
    """source, text, chunks, next_cursor, provenance, images: chunks cursor to cursor + size of a document as one text."""
    if cursor < 0 or size < 1:
        raise ValueError("a cursor is 0 or more and a page has at least one chunk")
    own = chunks.where(F.col("source") == source.replace("\\", "/"))
    placed = own.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy("row")) - 1).where(F.col("at").between(cursor, cursor + size))
    shown = placed.groupBy("source").agg(F.sort_array(F.collect_list(F.when(F.col("at") < cursor + size, F.struct("at", "text")))).alias("t"), F.count(F.when(F.col("at") == cursor + size, 1)).alias("more"))
    whole = shown.select("source", A.joined(F.transform("t", lambda x: x["text"])).alias("text"), F.size("t").alias("chunks"), F.when(F.col("more") > 0, F.lit(cursor + size)).alias("next_cursor"))
    clean = T.strip_images(T.strip_provenance(F.col("text")))
    return whole.select("source", T.let(clean, lambda t: A.bounded(t, F.substring_index("source", "/", -1), most)).alias("text"), "chunks", "next_cursor", T.provenance(F.col("text")).alias("provenance"), T.images(F.col("text")).alias("images"))


def chunk_row(chunk_id: str, corpus: str) -> int:
    """The row that a chunk's id names; the id must be of this corpus."""
    name, _, row = chunk_id.rpartition(":")
    if name != corpus or not row.isdigit():
        raise ValueError(f"not a chunk of {corpus}: {chunk_id}")
    return int(row)


def chunk(chunks: DataFrame, chunk_id: str, corpus: str, most: int = MOST) -> DataFrame:
    """The chunk of an id, annotated and capped; no row if there is none."""
    return annotated(chunks.where(F.col("row") == chunk_row(chunk_id, corpus)), most=most)


def merged(hits: DataFrame, chunks: DataFrame, limit: int = 2) -> DataFrame:
    """hits (query_id, rank, row, source) with text, n_merged and rows: each one's chunk with up to limit neighbours.

    Neighbours are rows next to the hit without a gap and of its source; those missing end the stretch.
    """
    wanted = hits.select("query_id", "rank", "row", "source", F.explode(F.sequence(F.col("row") - limit, F.col("row") + limit)).alias("near"))
    found = wanted.join(chunks.select(F.col("row").alias("near"), F.col("source").alias("of"), F.col("text").alias("part")), "near").where(F.col("of").eqNullSafe(F.col("source")))
    gathered = found.groupBy("query_id", "rank", "row", "source").agg(F.sort_array(F.collect_list(F.struct("near", "part"))).alias("parts"))  # at most 2 * limit + 1 rows
    joint = F.filter("parts", lambda p: F.size(F.filter("parts", lambda o: (o["near"] >= F.least(p["near"], F.col("row"))) & (o["near"] <= F.greatest(p["near"], F.col("row"))))) == F.abs(p["near"] - F.col("row")) + 1)
    rows = gathered.withColumn("parts", joint)
    return rows.select("query_id", "rank", "row", "source", A.joined(F.transform("parts", lambda p: p["part"])).alias("text"), F.size("parts").alias("n_merged"), F.transform("parts", lambda p: p["near"]).alias("rows"))


def availability(src: Column, document: Column, known: Column | None = None) -> Column:
    """remote, local (among the known paths, inside the content tree) or not-imported."""
    folder = F.regexp_replace(document, "[^/]*$", "")
    steps = F.filter(F.split(F.concat(folder, src), "/"), lambda s: ~s.isin("", "."))
    walk = F.aggregate(steps, F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out")), lambda a, s: F.when(s != "..", F.struct(F.concat(a["at"], F.array(s)).alias("at"), a["out"].alias("out"))).otherwise(F.struct(F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["out"] | (F.size(a["at"]) == 0)).alias("out"))))
    local = F.lit(False) if known is None else ~walk["out"] & F.array_contains(known, F.array_join(walk["at"], "/"))
    return F.when(src.rlike("^https?://"), "remote").when(local, "local").otherwise("not-imported")


def annotated(rows: DataFrame, kind: str | None = None, most: int = MOST, query: str | None = None) -> DataFrame:
    """rows (source, text, ...) with facts, origin, flags, screenshots, images, provenance and, for a kind, segments.

    Annotations are read from the text as it came; then provenance and images are stripped, and the text is capped.
    """
    text = F.col("text")
    noted = rows.withColumns({"facts": T.facts(text), "origin": T.origin(F.col("source")), "flags": T.flags(text), "screenshots": T.screenshots(text), "images": T.images(text), "provenance": T.provenance(text)})
    noted = noted.withColumn("segments", T.segments(text, kind)) if kind else noted
    return noted.withColumn("text", T.let(T.strip_images(T.strip_provenance(text)), lambda t: A.bounded(t, F.col(query) if query else F.lit(""), most)))
