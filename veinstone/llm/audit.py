"""Filter interaction audit: what each of five filters removes in every order that they can stand in.

A fingerprint-routed RDD finds the texts that a smaller id has too: documents go by the xxhash of their text to a
partition that keeps, for each hash, a chain of (full text, smallest id), and those whose id isn't the smallest are
emitted. Each task does the same with its own rows before the shuffle, so that a text which a third of all rows hold
is sent once by each task. The masks of failed filters are then counted by combineByKey, whose vectors of 32 masks
are merged, and every order's counts come from its part's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, slices

FILTERS = "ABCDE"
WORDS, UPPER = 200, bytes(range(65, 91))  # A: words at least; C: upper-case letters
ODD = bytes(b"#$%&*|")
HELD = 32_000_000  # bytes of compressed texts that a task chains before it sends them on
REPEATED = 1 << FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


class Found(NamedTuple):
    """A text's smallest id in some rows, their parts with the number of rows of that id, and the filters that it fails, but for E."""

    packed: bytes
    doc_id: float | int
    parts: dict[str, int]
    mask: int


def own_mask(raw: bytes, n_chars: int) -> int:
    """The filters A to D that a text of these bytes and code points fails, as bits."""
    words = raw.split()  # by the six ASCII white spaces, as bytes are
    mask = len(words) < WORDS
    mask |= (100 * len(set(words)) < 50 * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * n_chars) << 2
    return mask | (len(raw) != len(raw.translate(None, ODD))) << 3


def _chained(chain: list[Found], new: Found) -> tuple[list[Found], list[tuple]]:
    """The chain with a text put in; the rows (id, part, rows, mask) that are now known to fail E."""
    for k, old in enumerate(chain):
        if old.packed != new.packed:
            continue
        if old.doc_id == new.doc_id:
            for part, n in new.parts.items():
                old.parts[part] = old.parts.get(part, 0) + n
            return chain, []
        first, later = (old, new) if old.doc_id < new.doc_id else (new, old)
        chain[k] = first
        return chain, _rows(later, REPEATED)
    chain.append(new)
    return chain, []


def _rows(found: Found, more: int = 0) -> list[tuple]:
    return [(None if found.doc_id == np.inf else found.doc_id, part, n, found.mask | more) for part, n in found.parts.items()]


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key (the text's xxhash, as a signed number), doc_id, part, mask and the compressed text of rows (doc_id, text, part)."""
    import xxhash
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches):
        raws = [((t or "").encode("utf-8", "surrogatepass"), len(t or "")) for t in batch.column(1).to_pylist()]
        keys = np.array([xxhash.xxh64_intdigest(raw) for raw, _ in raws], dtype=np.uint64).view(np.int64)
        columns = [pa.array(keys), batch.column(0), batch.column(2), pa.array([own_mask(*r) for r in raws], pa.int32()), pa.array([pack(raw) for raw, _ in raws], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "part", "mask", "packed"])


def _local(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """Prepared rows of a task as (key, chain entry), and as (key, row) those that some other of its rows makes fail E."""
    chains, held = {}, 0
    for key, doc_id, part, mask, packed in rows:
        chain = chains.get(key, [])
        n = len(chain)
        chains[key], known = _chained(chain, Found(bytes(packed), np.inf if doc_id is None else doc_id, {part: 1}, mask))  # a null id is never the smaller one
        held += len(packed) * (len(chains[key]) > n)
        for row in known:
            yield hash(row[0]), row
        if held > HELD:
            yield from ((k, x) for k, chain in chains.items() for x in chain)
            chains, held = {}, 0
    yield from ((k, x) for k, chain in chains.items() for x in chain)


def _routed(items: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """Rows (id, part, rows, mask) of a partition's chains, E decided."""
    chains: dict[int, list[Found]] = {}
    for key, x in items:
        if not isinstance(x, Found):
            yield x
            continue
        chains[key], known = _chained(chains.get(key, []), x)
        yield from known
    for chain in chains.values():
        for found in chain:
            yield from _rows(found)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, n, mask: the filters that n rows of this id and part fail, bit k for the k-th of FILTERS.

    What is worked out of a single text is written once, so that a lost executor costs the routing alone.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("part"))
    prepared = Tables(spark).write("prepared", rows.mapInArrow(_prepared, "key long, doc_id long, part string, mask int, packed binary"))
    routed: RDD = prepared.rdd.map(tuple).mapPartitions(_local).partitionBy(n, lambda key: key).mapPartitions(_routed)
    return spark.createDataFrame(routed, "doc_id long, part string, n long, mask int")


def vectors(docs: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): how many documents of the part have each of the 32 masks, how many of them are good, how many toxic."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masks(docs).join(said, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[mask] += (n, n * good, n * toxic)
        return counts

    keyed = rows.rdd.map(lambda r: (r[0], r[1:]))
    return keyed.combineByKey(lambda row: add(np.zeros((1 << len(FILTERS), 3), dtype=np.int64), row), add, lambda a, b: a + b)


def orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """A row for each order of the filters and each step of it."""
    mask = np.arange(len(counts))
    n, good, toxic = counts.T
    removed, out = dict.fromkeys(FILTERS, 0), []
    for order in permutations(FILTERS):
        gone = np.zeros(len(mask), dtype=bool)
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails = mask & bit > 0
            here = fails & ~gone
            row = [n[~gone & ~fails].sum(), n[here].sum(), n[fails & gone].sum(), n[mask == bit].sum(), good[here].sum(), toxic[here].sum()]
            out.append((order, step, letter, list(map(int, row))))
            removed[letter] += int(row[1])
            gone |= fails
    for order, step, letter, row in out:
        yield part, "".join(order), step, *row, removed[letter]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, for each part (a null language: an empty string), order and step.

    A null text is an empty one. Rows with the same id and text don't make each other fail E, since neither id is the
    smaller; a null id is larger than any. A document is good or toxic if any of its labels says so. An empty table has
    no parts and gives no rows. A long text is held once by a task, compressed. Other columns are not read.
    """
    return docs.sparkSession.createDataFrame(vectors(docs, labels).flatMap(lambda x: orders(*x)), SCHEMA)


def sql() -> str:
    """The audit in DuckDB's SQL."""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS {}(f, bit)"
    failed = "CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > low THEN 16 ELSE 0 END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.part, {failed} AS mask, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM {letters.format('a')}, {letters.format('b')}, {letters.format('c')}, {letters.format('d')}, {letters.format('e')} WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) AS r(step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS[:-1])}, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
