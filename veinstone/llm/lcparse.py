"""Document fingerprints by locally consistent parsing.

A text's code points are the first level. At each level runs of one symbol become one symbol; deterministic coin
tossing, which puts in each symbol's place where and how it first differs from its left neighbour, four times over,
leaves labels below six, adjacent ones distinct; a phrase begins at each local maximum of the labels. A phrase's name,
a hash of its symbols, is a symbol of the next level, until one is left. Where phrases begin depends on four symbols
to the left and one to the right, so equal substrings have equal phrases inside, wherever they stand.

The fingerprint is the last name and a sketch of the phrases of some LEAST characters and more: for each of 128 bins
eight bits of the smallest hash of a phrase in it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LEAST = 3  # levels below, whose phrases have some 10 characters at most, say little
BINS = 128
CHARS = 1 << 18  # of texts parsed side by side
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.cumprod(np.full(64, _M2, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _toss(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which x differs from its left neighbour, plus x's bit there."""
    apart = x ^ left
    lowest = (apart & (~apart + np.uint64(1))).astype(np.float64)  # a power of two
    at = (lowest.view(np.int64) >> 52) - 1023
    return (2 * at).astype(np.uint8) + ((x >> at.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


def _table() -> np.ndarray:
    """The same for two labels below 128."""
    k = np.arange(128, dtype=np.uint64)
    x, left = np.repeat(k[None], 128, axis=0), np.repeat(k[:, None], 128, axis=1)
    return _toss(x, np.where(x == left, x ^ np.uint64(1), left)).ravel()


_TABLE = _table()


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six of symbols whose neighbours differ; first: where the texts begin, to which a symbol's own last bit says all."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ np.uint64(1)
    label = _toss(x, left)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TABLE[before.astype(np.int16) << 7 | label]
    return label


def parse(points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, texts): the phrases' names at each level, and the number of the text that each one is part of.

    points: the code points of texts of these sizes, none of them zero, one after the other. A text is named at each
    level until a single name is left of it.
    """
    x, owner, level = points.astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes), 0
    while len(x):
        level += 1
        edge = np.concatenate(([True], owner[1:] != owner[:-1]))
        begin = np.flatnonzero(edge | np.concatenate(([True], x[1:] != x[:-1])))
        if len(begin) < len(x):
            run = np.diff(begin, append=len(x)).astype(np.uint64)
            x, owner, edge = np.where(run > 1, _mix(x[begin] + run * _M1), x[begin]), owner[begin], edge[begin]
        first = np.flatnonzero(edge)
        label = _labels(x, first)
        starts = edge.copy()
        starts[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        last = first[1:] - 1  # the last symbols of texts never begin a phrase, and the second ones neither
        starts[last[~edge[last]]] = False
        second = first + 1
        second = second[second < len(x)]
        starts[second[~edge[second]]] = False
        at = np.flatnonzero(starts)
        lengths = np.diff(at, append=len(x))
        place = np.arange(len(x)) - np.repeat(at, lengths)
        x = _mix(np.add.reduceat(_mix(x + np.uint64(level)) * _POWERS[place], at) + lengths.astype(np.uint64))
        owner = owner[at]
        yield level, x, owner
        left = np.bincount(owner, minlength=len(sizes))[owner] > 1
        x, owner = x[left], owner[left]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of 8 + BINS bytes for each text: its last name and its sketch, in which zero stands for an empty bin."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), 8 + BINS), dtype=np.uint8)
    last, held = np.zeros(len(texts), dtype=np.uint64), []
    for level, names, owner in parse(np.frombuffer(raw, dtype=np.uint32) + np.uint32(1), sizes):
        last[owner] = names  # of several the last one written; in the end one is left
        alone = np.bincount(owner, minlength=len(texts))[owner] == 1
        keep = alone | (level >= LEAST)
        held.append((owner[keep], names[keep]))
    out[:, :8] = last.astype(">u8")[:, None].view(np.uint8)
    if held:
        owner, names = (np.concatenate(c) for c in zip(*held, strict=True))
        h = _mix(names + np.uint64(7))
        key = owner * BINS + (h >> np.uint64(57)).astype(np.int64)
        order = np.lexsort((h & np.uint64((1 << 57) - 1), key))
        key, h = key[order], h[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        out[key[new] // BINS, 8 + key[new] % BINS] = (h[new] & np.uint64((1 << 49) - 1)) % np.uint64(255) + np.uint64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of phrases that two texts have in common, by rows of fingerprints: 1 for equal texts, 0 at least."""
    filled = ((a[:, 8:] > 0) | (b[:, 8:] > 0)).sum(axis=1)
    same = ((a[:, 8:] == b[:, 8:]) & (a[:, 8:] > 0)).sum(axis=1) / np.maximum(filled, 1)
    chance = 1 / 255
    return np.where((a[:, :8] == b[:, :8]).all(axis=1), 1.0, np.clip((same - chance) / (1 - chance), 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many characters of the following text's beginning, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _parsed(texts: list[str]) -> np.ndarray:
    found, begin, held = [], 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= CHARS or k == len(texts) - 1:
            found.append(fingerprints(texts[begin : k + 1]))
            begin, held = k + 1, 0
    return np.concatenate(found) if found else np.zeros((0, 8 + BINS), dtype=np.uint8)


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, packed (the text, compressed), place and follows, dealt so that a place's rows in order are neighbours by descending doc_id.

    Places are ranges of ids between quantiles, one for a partition. The first row of a range goes to the end of the
    range before it too, marked by follows, and the very first row to the end of the last. Null ids come last, rows
    with one id in the order of their texts' digests.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []  # fewer than n numbers
    place_of = lambda i: len(bounds) + 1 if i is None else len(bounds) - bisect_right(bounds, i)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(place_of, batch.column(0).to_pylist()), pa.int32()), batch.column(0)], ["place", "doc_id"])

    firsts = docs.select("doc_id").mapInArrow(placed, "place int, doc_id long").groupBy("place").agg(F.max("doc_id").alias("first")).collect()  # one row for each range
    heads = sorted(map(tuple, firsts), key=lambda r: r[0])
    before = {at: (heads[k - 1][0], first) for k, (at, first) in enumerate(heads)}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        for batch in slices(batches):
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                row = (i, pack(raw), hashlib.sha256(raw).digest())
                place = place_of(i)
                out.append((place, False, *row))
                if before[place][1] == i:
                    out.append((before[place][0], True, *row))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["place", "follows", "doc_id", "packed", "tie"])

    rows = docs.mapInArrow(packed, "place int, follows boolean, doc_id long, packed binary, tie binary")
    return rows.repartitionById(n + 1, "place").sortWithinPartitions("place", "follows", F.col("doc_id").desc_nulls_last(), "tie")


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row for each input row.

    The next document is the one with the next smaller doc_id; the first follows the last, and a single row follows
    itself. ordered() states null and equal ids. Null and empty texts are one text, of no phrases: its fingerprint is
    zeros and it is like itself alone. An empty table gives no rows; other columns are not read; a text of any length
    is parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        last: list[tuple] = []  # the row before the batch: place, follows, doc_id, text, and its fingerprint
        own = np.zeros((0, 8 + BINS), dtype=np.uint8)
        for batch in slices(batches, 256):
            rows = [(*r, unpack(p).decode("utf-8", "surrogatepass")) for *r, p in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            own = np.concatenate((own, _parsed([r[3] for r in rows])))
            rows = last + rows
            live = [k for k in range(len(rows) - 1) if not rows[k][1]]
            texts = [edited(rows[k][3], rows[k + 1][3]) for k in live]
            other = _parsed(texts)
            live = np.array(live, dtype=np.int64)
            mine = own[live]
            shown = lambda prints: pa.array([p.tobytes().hex() for p in prints])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([rows[k][2] for k in live], pa.int64()), "n_chars": pa.array([len(rows[k][3]) for k in live], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()), "fingerprint": shown(mine).cast(pa.string()), "edited_fingerprint": shown(other).cast(pa.string()),
                "near_edited": pa.array(likeness(mine, other), pa.float64()), "near_next": pa.array(likeness(mine, own[live + 1]), pa.float64()),
            })
            last, own = rows[-1:], own[-1:]

    return ordered(docs).select("place", "follows", "doc_id", "packed").mapInArrow(run, SCHEMA)
