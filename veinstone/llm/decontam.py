"""Benchmark decontamination over suffix arrays of training shards.

Each task sorts the suffixes of the training words that it holds and binary-searches every suffix of the test set in
them, which gives each test suffix its longest verbatim match and all places of that match. A document word is hit
where such a match is as long as a window, or as a shorter item. The test set comes in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key

WINDOW = 13
BLOCK_BYTES = 16 << 20  # of benchmark text in one broadcast
SHARD_WORDS = 2_000_000  # of training words in one suffix array; a longer document has one of its own
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PAIRS = 1 << 17  # matches worked out at once
BY_WORD = 256  # words beyond a window that a match is compared word by word; from there on by two hashes of 31 bits
PRIMES, BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_000_003, 998_244_353)
PART = 1 << 20  # bytes of one test text in a block; a longer one goes in parts that overlap by a window
FOLD_SCHEMA = "doc_id long, text string, n_words long, spans array<int>, items array<string>, matches array<struct<item:string,doc_word:int,item_word:int,length:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class TestSet:
    """The suffixes of one block of test texts (item, first word, text), as ids of words."""

    def __init__(self, items: list[tuple[str, int, str]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.items, self.offsets = [i for i, _, _ in items], [at for _, at, _ in items]
        seqs = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)] for _, _, text in items]
        self.seq = np.array([x for seq in seqs for x in (*seq, 0)] + [0] * WINDOW, dtype=np.int64)  # 0 ends a text
        n = np.array([len(seq) for seq in seqs], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(n + 1)[:-1])) if len(n) else n
        owner = np.repeat(np.arange(len(n)), n)
        self.at = np.concatenate([np.arange(b, b + k) for b, k in zip(self.starts, n, strict=True)]) if len(n) else n
        # a suffix's prefix counts from WINDOW words on, or from the whole of a shorter item on
        self.need = np.minimum(WINDOW, n)[owner]
        full = self.at + self.need <= (self.starts + n)[owner]
        self.at, self.owner, self.need = self.at[full], owner[full], self.need[full]
        rows = self.seq[self.at[:, None] + np.arange(WINDOW)] if len(self.at) else np.zeros((0, WINDOW), np.int64)
        beyond = np.arange(WINDOW) >= self.need[:, None]
        self.low = _keys(np.where(beyond, 0, rows).astype(">u4"))
        self.high = _keys(np.where(beyond, 0xFFFFFFFF, rows).astype(">u4"))
        self.heads = np.unique(rows[:, 0]) if len(rows) else np.zeros(0, np.int64)
        second = self.need > 1
        self.pairs = np.unique((rows[second, 0] << 32) | rows[second, 1]) if len(rows) else np.zeros(0, np.int64)
        self.single = np.unique(rows[~second, 0]) if len(rows) else np.zeros(0, np.int64)

    def search(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, its first word, item, its first word, length) of the matches that test suffixes have in a shard.

        Every test suffix is looked up; each of its places is extended to the longest match there. Places that a longer
        match of the same item covers, one word ahead of both, are parts of that match and aren't repeated. A training
        suffix whose first words open no test suffix can't match any, so it isn't sorted.
        """
        sizes = [len(t) for t in texts]
        get = self.ids.get
        seq = np.zeros(sum(sizes) + len(texts) + WINDOW, dtype=np.int64)  # 0: unknown, and between documents
        owner = np.repeat(np.arange(len(texts)), np.array(sizes, dtype=np.int64) + 1)
        starts = np.cumsum([0, *(s + 1 for s in sizes)])
        for s, t in zip(starts, texts, strict=False):
            seq[s : s + len(t)] = [get(w, 0) for w in t]
        first, second = seq[: len(owner)], seq[1 : len(owner) + 1]
        keep = np.isin((first << 32) | second, self.pairs) | np.isin(first, self.single)
        at = np.flatnonzero(keep & (first > 0))
        if not len(at) or not len(self.at):
            return
        suffix = _keys(seq[at[:, None] + np.arange(WINDOW)].astype(">u4"))
        left = np.where(at > 0, seq[at - 1], 0)
        order = np.lexsort((left, suffix))
        suffix, at, left = suffix[order], at[order], left[order]
        lo, hi = np.searchsorted(suffix, self.low, "left"), np.searchsorted(suffix, self.high, "right")
        found = np.flatnonzero(hi > lo)
        lo, hi = lo[found], hi[found]
        # Places of one suffix stand in order of the word before them, so those that the same word precedes in the test
        # text, whose match is longer by that word, are a range and are left out of the count before any is listed.
        wide = len(self.ids) + 1
        where = np.cumsum(np.concatenate(([0], suffix[1:] != suffix[:-1]))) * wide + left
        test = self.at[found]
        inner = (test > self.starts[self.owner[found]]) & (self.need[found] == WINDOW)  # a shorter item has no longer match
        same = (where[lo] - left[lo]) + np.where(inner, self.seq[test - 1], 0)
        skip = np.where(inner, np.searchsorted(where, same, "left"), hi)
        skipped = np.where(inner, np.searchsorted(where, same, "right") - skip, 0)
        n = hi - lo - skipped
        ends = np.cumsum(n)
        for begin in range(0, int(n.sum()), PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
            f = np.searchsorted(ends, pair, "right")
            j = lo[f] + pair - (ends[f] - n[f])
            place, mine = at[np.where(j < skip[f], j, j + skipped[f])], found[f]
            begins = self.at[mine]
            length = self._longest(seq, place, begins, self.need[mine])
            doc = owner[place]
            yield from zip(doc.tolist(), (place - starts[doc]).tolist(), self.owner[mine].tolist(), (begins - self.starts[self.owner[mine]]).tolist(), length.tolist(), strict=True)

    def _longest(self, seq: np.ndarray, place: np.ndarray, test: np.ndarray, need: np.ndarray) -> np.ndarray:
        """How many words the texts share from there on: word by word at first, by bisection over prefix hashes if many."""
        length = need.copy()
        grow = np.arange(len(place))
        for _ in range(BY_WORD):
            a, b = place[grow] + length[grow], test[grow] + length[grow]
            more = seq[np.minimum(a, len(seq) - 1)]
            grow = grow[(more > 0) & (a < len(seq)) & (more == self.seq[np.minimum(b, len(self.seq) - 1)])]
            if not len(grow):
                return length
            length[grow] += 1
        a, b = place[grow], test[grow]
        low = length[grow]
        stop = lambda x: np.minimum.accumulate(np.where(x == 0, np.arange(len(x)), len(x))[::-1])[::-1]  # noqa: E731  the next end of a text
        high = np.minimum(stop(seq)[a] - a, stop(self.seq)[b] - b)
        ours, theirs = _prefixes(seq), _prefixes(self.seq)
        while (low < high).any():
            mid = (low + high + 1) // 2
            equal = np.ones(len(a), dtype=bool)
            for (h, p), (g, q), prime in zip(ours, theirs, PRIMES, strict=True):
                equal &= (h[a + mid] - h[a]) % prime * q[b] % prime == (g[b + mid] - g[b]) % prime * p[a] % prime
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        length[grow] = low
        return length


def _prefixes(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of two primes the sums of ids times powers of a base up to each place, and the powers."""
    out = []
    for prime, base in zip(PRIMES, BASES, strict=True):
        power = np.ones(len(x) + 1, dtype=np.int64)
        done = 1
        while done < len(power):
            step = int(power[done - 1]) * base % prime
            power[done : 2 * done] = power[: min(done, len(power) - done)] * step % prime
            done *= 2
        out.append((np.concatenate(([0], np.cumsum((x + 1) * power[:-1] % prime))), power))
    return out


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian ids as byte strings that sort alike; trailing zeros stand for the end of the text."""
    return np.ascontiguousarray(rows).view(f"S{4 * WINDOW}").ravel() if len(rows) else np.array([], dtype=f"S{4 * WINDOW}")


def _parts(item: str, text: str) -> Iterator[tuple[str, int, str]]:
    """A test text in parts of bounded size; a part repeats the last words of the one before, so no window is lost."""
    if len(text) <= PART:
        yield item, 0, text
        return
    seq, step = words(text), max(WINDOW, PART // 8)
    for begin in range(0, max(1, len(seq) - WINDOW + 1), step):
        yield item, begin, b" ".join(seq[begin : begin + step + WINDOW - 1]).decode("utf-8", "surrogatepass")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    for batch in batches:
        begin, held, n = 0, [], 0
        for i, text in enumerate(batch["text"]):
            held.append(words(text if isinstance(text, str) else None))
            n += len(held[-1])
            if n >= SHARD_WORDS or i == len(batch) - 1:
                yield batch.iloc[begin : i + 1], held
                begin, held, n = i + 1, [], 0


def occurrences(docs: DataFrame, benchmark: DataFrame, places: bool = True) -> DataFrame:
    """docs' doc_id and text with n_words, merged word spans (start, end, ...) that are hit, items, and the matches.

    A match (item, doc_word, item_word, length) is a longest verbatim run of words that a document and an item share, of
    a window's length at least or the whole of a shorter item; a run that goes over a boundary of the parts of a long
    item is given by part. One row for each input row, repeated ones too. Null or wordless texts have no words and no
    hits; items with a null item_id or no words are passed over; an empty benchmark hits nothing. Long texts of few
    different words have as many matches as their beginnings and ends can align, which are worked out PAIRS at a time;
    without places they aren't listed, only their spans and items. Test blocks pass over
    the shards one after another; each is a broadcast of about BLOCK_BYTES.
    """
    spark = docs.sparkSession
    test = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    n_bytes = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-n_bytes // BLOCK_BYTES) or 1
    none = lambda kind: F.array().cast(kind)
    out = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("n_words"), none("array<int>").alias("spans"), none("array<string>").alias("items"), none("array<struct<item:string,doc_word:int,item_word:int,length:int>>").alias("matches"))
    for block in range(n_blocks):
        rows = test.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast([part for r in rows for part in _parts(r.item_id, r.text)])

        def fold(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = TestSet(shared.value)
            for part, texts in _shards(batches):
                spans: list[list[tuple[int, int]]] = [list(zip(s[::2], s[1::2], strict=True)) for s in part["spans"]]
                items, matches = [set(x) for x in part["items"]], [list(x) for x in part["matches"]]
                for doc, start, item, word, length in known.search(texts):
                    spans[doc].append((start, start + length))
                    items[doc].add(known.items[item])
                    if places:
                        matches[doc].append({"item": known.items[item], "doc_word": start, "item_word": word + known.offsets[item], "length": length})
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").values, "text": part["text"].values, "n_words": [len(t) for t in texts],
                    "spans": [[int(x) for ab in merge_spans(s) for x in ab] for s in spans], "items": [sorted(x) for x in items], "matches": matches,
                })

        out = out.mapInPandas(fold, FOLD_SCHEMA)
    return out


def _judged(found: DataFrame) -> DataFrame:
    """occurrences with n_hit and contaminated, where hit words are at least a twentieth of a text's words."""
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))["n"]
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdict for each row of docs: contaminated where hit words are at least a twentieth of its words.

    Odd rows are as in occurrences; a text without words is never contaminated.
    """
    return _judged(occurrences(docs, benchmark, places=False)).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows. The verdict rests on the text alone and follows it, whatever a row's id is."""
    bad = _judged(occurrences(docs, benchmark, places=False)).where("contaminated").select(text_key().alias("key")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, text_key().alias("key")).join(bad, "key", "left_anti").select("row.*")
