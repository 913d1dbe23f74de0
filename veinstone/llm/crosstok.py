"""Alignment of two tokenizers' tokens, and corpus-wide counts of the ids that end together.

A two-pointer merge of cumulative token ends inside mapInPandas cuts each text into groups, at the bytes where a token
of either side ends, and links the tokens that end there. Spark counts the pairs of ids and joins the counts and the
maxima of either side back to the documents. Counts of frequent pairs, a bounded number of them, go to all machines;
the pairs beyond are rare, so that the shuffled join that they take has no hot key.

Both vocabularies cut at a blank between two other characters: A's pre-tokens never hold one but at their beginning,
and no piece of B holds a blank behind another character, which is looked up. So a text's units between such blanks
are encoded and merged once and remembered. With any other pair of vocabularies a text is one unit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols, groups
from .common import Tables, durable

CHARS = 2_000_000  # of text whose new units are encoded at once
UNITS, UNIT_CHARS = 300_000, 8_000_000  # what one task remembers; the rest is encoded anew
HEAVY = 1 << 18  # pairs whose counts go to all machines, 4 MB; the others are joined by a shuffle
BLANK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def merge(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The ends that both sides have, in order: the two sorted runs are merged (a stable sort does no more), equal neighbours are shared."""
    both = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
    return both[1:][both[1:] == both[:-1]]


class Aligner:
    """Encodes with A, a byte-level BPE, and B, a piece model with byte fallback, and remembers the units' groups and links."""

    def __init__(self, a_spec: str, b_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_spec), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        spec, byte = json.loads(a_spec), {c: bytes([k]) for k, c in enumerate(byte_symbols())}
        vocab = self.a.get_vocab()
        specials = {t["content"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = token.encode() if token in specials else b"".join(byte[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = (np.array([f"{k}{end}" for end in marks for k in range(len(side))], dtype=object) for side, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;\n")))
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cut = plain and not any(BLANK in p.lstrip(BLANK) for p in pieces) and self.b.encode("  x y ", out_type=str)[-1] == BLANK
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.names = np.zeros(0, dtype=object)  # a unit's groups; None if a side's bytes are not the unit's
        self.n = np.zeros((0, 3), dtype=np.int64)  # ids of A, ids of B, groups
        self.ragged = np.zeros(0, dtype=bool)  # units that a blank beside white space cut wrongly
        self.codes, self.first = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)  # links of unit k: codes[first[k] : first[k + 1]]
        self.hits = np.zeros(0, dtype=np.int64)
        self.chars = 0

    def trim(self) -> None:
        """Keep what was met again, if too much is remembered; if that is too much as well, nothing."""
        if len(self.at) <= UNITS and self.chars <= UNIT_CHARS:
            return
        keep = np.flatnonzero(self.hits > 1)
        units = list(self.at)
        units = [units[k] for k in keep]
        if len(keep) > UNITS // 2 or (chars := sum(map(len, units))) > UNIT_CHARS // 2:
            return self.forget()
        self.at, self.chars = {u: k for k, u in enumerate(units)}, chars
        sizes = np.diff(self.first)[keep]
        self.codes = self.codes[_spread(self.first[keep], sizes)]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.names, self.n, self.ragged, self.hits = self.names[keep], self.n[keep], self.ragged[keep], np.zeros(len(keep), dtype=np.int64)

    def _pieces(self, new: list[str]) -> Iterator[list[str]]:
        """Units to encode together, which blanks part; odd ones alone."""
        held, chars = [], 0
        for u in new:
            if not self.cut or u != u.strip() or BLANK in u or not u:
                yield [u]
                continue
            held.append(u)
            chars += len(u)
            if chars > 2000:
                yield held
                held, chars = [], 0
        if held:
            yield held

    def learn(self, units: set[str], alone: bool = False) -> None:
        new = sorted(units - self.at.keys())
        if not new:
            return
        pieces = [[u] for u in new] if alone else list(self._pieces(new))
        texts = [" ".join(p) for p in pieces]
        a_ids = [x.ids for x in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        b_ids = self.b.encode(texts, num_threads=1)
        whole = [f" {t}".encode("utf-8", "surrogatepass") for t in texts]
        good = [b"".join([self.a_bytes[k] for k in x]) == w and b"".join([self.b_bytes[k] for k in y]) == w for x, y, w in zip(a_ids, b_ids, whole, strict=True)]
        mixed = [p for p, fine in zip(pieces, good, strict=True) if not fine and len(p) > 1]
        if mixed:
            self.learn(set(chain.from_iterable(mixed)), alone=True)  # which of them it was
            return self.learn(units)
        ok = [u for p, fine in zip(pieces, good, strict=True) if fine for u in p]
        bad = [u for p, fine in zip(pieces, good, strict=True) if not fine for u in p]
        a = np.fromiter(chain.from_iterable(x for x, fine in zip(a_ids, good, strict=True) if fine), np.int64)
        b = np.fromiter(chain.from_iterable(x for x, fine in zip(b_ids, good, strict=True) if fine), np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        shared = merge(a_ends, b_ends)
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in ok], dtype=np.int64)
        a_last, b_last = np.searchsorted(a_ends, shared), np.searchsorted(b_ends, shared)  # the tokens that end there
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        a_mark, b_mark = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_mark[a_last], b_mark[b_last], b_mark[np.searchsorted(b_ends, ends)] = 1, 1, 2
        order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
        names = "".join(np.concatenate((self.a_name[a + a_mark * len(self.a_bytes)], self.b_name[b + b_mark * len(self.b_bytes)]))[order]).split("\n")[: len(ok)]
        count = lambda e: np.diff(np.searchsorted(e, ends, "right"), prepend=0)
        n = np.stack((count(a_ends), count(b_ends), count(shared)), axis=1)
        for k, u in enumerate(chain(ok, bad), len(self.at)):
            self.at[u] = k
        self.names = np.concatenate((self.names, np.array([*names, *[None] * len(bad)], dtype=object)))
        self.n = np.concatenate((self.n, n, np.zeros((len(bad), 3), dtype=np.int64)))
        self.ragged = np.concatenate((self.ragged, np.array([u != u.strip() or not u for u in chain(ok, bad)], dtype=bool)))
        self.codes = np.concatenate((self.codes, a[a_last] * len(self.b_bytes) + b[b_last]))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate((n[:, 2], np.zeros(len(bad), dtype=np.int64))))))
        self.hits = np.concatenate((self.hits, np.zeros(len(new), dtype=np.int64)))
        self.chars += sum(map(len, new))

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, groups, codes of linked pairs and how often each is linked, for each text."""
        split = [(t.split(" ") if self.cut else [t]) if t else [] for t in texts]
        self.learn(set().union(*split))
        places = lambda words: np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        where = list(map(places, split))
        if self.cut:
            again = {k: _CUT.split(texts[k]) for k, w in enumerate(where) if self.ragged[w].any()}
            self.learn(set().union(*again.values()))
            where = [places(again[k]) if k in again else w for k, w in enumerate(where)]
        names = [self.names[w].tolist() for w in where]
        where = [w[:0] if None in x else w for w, x in zip(where, names, strict=True)]
        doc, unit = np.repeat(np.arange(len(where)), list(map(len, where))), np.concatenate(where)
        n = np.stack([np.bincount(doc, self.n[unit, k], len(where)) for k in range(3)], axis=1).astype(np.int64)
        keys, times = np.unique(doc * len(self.names) + unit, return_counts=True)
        doc, unit = keys // len(self.names), keys % len(self.names)
        self.hits += np.bincount(unit, times, len(self.names)).astype(np.int64)
        sizes = self.first[unit + 1] - self.first[unit]
        codes, doc, times = self.codes[_spread(self.first[unit], sizes)], np.repeat(doc, sizes), np.repeat(times, sizes)
        order = np.lexsort((codes, doc))
        doc, codes, times = doc[order], codes[order], times[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1])))) if len(doc) else np.zeros(0, np.int64)
        codes, times, doc = codes[new], np.add.reduceat(times, new) if len(new) else new, doc[new]
        ends = np.searchsorted(doc, np.arange(len(where) + 1))
        for k, x in enumerate(names):
            mine = slice(ends[k], ends[k + 1])
            yield *map(int, n[k]), int(times[mine].sum()), "" if None in x else ";".join(x), codes[mine], times[mine]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin there and have these sizes, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@lru_cache(2)
def aligner(a_spec: str, b_model: bytes) -> Aligner:
    return Aligner(a_spec, b_model)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times, one row for each input row.

    groups is written `a1,a2|b1;a3|b2,b3`; pairs are the distinct linked ids, A's times the size of B's vocabulary plus
    B's, and times how often the text links them. A null or empty text has no tokens, and one of which either side
    can't give the bytes back has none either: zeros, an empty string and empty arrays. A null doc_id stays null,
    repeated rows stay, an empty table gives no rows, and other columns are not read. A text of any length goes through
    by its units.
    """
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        specs = context.broadcast((a.read(), b.read()))  # two vocabulary files

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        it = aligner(*specs.value)
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            for begin, end in groups(texts, CHARS):
                out = list(zip(*it.align(texts[begin:end]), strict=True))
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[begin:end].tolist(), **dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"), map(list, out), strict=True))})
                it.trim()
        it.forget()

    ids = docs.select(F.col("doc_id").cast("string"), F.col("text"))  # as text, since pandas would make a float of a column with nulls
    return ids.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def vocabulary(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """pair, a_id, b_id, n (links in the corpus), a_most and b_most (the most that any pair of that id has).

    size: of B's vocabulary. The maxima have a row for each id, as many as a vocabulary has.
    """
    n = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    n = durable(n.select("pair", F.expr(f"pair div {size}").alias("a_id"), (F.col("pair") % size).alias("b_id"), "n"))
    return n.join(F.broadcast(n.groupBy("a_id").agg(F.max("n").alias("a_most"))), "a_id").join(F.broadcast(n.groupBy("b_id").agg(F.max("n").alias("b_most"))), "b_id")


def scores(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a, one row for each input row.

    n_best: links whose count is the highest of their B id, ties included; n_best_a: of their A id; count_sum: the sum
    of the links' counts. alignments() states nulls, empty and long texts, repeats and clashing columns.
    """
    tables, size = Tables(docs.sparkSession), vocabulary(b_path)
    shown = alignments(docs, a_path, b_path).withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    rows = tables.write("rows", shown.withColumn("row", F.monotonically_increasing_id()))
    counted = tables.write("counted", pair_counts(rows, size))
    level = F.floor(F.log2("n") * 8).cast("int")  # some 500 levels at most
    least, held = 0, 0
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True):
        held += r["k"]
        if held > HEAVY:
            least = r["level"] + 1
            break
    best = lambda side: (F.col("n") == F.col(f"{side}_most")).alias(f"{side}_best")
    known = counted.select("pair", "n", best("a"), best("b"), (level >= least).alias("heavy"))
    heavy = F.broadcast(known.where("heavy"))  # HEAVY rows at most
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    both = links.join(heavy, "pair", "left")
    sums = lambda x: x.groupBy("row").agg(F.sum(F.when(F.col("b_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("a_best"), F.col("times")).otherwise(0)).alias("n_best_a"))
    parts = sums(both.where("heavy"))
    if least:
        rare = links.join(heavy.select("pair"), "pair", "left_anti").join(known.where("NOT heavy"), "pair")
        parts = parts.union(sums(rare))
    total = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum", "n_best_a")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(total, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_a"))
