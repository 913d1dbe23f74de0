"""Edit-aware token counts: a segment tree of pre-tokens for each document, kept in a table.

A leaf is a run of pre-tokens up to a blank, the smallest unit whose pre-tokens no edit outside it can change. Leaves
stand in slots, and a binary tree over the slots holds sums of characters and tokens. An edit re-encodes the leaves
that it touches, with what is left of the first and last as boundary context, and updates the sums on their paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import slices

SLOT = 32  # leaves in a slot when a tree is laid out; at four times as many the slots are laid out anew
CACHE = 150_000  # leaves and pre-tokens that a task remembers the count of
FEW = 64  # pre-tokens; fewer are encoded one by one
TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"
COUNTS = "n_tokens_before long, n_tokens long, n_chars long, n_encoded_chars long"
EDITS = "array<struct<seq:long,begin:long,end:long,text:string>>"


class Counts:
    """Token counts of leaves, through a codec, remembered within bounds."""

    def __init__(self, codec: bpe.Codec) -> None:
        import regex

        self.codec, self.of, self.words, self.held = codec, {"": 0}, {}, 0
        self.lines = regex.compile(f"(?:{codec.words.pattern})|\n")

    def _learn_words(self, words: set[str]) -> None:
        if len(self.words) > CACHE or self.held > 16 * CACHE:
            self.words = {w: self.words[w] for w in words if w in self.words}
            self.held = sum(map(len, self.words))
        if new := list(words - self.words.keys()):
            self.held += sum(map(len, new))
            if len(new) < FEW:
                self.words.update((w, self.codec.count_word(w)) for w in new)
            else:
                _, ends = self.codec.encode_words(new)
                self.words.update(zip(new, np.diff(ends, prepend=0).tolist(), strict=True))

    def learn(self, leaves: set[str]) -> None:
        """Make the counts of all these leaves (without blanks) known."""
        if len(self.of) > CACHE:
            self.of = {"": 0} | {x: self.of[x] for x in leaves if x in self.of}
        self._learn(leaves)

    def _learn(self, leaves: set[str]) -> None:
        new = list(leaves - self.of.keys())
        if len(new) < FEW:
            split = [self.codec.pretokens(x) for x in new]
            self._learn_words({w for ws in split for w in ws} - self.codec.special.keys())
            self.of.update((x, sum(self.words.get(w, 1) for w in ws)) for x, ws in zip(new, split, strict=True))
            return
        together = "\n".join(new)
        if self.codec.cut and any(s in together for s in self.codec.special) or not _latin(together):
            plain = [x for x in new if _latin(x) and not any(s in x for s in self.codec.special)]
            odd = list(set(new) - set(plain))
            for i in range(0, len(odd), FEW - 1):
                self._learn(set(odd[i : i + FEW - 1]))
            if len(plain) < FEW:
                return self._learn(set(plain))
            new, together = plain, "\n".join(plain)
        words = self.lines.findall(together.lower())
        self._learn_words(set(words) - {"\n"})
        self.words["\n"] = 0
        sums = np.cumsum([0, *map(self.words.__getitem__, words)])
        del self.words["\n"]
        ends = np.flatnonzero(np.array([w == "\n" for w in words] + [True]))
        self.of.update(zip(new, np.diff(sums[ends], prepend=0).tolist(), strict=True))
        return None


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def leaves(text: str) -> tuple[list[str], list[int]]:
    """The text's leaves without their blanks, and their lengths with them."""
    runs = text.replace("\n", " ").split(" ")
    sizes = [len(r) + 1 for r in runs]
    sizes[-1] -= 1
    if not runs[-1]:
        del runs[-1], sizes[-1]
    return runs, sizes


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, counts: Counts, sizes: list[int] | None = None, tokens: list[int] | None = None) -> None:
        """Without the sizes and tokens of a kept tree's leaves the text is encoded."""
        self.counts, self.encoded = counts, 0
        if sizes is None:
            sizes, tokens = self._count(text)
        self._lay_out(text, sizes, tokens)

    def _count(self, text: str) -> tuple[list[int], list[int]]:
        runs, sizes = leaves(text)
        self.counts.learn(set(runs))
        self.encoded += len(text)
        return sizes, [self.counts.of[r] for r in runs]

    def _lay_out(self, text: str, sizes: list[int], tokens: list[int]) -> None:
        self.slots, at = [], 0
        for i in range(0, len(sizes), SLOT):
            part = list(sizes[i : i + SLOT])
            n = sum(part)
            self.slots.append((text[at : at + n], part, list(tokens[i : i + SLOT])))
            at += n
        self.slots = self.slots or [("", [], [])]
        self.size = 1 << (len(self.slots) - 1).bit_length()
        pad = [0] * (self.size - len(self.slots))
        self.chars = [0] * self.size + [len(t) for t, _, _ in self.slots] + pad
        self.tokens = [0] * self.size + [sum(n) for _, _, n in self.slots] + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(t for t, _, _ in self.slots)

    def leaf_arrays(self) -> tuple[list[int], list[int]]:
        return [x for _, s, _ in self.slots for x in s], [x for _, _, n in self.slots for x in n]

    def _find(self, at: int) -> tuple[int, int, int, int]:
        """Slot and its first character, leaf in the slot and its first character; the last leaf holds the end."""
        i, base = 1, 0
        while i < self.size:
            i *= 2
            if at >= base + self.chars[i] and self.chars[i + 1]:
                base += self.chars[i]
                i += 1
        slot, leaf, begin = i - self.size, 0, base
        sizes = self.slots[slot][1]
        while leaf < len(sizes) - 1 and at >= begin + sizes[leaf]:
            begin += sizes[leaf]
            leaf += 1
        return slot, base, leaf, begin

    def edit(self, begin: int, end: int, text: str) -> None:
        """Put text in place of the characters from begin to end; places beyond the text are clipped."""
        begin = max(0, min(begin, self.length))
        end = max(begin, min(end, self.length))
        (s, base, i, at), (e, base2, j, at2) = self._find(begin), self._find(end)
        t, sizes, tokens = self.slots[s]
        t2, sizes2, tokens2 = self.slots[e]
        stop = at2 + (sizes2[j] if sizes2 else 0)
        new = t[at - base : begin - base] + text + t2[end - base2 : stop - base2]
        made, counted = self._count(new)
        self.slots[s] = t[: at - base] + new + t2[stop - base2 :], sizes[:i] + made + sizes2[j + 1 :], tokens[:i] + counted + tokens2[j + 1 :]
        for k in range(s + 1, e + 1):
            self.slots[k] = "", [], []
        if len(self.slots[s][1]) > 4 * SLOT:
            return self._lay_out(self.text, *self.leaf_arrays())
        touched = set()
        for k in range(s, e + 1):
            self.chars[self.size + k], self.tokens[self.size + k] = len(self.slots[k][0]), sum(self.slots[k][2])
            touched.add((self.size + k) // 2)
        while touched - {0}:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched if i > 1}
        return None


def build(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The table of trees: doc_id, text, and characters and tokens of every leaf, one row for each row of docs.

    A null or empty text is a tree without leaves, its text kept as given; repeated rows stay; an empty table gives no
    rows. A column edits goes along; other columns are not read.
    """
    along = ["edits"] if "edits" in docs.columns else []
    spec = bpe.shared_spec(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(bpe.codec(spec.value))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for begin, end in bpe.groups(texts):
                split = [leaves(t or "") for t in texts[begin:end]]
                counts.learn(set().union(*[runs for runs, _ in split]))
                offsets = np.cumsum([0, *(len(s) for _, s in split)]).astype(np.int32)
                ints = lambda xs: pa.ListArray.from_arrays(offsets, pa.array([x for one in xs for x in one], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:end].cast(pa.int64()), batch.column(1)[begin:end].cast(pa.string()), ints(s for _, s in split), ints(map(counts.of.__getitem__, runs) for runs, _ in split), *[batch.column(k)[begin:end] for k in along]],
                    ["doc_id", "text", "leaf_chars", "leaf_tokens", *along],
                )

    rows = docs.select("doc_id", "text", *[F.col(k).cast(EDITS).alias(k) for k in along])
    return rows.mapInArrow(run, TREES + f", edits {EDITS}" * len(along))


def edit(trees: DataFrame, tokenizer_path: str) -> DataFrame:
    """Trees (with a column edits: array of seq, begin, end, text) after their edits in order of seq, and their counts.

    The result has the columns of the table of trees, so that it can be kept and edited again, and counts before and
    after, the length, and the number of characters encoded for the edits. Without edits a tree stays as it is; a null
    edit text deletes; null places are the text's begin and end.
    """
    spec = bpe.shared_spec(trees, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(bpe.codec(spec.value))
        for batch in slices(batches, 256):
            rows = {k: [] for k in ("text", "leaf_chars", "leaf_tokens", "n_tokens_before", "n_tokens", "n_chars", "n_encoded_chars")}
            for text, sizes, tokens, log in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3, 4)], strict=True):
                tree = CountTree(text or "", counts, sizes, tokens)
                before = tree.total
                for e in sorted(log or (), key=lambda e: (e["seq"] is None, e["seq"])):
                    tree.edit(e["begin"] or 0, tree.length if e["end"] is None else e["end"], e["text"] or "")
                if log:
                    text, (sizes, tokens) = tree.text, tree.leaf_arrays()
                for k, v in zip(rows, (text, sizes, tokens, before, tree.total, tree.length, tree.encoded), strict=True):
                    rows[k].append(v)
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]], ["doc_id", *rows])

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, f"{TREES}, {COUNTS}")


def counts(docs: DataFrame, edits: DataFrame | None, tokenizer_path: str) -> DataFrame:
    """Counts of every document before and after its edits (doc_id, seq, begin, end, text; or docs' own column edits).

    Null texts are empty; a document without edits keeps its count; edits of unknown or null documents are passed
    over. One row for each row of docs, repeated rows too.
    """
    if edits is None:
        trees = build(docs, tokenizer_path)
    else:
        grouped = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "begin", "end", "text"))).alias("edits"))
        trees = build(docs.select("doc_id", "text"), tokenizer_path).join(grouped, "doc_id", "left")
    return edit(trees, tokenizer_path).select("doc_id", *re.findall(r"n_\w+", COUNTS))
