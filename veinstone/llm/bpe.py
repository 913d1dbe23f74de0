"""BPE encoding and decoding by forced-boundary splitting.

Two adjacent symbols that stand together inside no vocabulary token can never be merged across, so a cut between
them is certain. Pre-tokens are cut there, their fragments are encoded on their own and the ids are concatenated.
Fragments of many pre-tokens are merged side by side, each at its own lowest-ranked pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE_WORDS, CACHE_CHARS = 200_000, 4_000_000  # what one task remembers of pre-tokens; the rest is encoded anew
GROUP_CHARS = 2_000_000  # of text whose new pre-tokens are encoded at once; a longer text goes in parts of that size
LONG = 64  # symbols; longer fragments are merged by a heap
NEVER = 1 << 40  # above every merge's rank
_BLANK = re.compile("[ \n]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, as byte-level vocabularies write it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def parts(text: str, size: int = GROUP_CHARS) -> Iterator[str]:
    """The text in parts that end behind a blank, which no token, special or not, spans."""
    begin = 0
    while len(text) - begin > size:
        blank = _BLANK.search(text, begin + size)
        if not blank:
            break
        yield text[begin : blank.end()]
        begin = blank.end()
    yield text[begin:] if begin else text


class Codec:
    """Encoder and decoder for a byte-level vocabulary with an end-of-word suffix."""

    def __init__(self, spec: str) -> None:
        import regex
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.unit_ids = np.array([vocab[s] for s in symbols] + [vocab[s + self.suffix] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = self.n = len(self.tokens)
        keys = np.array([vocab[a] * n + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made  # made is by rank
        born = np.full(n, -1)
        born[made] = np.arange(len(made))
        # a token comes from one merge alone, before any that uses it: so all places of the lowest pair can be merged at once
        self.ordered = len(set(made.tolist())) == len(made) and bool((np.maximum(born[keys // n], born[keys % n]) < np.arange(len(keys))).all())
        self.joinable = self._inner_pairs(vocab, symbols)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.normalize = Tokenizer.from_str(spec).normalizer.normalize_str
        self.forget()

    def _inner_pairs(self, vocab: Iterable[str], symbols: list[str]) -> np.ndarray:
        """Whether two symbols (bytes, then bytes that end a word) stand together inside a token."""
        at = {s: i for i, s in enumerate(symbols)}
        seen = np.zeros((512, 512), dtype=bool)
        for token in vocab:
            end = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            units = [at[c] for c in (token[: -len(self.suffix)] if end else token)]
            units[-1] += 256 * end
            seen[units[:-1], units[1:]] = True
        return seen

    def forget(self) -> None:
        """Free what is remembered of pre-tokens: a worker outlives its task."""
        self.ids_of: dict[str, str] = {t: str(i) for t, i in self.special.items()}
        self.text_of: dict[str, str] = {t: t for t in self.special}
        self.held = 0
        self.ranked: dict[int, int] | None = None

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order."""
        if self.cut and any(s in text for s in self.special):
            return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.pretokens(part))]
        try:
            text.encode("latin-1")
            text = text.lower()  # below U+0100 composition changes nothing, and letters are lowered one by one
        except UnicodeEncodeError:
            text = self.normalize(text)
        return self.words.findall(text)

    def learn(self, words: set[str]) -> None:
        """Encode the pre-tokens not yet known."""
        new = words - self.ids_of.keys()
        if not new:
            return
        self.held += sum(map(len, new))
        if len(self.ids_of) + len(new) > CACHE_WORDS or self.held > CACHE_CHARS:
            kept = [(w, self.ids_of[w], self.text_of[w]) for w in words if w in self.ids_of]  # met again, so likely frequent
            self.forget()
            for word, names, tokens in kept:
                self.ids_of[word], self.text_of[word] = names, tokens
            self.held = sum(map(len, words))
        new = list(new)
        ids, ends = self.encode_words(new)
        names, tokens, begin = list(map(str, ids)), [self.tokens[i] for i in ids], 0
        for word, end in zip(new, ends, strict=True):
            self.ids_of[word] = " ".join(names[begin:end])
            self.text_of[word] = " ".join(tokens[begin:end])
            begin = end

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """ids of all pre-tokens in a row, and where each one's ids end."""
        raw = [w.encode() for w in words]
        units = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(b) for b in raw])
        units[ends - 1] += 256
        cut = np.ones(len(units), dtype=bool)  # behind a unit
        cut[:-1] = ~self.joinable[units[:-1], units[1:]]
        cut[ends - 1] = True
        frag = np.concatenate(([0], np.cumsum(cut)[:-1]))
        out = self._merge(self.unit_ids[units], frag)
        live = out >= 0
        return out[live].tolist(), np.cumsum(live)[ends - 1].tolist()

    def count_word(self, word: str) -> int:
        """Tokens of one pre-token, without the arrays that pay for many."""
        raw = word.encode()
        units = [*raw[:-1], raw[-1] + 256]
        ids, n, begin = self.unit_ids[units].tolist(), 0, 0
        for k in range(1, len(units) + 1):
            if k == len(units) or not self.joinable[units[k - 1], units[k]]:
                n += sum(i >= 0 for i in self._merge_long(ids[begin:k])) if k > begin + 1 else 1
                begin = k
        return n

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _merge(self, ids: np.ndarray, frag: np.ndarray) -> np.ndarray:
        """The ids left by merging inside fragments, each at its token's first place; -1 elsewhere."""
        out = np.full(len(ids), -1)
        sizes = np.bincount(frag)
        at = np.arange(len(ids))
        long = np.flatnonzero(sizes > LONG) if self.ordered else np.flatnonzero(sizes > 1)
        if len(long):
            begins = np.concatenate(([0], np.cumsum(sizes)))
            for f in long:
                b, e = begins[f], begins[f + 1]
                out[b:e] = self._merge_long(ids[b:e].tolist())
            rest = ~np.isin(frag, long)
            ids, frag, at = ids[rest], frag[rest], at[rest]
        if not len(ids):
            return out
        rank = np.full(len(ids), NEVER)
        inner = np.flatnonzero(frag[:-1] == frag[1:])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            least = np.repeat(least, size)
            done = least == NEVER
            if done.any():
                out[at[done]] = ids[done]
                live = ~done
                ids, frag, at, rank, least = ids[live], frag[live], at[live], rank[live], least[live]
                if not len(ids):
                    break
            chosen = rank == least
            if (both := chosen[1:] & chosen[:-1]).any():  # a run of one symbol: its pairs from the left
                place = np.arange(len(ids))
                start = np.maximum.accumulate(np.where(chosen & ~np.concatenate(([False], both)), place, 0))
                chosen &= (place - start) % 2 == 0
            p = np.flatnonzero(chosen)
            ids[p] = self.made[rank[p]]
            keep = np.ones(len(ids), dtype=bool)
            keep[p + 1] = False
            ids, frag, at, rank = ids[keep], frag[keep], at[keep], rank[keep]
            p = (np.cumsum(keep) - 1)[p]
            near = np.zeros(len(ids), dtype=bool)
            near[p] = near[p[p > 0] - 1] = True
            rank[near] = NEVER
            near[-1] = False
            p = np.flatnonzero(near)
            p = p[frag[p] == frag[p + 1]]
            rank[p] = self.rank(ids[p], ids[p + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first, by a heap: n log n in the fragment."""
        n = len(ids)
        if self.ranked is None:
            self.ranked = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        get, after, before = self.ranked.get, list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i, j: ids[i] * self.n + ids[j]
        heap = [(r, i) for i in range(n - 1) if (r := get(pair(i, i + 1))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or get(pair(i, j)) != r:
                continue
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (m := get(pair(left, right))) is not None:
                    heapq.heappush(heap, (m, left))
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in parts(text):
            words = self.pretokens(part)
            self.learn(set(words))
            out += [int(i) for w in words for i in self.ids_of[w].split(" ")]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the vocabulary file the tokens are joined by one space."""
        return " ".join([self.tokens[i] for i in ids])


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The worker's codec of a vocabulary file; one is kept, some 15 MB."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def shared_spec(docs: DataFrame, tokenizer_path: str):
    """The vocabulary file as a broadcast; the driver alone reads it and its size is that of one tokenizer."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def groups(texts: list[str | None], size: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about that many characters together."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= size or i == len(texts) - 1:
            yield begin, i + 1
            begin, held = i + 1, 0


def _encoder(docs: DataFrame, tokenizer_path: str, with_ids: bool) -> DataFrame:
    spec = shared_spec(docs, tokenizer_path)

    def digests(c: Codec, texts: list[str | None]) -> Iterator[tuple[int, str, str, np.ndarray | None]]:
        for begin, end in groups(texts):
            if end - begin > 1:
                split = [[c.pretokens(t or "")] for t in texts[begin:end]]
                c.learn(set().union(*[w for (w,) in split]))
            else:
                split = [(c.pretokens(p) for p in parts(texts[begin] or ""))]
            for runs in split:
                n, ids_sha, text_sha, ids = 0, hashlib.sha256(), hashlib.sha256(), []
                for words in runs:
                    if not words:
                        continue
                    if end - begin == 1:
                        c.learn(set(words))
                    names = " ".join(map(c.ids_of.__getitem__, words))
                    gap = " " if n else ""
                    ids_sha.update((gap + names).encode())
                    text_sha.update((gap + " ".join(map(c.text_of.__getitem__, words))).encode())
                    n += names.count(" ") + 1
                    if with_ids:
                        ids.append(np.fromstring(names, dtype=np.int32, sep=" "))
                yield n, ids_sha.hexdigest(), text_sha.hexdigest(), (np.concatenate(ids) if ids else np.zeros(0, np.int32)) if with_ids else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        try:
            for batch in slices(batches):
                n, ids_sha, text_sha, ids = zip(*digests(c, batch.column(1).to_pylist()), strict=True)
                columns = {"doc_id": batch.column(0).cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_pydict(columns)
        finally:
            c.forget()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def encode_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text, one row for each input row.

    A null or empty text has no tokens; a null doc_id stays null; repeated rows stay; an empty table gives no rows;
    other columns are not read. A long text goes through in parts that end at blanks.
    """
    return _encoder(docs, tokenizer_path, with_ids=False)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """encode_digest's columns and the ids themselves, an array of integers; null and empty texts have an empty one."""
    return _encoder(docs, tokenizer_path, with_ids=True)
