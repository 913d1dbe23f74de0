"""Secret scans: candidate strings judged by a random forest fitted on labelled findings.

The forest sees a candidate's length, its character transitions under a model of words, its coverage by a dictionary,
its path and the words on either side. Dictionary and transitions come from the words of all documents. No table labels findings, so they are made here with a fixed seed: of every kind of
candidate both random keys and what is taken for them, such as placeholders, identifiers, hashes and examples.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key

TREES, DEPTH, FINDINGS, SEED, THRESHOLD = 25, 9, 4000, 7, 0.5
TEXTS, OF = 3, 5_000  # a word of the dictionary stands in 3 texts and in 3 of 5,000 at least; scraps of keys stand in fewer
AROUND = 40  # characters on either side of a candidate that count as neighbouring words
MASK = "[SECRET]"
# Names that introduce a credential, prefixes of issued keys, words that mark a harmless value.
NAMES = "api_key apikey api-key access_key access_token auth_token client_secret passwd password private_key secret secret_key token"
PREFIXES = "AKIA ASIA AIza ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk- xoxb- xoxp- hf_ npm_"
HARMLESS = "checksum commit digest dummy etag example fake fingerprint hash id integrity md5 placeholder revision sample sha sha1 sha256 sha512 test uuid version your"
CREDENTIAL = "auth bearer credential key passwd password secret signing token"
_NAMES, _PREFIXES, _HARMLESS, _CREDENTIAL = NAMES.split(), PREFIXES.split(), set(HARMLESS.split()), set(CREDENTIAL.split())
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<pem>(?:(?!-----BEGIN)[\s\S]){16,}?)-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?i:(?<![^\W_])(?P<name>" + "|".join(sorted(map(re.escape, _NAMES), key=len, reverse=True)) + r")[\"']?\s*(?:=|:)\s*[\"']?(?P<value>[A-Za-z0-9_+/=.\-]{8,}))"
    r"|(?<![A-Za-z0-9])(?P<issued>(?:" + "|".join(map(re.escape, _PREFIXES)) + r")[A-Za-z0-9_\-]{16,})"
    r"|(?<![A-Za-z0-9])(?P<jwt>eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"
    r"|(?<![A-Za-z0-9+/_.\-])(?P<bare>[A-Za-z0-9+/_\-]{32,}={0,2})(?![A-Za-z0-9])"
)
_KINDS = ("pem", "value", "issued", "jwt", "bare")
_MIGHT = re.compile(r"[A-Za-z0-9+/_\-]{32}|(?i:" + "|".join(map(re.escape, ("key", "pass", "secret", "token"))) + ")")
_OPENINGS = ("-----BEGIN", "eyJ", *_PREFIXES)
SCHEMA = "struct<n_candidates:long,findings:array<struct<begin:int,end:int,kind:string,score:double>>,masked:string>"


_SYMBOL = {c: i for i, c in enumerate(string.ascii_lowercase)} | dict.fromkeys(string.digits, 26)


class Words:
    """A dictionary of words and the log probabilities of going from one character of them to the next."""

    def __init__(self, counts: list[tuple[str, int]]) -> None:
        self.known = frozenset(w for w, _ in counts if len(w) >= 3)
        self.longest = max(map(len, self.known), default=0)
        seen = np.full((28, 28), 0.5)
        for word, n in counts:
            at = [_SYMBOL.get(c, 27) for c in word]
            for a, b in zip(at, at[1:], strict=False):
                seen[a, b] += math.log1p(n)
        self.steps = np.log(seen / seen.sum(axis=1, keepdims=True)).tolist()

    def transitions(self, value: str) -> float:
        """The mean log probability of a value's steps from character to character."""
        at = [_SYMBOL.get(c, 27) for c in value.lower()]
        return sum(self.steps[a][b] for a, b in zip(at, at[1:], strict=False)) / max(1, len(at) - 1)

    def coverage(self, value: str) -> float:
        """The share of a value's characters in words of the dictionary, the longest first from the left."""
        covered = 0
        for piece in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", value):
            piece, i = piece.lower(), 0
            while i < len(piece) - 2:
                size = next((k for k in range(min(self.longest, len(piece) - i), 2, -1) if piece[i : i + k] in self.known and (k >= 4 or k == len(piece))), 0)
                covered += size
                i += size or 1
        return covered / len(value)


def features(value: str, before: str, after: str, path: str, words: Words) -> list[float]:
    """Numbers for one candidate; before and after: the characters on either side, path: where its text comes from."""
    n = len(value)
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    freq = [value.count(c) / n for c in set(value)]
    near = lambda text: set(re.findall(r"[a-z]+[0-9]*", text.lower()))
    ahead, behind, own = near(before), near(after), near(value)
    return [
        math.log(n), changes / max(1, n - 1), words.transitions(value), -sum(p * math.log2(p) for p in freq), sum(c == 0 for c in classes) / n, sum(c == 3 for c in classes) / n,
        words.coverage(value), float(bool(ahead & _CREDENTIAL)), float(bool(ahead & _HARMLESS)), float(bool(behind & _HARMLESS)), float(bool(own & _HARMLESS) or "example" in value.lower()),
        float(value.startswith(tuple(_PREFIXES))), float(bool(re.search(r"test|example|fixture|sample|doc", path.lower()))), max(freq), float(bool(re.fullmatch(r"[0-9a-fA-F\-]+", value))),
    ]


def labelled_findings(words: Words, n: int = FINDINGS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Made findings with their labels, 1 for a secret; each kind of candidate has both."""
    r = random.Random(seed)
    hexes, full, wide = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    text = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = "the an er in on re th ing en de la que ver sch".split()
    listed = sorted(words.known) if len(words.known) >= 50 else []
    word = lambda: r.choice(listed) if listed else "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    joined = lambda k: r.choice(["-", "_", ".", "/"]).join(word() for _ in range(k))
    camel = lambda k: "".join(word().title() for _ in range(k))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 4)))
    flat = lambda: r.choice(["x", "X", "*", "0", "-", "_", "a", "A", "."]) * r.randint(16, 60)
    key = lambda: r.choice([lambda: text(hexes, r.choice([16, 24, 32, 40, 64])), lambda: text(full, r.randint(12, 48)), lambda: text(wide, r.choice([32, 40, 44, 64]))])()
    named = lambda: f"{prose()} {r.choice(_NAMES)}{r.choice([' = ', ': ', '=', ' = \"'])}"
    harmless = lambda: f"{prose()} {r.choice(sorted(_HARMLESS))}{r.choice([': ', ' ', '=', ' = '])}"
    holder = lambda: r.choice(["changeme", "your_token_here", "example-password", "placeholder", "xxxxxxxxxxxx", "insert-your-key-here", "YOUR_API_KEY_HERE", "1234567890123456"])
    ours = lambda: r.choice(["src1", "config/app.yml", "lib/main.py", "notes", ".env", "web", ""])
    shown = lambda: r.choice(["docs/a.md", "tests/fixtures/b.py", "examples/c.sh"])
    good = [
        lambda: (key(), named(), "", ours()), lambda: (key(), named(), "", ours()), lambda: (key(), named(), "", shown()), lambda: (r.choice(_PREFIXES) + text(full, r.randint(16, 40)), r.choice([prose(), named()]), "", ours()),
        lambda: (r.choice(_PREFIXES) + text(full, r.randint(16, 40)), prose(), "", shown()), lambda: ("eyJ" + text(full, 20) + ".eyJ" + text(full, 30) + "." + text(full + "-_", 40), r.choice(["Bearer ", prose(), named()]), "", ours()),
        lambda: ("\n" + "\n".join(text(wide, 64) for _ in range(r.randint(2, 20))) + "\n", "", "", ours()), lambda: (text(wide, r.choice([32, 40, 64])), f"{prose()} {r.choice(sorted(_CREDENTIAL))} ", "", ours()),
    ]
    bad = [
        lambda: (joined(r.randint(2, 4)), named(), "", ours()), lambda: (camel(r.randint(2, 4)), named(), "", ours()), lambda: (holder(), named(), "", ours()), lambda: (key(), f"{harmless()} {r.choice(_NAMES)}: ", "", shown()),
        lambda: (key(), named(), " " + r.choice(["example", "sample", "dummy", "placeholder", "test"]), shown()), lambda: (r.choice(_PREFIXES) + r.choice([flat, lambda: joined(4), lambda: text(full, 9) + "EXAMPLE", lambda: camel(3)])(), r.choice([prose(), named()]), "", ours()),
        lambda: ("eyJ" + flat() + ".eyJ" + flat() + "." + flat(), r.choice(["Bearer ", named()]), "", ours()), lambda: ("eyJ" + text(full, 20) + ".eyJ" + text(full, 30) + "." + text(full, 40), "example ", " example", shown()),
        lambda: ("\n" + r.choice([flat(), "...", " ".join(word() for _ in range(8)), "YOUR KEY GOES HERE example"]) + "\n", "", "", ours()), lambda: (text(hexes, r.choice([32, 40, 64])), harmless(), "", ours()),
        lambda: (joined(r.randint(5, 9)), prose(), prose(), ours()), lambda: (flat(), prose(), "", ours()), lambda: (text(string.digits, r.randint(32, 48)), prose(), "", ours()), lambda: (text(wide, 64) + "==", "integrity sha512-", "", ours()),
        lambda: ("-".join(text(hexes, k) for k in (8, 4, 4, 4, 12)), harmless(), "", ours()),
    ]
    rows, labels = [], []
    for i in range(n):
        value, before, after, path = r.choice(good if i % 2 else bad)()
        rows.append(features(value, before[-AROUND:], after[:AROUND], path, words))
        labels.append(i % 2)
    return np.array(rows), np.array(labels, dtype=float)


class Forest:
    """Bagged Gini trees over a random third of the features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        self.rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = self.rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple | float:
        mean = float(y.mean())
        if depth == 0 or len(y) < 8 or mean in (0.0, 1.0):
            return mean
        best = (1e9, 0, 0.0)
        for f in self.rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
                left = x[:, f] <= cut
                if 0 < (k := int(left.sum())) < len(y):
                    p, q = y[left].mean(), y[~left].mean()
                    best = min(best, (k * p * (1 - p) + (len(y) - k) * q * (1 - q), int(f), float(cut)))
        if best[0] > 1e8:
            return mean
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def score(self, row: list[float]) -> float:
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.trees)


class Model:
    """Words and the forest fitted on findings made from them."""

    def __init__(self, counts: list[tuple[str, int]]) -> None:
        self.words = Words(counts)
        self.forest = Forest(*labelled_findings(self.words))

    def score(self, value: str, before: str, after: str, path: str) -> float:
        return self.forest.score(features(value, before, after, path, self.words))


def fit(docs: DataFrame) -> Model:
    """Take words from all of docs; those that TEXTS of its texts, and TEXTS of OF, hold make the dictionary.

    Every text is counted. The bar rises with the number of texts, since scraps of keys repeat in more of them; so the
    dictionary doesn't grow with the table. Null texts have no words; copies of a text count once, told by their digests
    so that words and not texts are shuffled; without any word the findings are made of syllables.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{3,20}(?![a-z])"), F.lit(0)))
    texts = docs.where(F.col("text").isNotNull()).select(text_key().alias("key"), F.array_join(found, " ").alias("words")).dropDuplicates(["key"])  # as one string, a shuffle takes less
    words = texts.select(F.explode(F.split(F.when(F.col("words") == "", "").otherwise(F.concat("words", F.lit(" "))), " ")).alias("word"))
    counts = words.groupBy("word").count()  # the empty word counts the texts
    every = counts.where("word = ''").select(F.col("count").alias("n"))
    kept = counts.where("word <> ''").crossJoin(F.broadcast(every)).where((F.col("count") >= TEXTS) & (F.col("count") * OF >= F.col("n") * TEXTS))
    return Model([tuple(r) for r in kept.select("word", "count").orderBy("word").collect()])


def might(text: str) -> bool:
    """Whether text can hold a candidate: a cheap test that every match of CANDIDATE passes."""
    return any(x in text for x in _OPENINGS) or _MIGHT.search(text) is not None


def scan(text: str | None, path: str | None, model: Model) -> tuple[int, list[tuple[int, int, str, float]], str | None]:
    """Number of candidates, findings (begin, end, kind, score) by code point, and the text with each one masked."""
    if not text or not might(text):
        return 0, [], text
    n, found, parts, last = 0, [], [], 0
    for m in CANDIDATE.finditer(text):
        kind = next(k for k in _KINDS if m[k] is not None)
        n += 1
        begin, end = m.span() if kind == "pem" else m.span(kind)
        score = model.score(m[kind], text[max(0, begin - AROUND) : begin], text[end : end + AROUND], path or "")
        if score >= THRESHOLD:
            found.append((begin, end, kind, round(score, 6)))
            parts += [text[last:begin], MASK]
            last = end
    return n, found, "".join(parts) + text[last:] if found else text


def _scanned(docs: DataFrame, model: Model | None) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.pandas_udf(SCHEMA.removeprefix("struct<")[:-1].replace(":long", " long").replace("findings:", "findings ").replace("masked:string", "masked string"))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts, paths in batches:
            rows = [scan(t, p, model) for t, p in zip(texts, paths, strict=True)]
            yield pd.DataFrame({"n_candidates": [r[0] for r in rows], "findings": [[dict(zip(("begin", "end", "kind", "score"), f, strict=True)) for f in r[1]] for r in rows], "masked": [r[2] for r in rows]})

    return run("text", F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string"))


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with a struct column ``secrets``: n_candidates, findings and masked text; it replaces a column of that name.

    Every row stays, repeated ones too. A null or empty text has no findings and stays null or empty; a null or absent
    source is an empty path; an empty table gives no rows. Texts are scanned whole. Without a model one is fitted on docs.
    """
    return docs.withColumn("secrets", _scanned(docs, model))


def mask_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every finding masked in text and, if there is one, n_chars brought up to date; all rows and columns stay.

    Columns of any other name pass unread. A null text stays null and its n_chars as given.
    """
    names = docs.columns
    scanned = docs.select(*[F.col(f"`{c}`") for c in names], _scanned(docs, model).alias("_secret_scan"))
    found = F.size("_secret_scan.findings") > 0
    new = {"text": F.col("_secret_scan.masked"), "n_chars": F.when(found, F.length("_secret_scan.masked").cast("long")).otherwise(F.col("n_chars") if "n_chars" in names else F.lit(None))}
    return scanned.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in names])
