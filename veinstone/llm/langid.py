"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its longest known character
n-grams, from four characters down to one, over its whole length.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 20_000  # labelled documents, in the mean, that a model is fitted on
GRAMS = (4, 3, 2, 1)
LONG = 60  # letters; n-grams of longer runs are counted by Spark, others' from the counts of the words; the sums are the same
STEP = 200
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")
SCHEMA = "lang_pred string, score double"


class Counts:
    """Counts of keys in each language: a number for each key, and the counts side by side, without an object for each."""

    def __init__(self, langs: int) -> None:
        self.langs, self.rows, self.cells = langs, {}, array("d")

    def add(self, key: str, lang: int, n: int) -> None:
        row = self.rows.setdefault(key, len(self.rows))
        if row * self.langs == len(self.cells):
            self.cells.extend([0.0] * self.langs)
        self.cells[row * self.langs + lang] += n

    def logs(self) -> tuple[dict[str, int], np.ndarray]:
        """The row of each key, and rows of log frequencies by language."""
        if not self.rows:
            return {}, np.zeros((0, 0))
        rows = np.frombuffer(self.cells).reshape(-1, self.langs) + 0.5
        return self.rows, np.log(rows) - np.log(rows.sum(axis=0))


class Rows:
    """The rows of an Arrow table as tuples, a batch at a time, as often as they are asked for."""

    def __init__(self, held: pa.Table) -> None:
        self.held = held

    def __iter__(self) -> Iterator[tuple]:
        for batch in self.held.to_batches(max_chunksize=8192):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class Model:
    """Log frequencies of words and character n-grams in each language."""

    def __init__(self, counts: Iterable[tuple[str, str, int]], long_grams: Iterable[tuple[str, str, int]] = ()) -> None:
        """counts: (lang, word, n); long_grams: (lang, n-gram, n) of the words of over LONG letters, which counts has as words alone. Both are read twice."""
        self.langs = sorted({lang for rows in (counts, long_grams) for lang, _, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        words, grams = Counts(len(at)), {size: Counts(len(at)) for size in GRAMS}
        for lang, word, n in counts:
            words.add(word, at[lang], n)
            for size in GRAMS if len(word) <= LONG else ():
                for i in range(len(word) - size + 1):
                    grams[size].add(word[i : i + size], at[lang], n)
        for lang, gram, n in long_grams:
            grams[len(gram)].add(gram, at[lang], n)
        self.words, self.word_logs = words.logs()
        self.grams, self.gram_logs = map(list, zip(*(grams[size].logs() for size in GRAMS), strict=True))

    def __getstate__(self) -> dict:
        """Keys as one string for each table, since a pickle remembers every string that it holds."""
        return {**self.__dict__, "words": "\n".join(self.words), "grams": ["\n".join(g) for g in self.grams]}

    def __setstate__(self, state: dict) -> None:
        numbered = lambda keys: {k: i for i, k in enumerate(keys.split("\n"))} if keys else {}  # noqa: E731  of letters alone
        self.__dict__.update(state, words=numbered(state["words"]), grams=[numbered(g) for g in state["grams"]])

    def backoff(self, word: str) -> np.ndarray | float:
        """The mean over the longest n-grams of which the model knows any; nothing if it knows none."""
        for size, at, logs in zip(GRAMS, self.grams, self.gram_logs, strict=True):
            total, known = 0.0, 0
            for begin in range(0, len(word) - size + 1, STEP * 50):  # a long run goes in steps
                rows = [r for i in range(begin, min(begin + STEP * 50, len(word) - size + 1)) if (r := at.get(word[i : i + size])) is not None]
                if rows:
                    total, known = total + logs[rows].sum(axis=0), known + len(rows)
            if known:
                return total / known
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and posterior share; ``und`` and 0 for texts without a letter or a model without languages."""
        words = Counter(_WORD.findall((text or "").lower()))
        if not words or not self.langs:
            return UNKNOWN, 0.0
        known, weights, total = [], [], np.zeros(len(self.langs))
        for word, n in words.items():
            if (row := self.words.get(word)) is not None:
                known.append(row)
                weights.append(n)
            else:
                total += n * self.backoff(word)
        if known:
            total += np.asarray(weights) @ self.word_logs[known]
        best = int(np.argmax(total))
        return self.langs[best], 1 / sum(math.exp(max(-700.0, min(0.0, x - total[best]))) for x in total)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a sample of the rows of docs that have a text and a lang; the number of rows is bounded.

    Rows without either teach nothing and repeated rows count each time; without any labelled row the model knows no
    language. The sample is drawn by text and doc_id, so that one text on many rows is neither all in nor all out.
    All words and n-grams of the sampled rows are learned, whole texts, however rare or long.
    """
    drawn_by = ["text", *(c for c in ("doc_id",) if c in docs.columns)]
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", *drawn_by)
    n = labelled.count()
    if n > sample_docs:
        labelled = labelled.where(F.pmod(F.xxhash64(*drawn_by), F.lit(1 << 60)) < (1 << 60) * sample_docs // n)
    words = labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = lambda x, key: Rows(x.groupBy("lang", key).count().toArrow())  # noqa: E731  of the sample
    # long runs go in steps, each with the letters that its last n-grams reach beyond it, so that no row holds all n-grams of a run
    starts = F.explode(F.sequence(F.lit(1), F.length("word"), F.lit(STEP))).alias("start")
    part = F.substring(F.col("word"), F.col("start"), F.lit(STEP + max(GRAMS) - 1)).alias("part")
    parts = words.where(F.length("word") > LONG).select("lang", "word", starts).select("lang", part)
    cut = lambda size: F.transform(F.sequence(F.lit(1), F.lit(STEP)), lambda i: F.substring(F.col("part"), i, F.lit(size)))
    whole = F.concat(*[F.filter(cut(size), lambda g: F.length(g) == F.lit(size)) for size in GRAMS])
    long_grams = counted(parts.select("lang", F.explode(whole).alias("gram")), "gram")
    return Model(counted(words, "word"), long_grams)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with lang_pred and score, in place of columns of those names.

    Every row stays, repeated ones too; the text alone is read for a prediction. A null text and one without a letter,
    however long, are ``und`` with a score of 0, and so is every text where the model knows no language; of languages
    that score alike the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    found = predict("text")
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    held = docs.select(*[F.col(f"`{c}`") for c in names], found.alias("_found_language"))
    return held.select(*[F.col(f"`{c}`") for c in names], "_found_language.lang_pred", "_found_language.score")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
