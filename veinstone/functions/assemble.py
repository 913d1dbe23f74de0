"""Texts cut and put together inside the JVM: chunks, windows around a hit, hard limits, and neighbours without what they repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HANZI, TOKEN, WHITE, let

# Overlaps, windows and look-around in characters or lines.
SEAM_LINES, SEAM_SUBSTANCE, OVERLAP_LEAST, OVERLAP_MOST = 10, 25, 12, 300
LOOK, MARGIN, LEAST_FALLBACK, MARK = 80, 160, 32, "…"


def trimmed(text: Column, ends: str = "^{0}+|{0}+\\z") -> Column:
    return F.regexp_replace(text, f"(?U){ends.format(WHITE)}", "")


def _blank(text: Column) -> Column:
    return trimmed(text) == ""


def _greatest_of(n: Column, least: int, fits: Callable[[Column], Column]) -> Column:
    """The greatest number from n down to a least one that fits; 0 if none does."""
    numbers = F.when(n >= least, F.sequence(n, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(numbers, fits), F.lit(0)), F.lit(0))


def chunked(text: Column, limit: int = 500) -> Column:
    """Paragraphs in order, as many to a chunk as its limit of characters takes; what is longer alone is cut at the limit.

    A chunk is known to be full when the paragraph behind it comes: the fold holds the full ones and the open one.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: trimmed(p)), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("open"))

    def add(s: Column, p: Column) -> Column:
        longer = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        closed = F.when(s["open"] == "", s["full"]).otherwise(F.array_append(s["full"], s["open"]))
        starts = F.sequence(F.lit(1), F.length(p), F.lit(limit))
        cut = F.transform(starts, lambda i: F.substring(p, i, F.lit(limit)))
        both = F.struct(F.concat(closed, F.slice(cut, F.lit(1), F.size(cut) - 1)).alias("full"), F.element_at(cut, -1).alias("open"))
        return F.when(F.length(longer) <= limit, F.struct(s["full"].alias("full"), longer.alias("open"))).otherwise(both)

    end = lambda s: F.when(s["open"] == "", s["full"]).otherwise(F.array_append(s["full"], s["open"]))
    return F.when(text.isNotNull(), F.aggregate(paragraphs, state, add, end))


def hit(text: Column, query: Column) -> Column:
    """Characters before the first token of the query in the text or, if none stands there, before its first pair of Hanzi; null without either."""
    first = lambda found: F.array_min(F.filter(found, lambda i: i > 0)) - 1
    tokens = F.filter(F.regexp_extract_all(F.lower(query), F.lit(TOKEN), 0), lambda t: F.length(t) >= 2)
    runs = F.regexp_extract_all(query, F.lit(f"{HANZI}{{2,}}"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return let(F.lower(text), lambda low: F.coalesce(first(F.transform(tokens, lambda t: F.position(t, low))), first(F.transform(pairs, lambda p: F.position(p, text)))))


def snippet(text: Column, query: Column, size: int) -> Column:
    """A window of about size characters around the first hit, or of the beginning, whose edges go out to the ends of lines if these are near."""
    part = lambda a, b: F.substring(text, a + 1, b - a)  # noqa: E731  characters a to b
    n = F.length(text)

    def window(at: Column) -> Column:
        behind, ahead = F.greatest(at["a"] - LOOK, F.lit(0)), F.least(at["b"] + LOOK, n)
        line = F.substring_index(part(behind, at["a"]), "\n", -1)  # of a piece without a line end it is all
        edges = F.struct((at["a"] - F.length(line)).alias("a"), (at["b"] + F.length(F.substring_index(part(at["b"], ahead), "\n", 1))).alias("b"))
        return let(edges, lambda e: F.concat(F.when(e["a"] > 0, MARK).otherwise(""), trimmed(part(e["a"], e["b"]), "{0}+\\z"), F.when(e["b"] < n, MARK).otherwise("")))

    begin = F.greatest(F.coalesce(hit(text, F.coalesce(query, F.lit(""))), F.lit(0)) - max(1, size // 2), F.lit(0))
    shown = let(let(begin, lambda a: F.struct(a.alias("a"), F.least(a + size, n).alias("b"))), window)
    head = F.concat(trimmed(F.substring(text, F.lit(1), F.lit(max(size, LEAST_FALLBACK))), "{0}+\\z"), F.lit(MARK))
    whole = F.lit(size <= 0) | (n <= size)
    return F.when(text.isNull() | whole, text).otherwise(let(shown, lambda w: F.when(_blank(F.regexp_replace(w, f"^{MARK}+|{MARK}+\\z", "")), head).otherwise(w)))


def bounded(text: Column, query: Column, most: int) -> Column:
    """The text, or a snippet of it, in no more than that many characters."""
    cut = lambda w: F.when(F.length(w) <= most, w).otherwise(F.concat(trimmed(F.substring(w, F.lit(1), F.lit(max(most - len(MARK), 0))), "{0}+\\z"), F.lit(MARK[: max(most, 0)])))
    return F.when(text.isNull() | F.lit(most <= 0) | (F.length(text) <= most), text).otherwise(let(snippet(text, query, max(1, most - MARGIN)), cut))


def added(left: Column, text: Column) -> Column:
    """What a text adds to the one before it: nothing that ends the one and begins the other comes twice.

    Lines are compared first, up to ten, and count if they are two or one of some length; then characters.
    """

    def by_lines(lines: Column) -> Column:
        ours, theirs = lines["ours"], lines["theirs"]
        most = F.least(F.size(ours), F.size(theirs), F.lit(SEAM_LINES))
        run = _greatest_of(most, 1, lambda n: F.slice(ours, -n, n) == F.slice(theirs, F.lit(1), n))
        rest = lambda n: F.array_join(F.slice(theirs, n + 1, F.size(theirs)), "\n")
        known = lambda n: (n > 1) | ((n == 1) & (F.length(F.get(theirs, F.lit(0))) >= SEAM_SUBSTANCE))
        return let(run, lambda n: F.when(known(n), let(rest(n), lambda r: F.when(_blank(r), "").otherwise(F.concat(F.lit("\n"), r)))))

    def by_characters(tail: Column) -> Column:
        same = _greatest_of(F.least(F.length(tail), F.length(text)), OVERLAP_LEAST, lambda n: F.endswith(tail, F.substring(text, F.lit(1), n)))
        return let(same, lambda n: F.substring(text, n + 1, F.length(text)))

    lines = F.struct(F.split(left, "\n").alias("ours"), F.split(text, "\n").alias("theirs"))
    return F.coalesce(let(lines, by_lines), let(F.right(left, F.lit(OVERLAP_MOST)), by_characters))


def joined(texts: Column) -> Column:
    """Neighbouring texts as one, a blank line between them, each without what the texts before it end with; null ones add nothing."""
    first = F.coalesce(F.get(texts, F.lit(0)), F.lit(""))

    def more(s: Column, t: Column) -> Column:
        put = lambda r: F.when(r == "", s).otherwise(F.struct(F.concat(s["shown"], F.lit("\n\n"), r).alias("shown"), F.concat(s["whole"], r).alias("whole")))
        return F.when(F.coalesce(t, F.lit("")) == "", s).otherwise(let(added(s["whole"], t), put))

    rest = F.slice(texts, F.lit(2), F.greatest(F.size(texts), F.lit(1)))
    return F.when(texts.isNull() | (F.size(texts) == 0), "").otherwise(F.aggregate(rest, F.struct(first.alias("shown"), first.alias("whole")), more, lambda s: s["shown"]))
