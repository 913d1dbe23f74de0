"""Chunks, windows and seams by their properties, over made texts."""

import random

from pyspark.sql import functions as F

from veinstone.functions import assemble as A

WORDS = ["a", "b", "word ", "\n", "\n\n", " ", "CVE-2021-9 ", "é", "中文", "文字", "…", "\t", "line of some length here\n"]


def texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["", "x", "p" * 1200, "a\n\n" + "b" * 1001 + "\n\nc", " \n\n " * 50]


def shown(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*columns).collect()]


def test_chunks_hold_all_paragraphs_in_order(spark):
    rows = [(t,) for t in texts(1, 150, 150)] + [(None,)]
    got = [r[0] for r in shown(spark, rows, "t string", A.chunked(F.col("t"), 100))]
    assert got[-1] is None
    for (t,), chunks in zip(rows[:-1], got[:-1], strict=True):
        paragraphs = [p.strip() for p in t.split("\n\n") if p.strip()]
        assert "".join(c.replace("\n\n", "") for c in chunks) == "".join(p.replace("\n\n", "") for p in paragraphs) and all(0 < len(c) <= 100 for c in chunks)
        for a, b in zip(chunks, chunks[1:], strict=False):  # greedy: what opens the next chunk would not have fitted
            assert len(a) + 2 + len(b.split("\n\n")[0]) > 100


def test_windows_hold_the_hit(spark):
    rows = [(t, q) for t in texts(2, 120, 200) for q in ("word", "cve-2021-9", "文字", "zzz", "", None)] + [(None, "x")]
    cols = A.snippet(F.col("t"), F.col("q"), 60), A.bounded(F.col("t"), F.col("q"), 200), A.bounded(F.col("t"), F.col("q"), 30), A.bounded(F.col("t"), F.col("q"), 1)
    for (t, q), (cut, b200, b30, b1) in zip(rows, shown(spark, rows, "t string, q string", *cols), strict=True):
        if t is None:
            assert (cut, b200, b30, b1) == (None,) * 4
            continue
        assert len(b200) <= 200 and len(b30) <= 30 and len(b1) <= 1 and (len(t) > 200 or b200 == t)
        body = cut.removeprefix(A.MARK) if not t.startswith(cut) else cut
        assert cut == t if len(t) <= 60 else (body.removesuffix(A.MARK) in t and len(cut) <= 60 + 2 * A.LOOK + 2)
        if len(t) > 60 and q and q in t.lower() and q.strip("abcdefghijklmnopqrstuvwxyz0123456789-") == "":
            assert q in cut.lower()


def test_seams(spark):
    rows = [["one\ntwo\nthree is a line of some length", "three is a line of some length\nfour"], ["abc", "abd"], ["x 0123456789abc", "0123456789abc y"], ["a\nb", "a\nb"], [None, "t", None, "t"], [], ["short\nx", "x\ny"]]
    got = [r[0] for r in shown(spark, [(r,) for r in rows], "p array<string>", A.joined(F.col("p")))]
    assert got == [rows[0][0] + "\n\n\nfour", "abc\n\nabd", "x 0123456789abc\n\n y", "a\nb", "\n\nt\n\nt", "", "short\nx\n\nx\ny"]


def test_cut_texts_join_again(spark):
    """Pieces that overlap by 12 to 300 characters give the text back, but for the blank line at the seam."""
    rng, rows = random.Random(5), []
    for _ in range(150):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(800))
        cut, both = rng.randint(320, 700), rng.randint(12, 300)
        rows.append((t, cut, [t[:cut], t[cut - both :]]))
    got = [r[0] for r in shown(spark, [(r[2],) for r in rows], "p array<string>", A.joined(F.col("p")))]
    assert got == [t[:cut] + "\n\n" + t[cut:] for t, cut, _ in rows]
