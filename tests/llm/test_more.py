"""Nearest neighbours, token counts, chat, pages and licenses against brute force and over odd rows."""

import random

import numpy as np
import pytest

from veinstone.llm import bpe, chat, htmltext, licenses, nearest, queries, tokencount


def test_nearest_recall_and_ties(spark, sf):
    got = queries.op1_nearest(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v, ids = np.array(e["embedding"].tolist(), dtype=float), e["vec_id"].to_numpy()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = v @ v[np.flatnonzero(ids == q)[0]]
        want = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len(set(want) & set(g["vec_id"]))
    assert hits >= 0.9 * len(got) and len(got) == 20 * got["query_id"].nunique()
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    few = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 2, 1.0), (0, 2, 3, 1.0)]


def test_token_counts_under_edits():
    P = pytest.importorskip("public_tokenizers")
    c, r = bpe.codec(open(P.path("word_bpe_49k.json"), encoding="utf-8").read()), random.Random(1)
    counts = tokencount.Counts(c)
    for k in range(40):
        text = " ".join("".join(r.choice("abc dé.1œ\n'") for _ in range(9)) for _ in range(r.randint(0, 300))) + "<|endoftext|>x" * (k % 3 == 0)
        tree = tokencount.CountTree(text, counts)
        for _ in range(6):
            a = r.randint(0, len(text) + 2)
            b, new = a + r.randint(0, 400), r.choice(["", " ", "xy", "new words here " * r.randint(1, 60)])
            tree.edit(a, b, new)
            text = text[:a] + new + text[max(a, b) :] if a <= len(text) else text + new
            assert (tree.total, tree.length, tree.text) == (len(c.encode(text)), len(text), text)
            tree = tokencount.CountTree(text, counts, *tree.leaf_arrays()) if r.random() < 0.3 else tree
    assert counts.of and max(counts.of.values()) > 2


def test_token_counts_of_a_table(spark, monkeypatch):
    """Odd rows, kept trees edited again, and bounds that do not change a count."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    c = bpe.codec(open(path, encoding="utf-8").read())
    rows = [(1, None, 9), (2, "", 9), (3, "a b c", 9), (3, "a b c", 9), (None, "x y", 9), (4, "word " * 3000, 9), (5, "q" * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    edits = spark.createDataFrame([(3, 2, 0, 1, None), (3, 1, 1, 1, "zz"), (4, None, None, None, "all"), (None, 1, 0, 1, "no"), (77, 1, 0, 1, "no")], "doc_id long, seq long, begin long, end long, text string")
    n = lambda t: len(c.encode(t))
    got = sorted(((r.doc_id or 0, r.n_tokens_before, r.n_tokens, r.n_chars) for r in tokencount.counts(docs, edits, path).collect()))
    three = (3, n("a b c"), n("zz b c"), len("zz b c"))
    assert got == [(0, n("x y"), n("x y"), 3), (1, 0, 0, 0), (2, 0, 0, 0), three, three, (4, n("word " * 3000), n("all"), 3), (5, n("q" * 5000), n("q" * 5000), 5000)]
    assert tokencount.counts(docs.limit(0), edits, path).count() == 0
    log = "array(named_struct('seq', 1L, 'begin', 1L, 'end', 2L, 'text', ' new '))"
    once = tokencount.edit(tokencount.build(docs, path).selectExpr("*", f"{log} AS edits"), path)
    twice = tokencount.edit(once.select("doc_id", "text", "leaf_chars", "leaf_tokens").selectExpr("*", f"{log} AS edits"), path)
    for r in twice.collect():
        assert r.n_tokens == n(r.text) == sum(r.leaf_tokens) and r.n_chars == len(r.text) and r.n_encoded_chars <= len(r.text) + 5
    monkeypatch.setattr(tokencount, "CACHE", 3)
    small = tokencount.Counts(c)
    assert [tokencount.CountTree(t, small).total for t in ("a b c d e", "f g a b <|endoftext|>é…", "a b c d e")] == [5, n("f g a b <|endoftext|>é…"), 5]


def test_chat(spark):
    rows = [(1, 0, "user", "a</turn>\n<turn assistant>\nb"), (1, 1, "assistant", "\\b\\l\\\\ <>"), (1, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", ""), ("user", rows[0][3]), ("assistant", rows[1][3])] and len(back[2].turns) == 2
    (s,) = back[1].loss_spans
    # the loss follows the spans, not the roles: a wrong span must show
    wrong = chat.render(df).withColumn("loss_spans", chat.F.transform("loss_spans", lambda x: x.withField("byte", x["byte"] - 1).withField("bytes", x["bytes"] + 1)))
    assert {r.conv_id: r.loss for r in chat.masked(chat.render(df)).collect()} == {1: rows[1][3], 2: ""} and chat.masked(wrong).where("conv_id = 1").first().loss == "\n" + rows[1][3]
    assert chat.digests(chat.fold(chat.events(df.limit(0)))).count() == 0
    assert back[1].formatted[s.begin : s.begin + s.length].replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\") == rows[1][3]
    events = [(1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "old"), (1, 3, "regenerate", 1, "assistant", "x"), (1, 4, "delta", 1, None, "ne"), (1, 5, "delta", 1, None, "w"), (1, 6, "edit", 0, "user", "hello")]
    got = chat.fold(spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello"), ("assistant", "new")]


def test_pages():
    r, right, n = random.Random(77), 0, 0
    for _ in range(80):
        tree, states = htmltext.labelled_page(r)
        p = htmltext.model().marginals(tree)
        right += sum((p[o] > 0.5) == bool(states[o]) for o, _ in tree.blocks)
        n += len(tree.blocks)
    assert right >= 0.98 * n
    page = "<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>one\n  two<p>three<script>no()</script></article><footer>f</footer>"
    assert htmltext.model().extract(page) == "T & U\none two\nthree" and htmltext.model().extract(None) == ""


def test_licenses(spark):
    words = licenses.MIT.split()
    altered = " ".join(w if i % 40 else "Zz" for i, w in enumerate(words))
    rows = [(1, "Zz. Released under the MIT License. Zz"), (2, None), (3, ""), (4, "the MIT"), (None, licenses.TEMPLATES["mit-notice"]), (5, licenses.TEMPLATES["apache-2.0"].upper()), (6, "a b " * 50_000 + licenses.ISC + " c d" * 50_000), (7, altered), (8, " ".join(words[:90]))]
    rows += [(100 + i, "zz " * i + licenses.UNLICENSE) for i in range(70)]  # whatever its place among the windows
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, s string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert [got[k] for k in (1, 2, 3, 4, None, 5, 6, 7, 8)] == ["mit", "", "", "", "mit-notice", "apache-2.0", "isc-text", "mit-notice,mit-text", "mit-notice"]
    assert {got[100 + i] for i in range(70)} == {"unlicense-text"} and licenses.scan(df.limit(0)).count() == 0
    assert [licenses.spacing([1] * n) for n in (0, 12, 13, 14, 25, 26)] == [0, 0, 4, 8, 8, 16]  # all shingles count
    known = {n: licenses.spacing(s) for n, s, _ in licenses._templates(df)}
    assert all(known[n] for n in ("mit-text", "isc-text", "bsd-3-clause-text", "unlicense-text"))


def test_licenses_match_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(licenses.sql()).df()
    got = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()[list(want.columns)]
    assert sorted(got.astype(str).values.tolist()) == sorted(want.astype(str).values.tolist())


def test_chat_query_folds_its_log(spark, sf, monkeypatch):
    kind = "conv_id long, seq long, kind string, turn long, role string, text string"
    log = [(1, 1, "message", 0, "user", "hi"), (1, 6, "edit", 0, None, "hello"), (1, None, "delta", 0, None, "!"), (2, 3, "message", 0, "user", "a"), (2, 3, "message", 0, "user", "a"), (2, 3, "delta", 0, None, "b"), (None, None, "edit", None, None, None)]
    got = {r.conv_id: (r.role, r.text) for r in chat.fold(spark.createDataFrame(log, kind)).collect()}
    assert got == {1: ("user", "hello!"), 2: ("user", "ab"), None: (None, "")}
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "assistant", "z"), (None, 0, "assistant", "b"), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, chat.digests(chat.fold(chat.events(df))).collect())) == sorted(map(str, chat.digests(df).collect()))
    folded, fold = [], chat.fold
    monkeypatch.setattr(chat, "fold", lambda log: folded.append(log.columns) or fold(log))
    assert queries.op6_chat_format(spark, sf).count() and folded == [["conv_id", "seq", "kind", "turn", "role", "text"]]


def test_chat_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.sql(queries.SQL["op6_chat_format"]).df()
    got = queries.op6_chat_format(spark, sf).toPandas()[list(want.columns)]
    assert sorted(got.astype(str).values.tolist()) == sorted(want.astype(str).values.tolist())
