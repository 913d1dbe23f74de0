"""An index built, searched, browsed and served; imports of a tree; streams; the text folds against plain loops."""

import json

import pytest
from pyspark.sql import functions as F

from veinstone import __main__ as cli
from veinstone import service as S
from veinstone import sources, streaming
from veinstone.functions import folds as P
from veinstone.operators import browse as B
from veinstone.operators import ingest as I
from veinstone.operators import recall as C


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = sources.chunks(spark, sf).join(sources.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    I.build_index(spark, docs.select(F.col("path").alias("source"), F.lit(0).alias("at"), "text", "embedding"), path, "m1")
    return path


@pytest.fixture(scope="module")
def vector(spark, sf):
    return sources.table(spark, sf, "embeddings").where("vec_id = 7").first()["embedding"]


def test_index_and_search(spark, index, vector):
    assert I.index_status(spark, index, "m1") == "ready" and I.index_status(spark, index, "m2") == "other model" and I.index_status(spark, index + "/no", "m1") == "missing"
    rows = spark.read.parquet(f"{index}/chunks")
    assert [r["row"] for r in rows.select("row").orderBy("row").collect()] == list(range(rows.count()))
    found = S.Retriever(spark, index, "corpus", lambda q: vector)
    answer = found.search(S.Request(query="doc-7 the", top_k=3, score_threshold=0.2))
    assert answer["results"][0]["source"].endswith("doc-7.md") and answer["total"] <= 3 and answer["degraded"] is None
    assert len({x["source"] for x in answer["results"]}) == answer["total"] and not answer["no_match"] and json.dumps(answer, default=str)
    only = found.search(S.Request(query="the", filters={"category": "src3", "exclude_source_prefix": ["src3/fr", "nowhere"]}, score_threshold=0.0))
    assert all(x["source"].startswith("src3/") and not x["source"].startswith("src3/fr") for x in only["results"]) and any("nowhere" in w for w in only["warnings"])
    words = S.Retriever(spark, index, "corpus", lambda q: 1 / 0).search(S.Request(query="doc-7"))
    assert words["degraded"] == "lexical-only" and any(x["source"].endswith("doc-7.md") for x in words["results"])
    assert "no_match=true" in S.tool_text(found.search(S.Request(query="qqqq", score_threshold=2.0)))


def test_browse(spark, index):
    found = S.Retriever(spark, index, "corpus")
    every, cursor = [], None
    while True:
        page = found.search(S.Request(filters={"category": "src1"}, limit=3, cursor=cursor))
        every += [x["source"] for x in page["results"]]
        if not (cursor := page["next_cursor"]):
            break
    assert every == sorted(r[0] for r in found.spans.where(F.col("source").startswith("src1/")).select("source").collect())
    assert {x["category"] for x in found.search(S.Request())["results"]} == set(found.categories())
    one = found.search(S.Request(filters={"chunk_id": "corpus:5"}))["results"]
    assert [x["row"] for x in one] == [5] and found.search(S.Request(filters={"chunk_id": "corpus:999999"}))["no_match"]
    whole = found.search(S.Request(filters={"source": every[0]}))["results"][0]
    assert whole["chunks"] == 1 and whole["next_cursor"] is None
    with pytest.raises(ValueError):
        found.search(S.Request(corpus="other"))


@pytest.mark.parametrize("bad", [{"top_k": 0}, {"filters": {"colour": "x"}}, {"filters": {"year": 12}}, {"filters": {"source": " "}}, {"extract": "prose"}, {"query": "x" * 8001}, {"query": "q", "filters": {"chunk_id": "corpus:1"}}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        S.Request(**bad)


def test_serving(spark, index, capsys):
    found = S.Retriever(spark, index, "corpus")
    ask = lambda method, path, body=b"", token="t", given="Bearer t": cli.answer(found, method, path, body, token, given)[0]
    assert [ask("GET", "/v1/health"), ask("GET", "/v1/health", given=""), ask("GET", "/no"), ask("POST", "/v1/search", b"{"), ask("POST", "/v1/search", b'{"top_k": 0}'), ask("POST", "/v1/search", b'{"filters": {"category": "src1"}}')] == [200, 401, 404, 400, 422, 200]
    assert cli.main(["search", index, "corpus", "doc-7"]) == 0 and cli.main(["search", index, "corpus", "qqqqqq"]) == 3 and cli.main(["search", index, "corpus", "x", "--filters", "year=1"]) == 2
    assert S.call_tool(found, {"colour": 1}).startswith("error") and S.tool_schema()["function"]["parameters"]["properties"]["top_k"]["maximum"] == 500
    assert S.evidence_for_prompt([{"source": "a", "text": "x" * 50}], 20).endswith("…") and S.trim_history([{"n": 1}, {"n": 2}], 0) == [{"n": 2}]


def test_import(spark, tmp_path):
    files = {"a/p.md": b"\xef\xbb\xbftoken = abcdefgh\n<!-- c -->", "b/P.md": b"x", "a/images/q.md": b"n", "a/s.yml": b"y: 1", "a/S.md": b"z", "flag.txt": b"f", "b/p.md": b"y\xff"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.source_path: r for r in I.imported(sources.file_tree(spark, str(tmp_path)), "c1", "2026-01-01", "repo", plain=True, structured=True).collect()}
    assert set(got) == {"a/p.md", "b/P.md", "b/p.md", "a/s.yml", "a/S.md"}
    assert got["b/p.md"].destination == "b/p__duplicate_1.md" and got["b/p.md"].collides_with == "b/P.md" and {got["a/s.yml"].destination, got["a/S.md"].destination} == {"a/S.md", "a/s__duplicate_1.md"}
    assert got["a/p.md"].text.endswith("---\n\ntoken = <REDACTED>\n") and got["b/p.md"].text.endswith("y�") and got["a/p.md"].bytes == len(files["a/p.md"])
    assert I.fingerprint(sources.file_tree(spark, str(tmp_path))).first()[0].startswith(f"local-{len(files)}-{sum(map(len, files.values()))}-")
    assert {r.source for r in sources.text_tree(spark, str(tmp_path)).collect()} == {n for n in files if n.endswith(".md")}
    (tmp_path / "c.jsonl").write_text('{"text": "t", "metadata": {"source": "", "file_name": "a\\\\b.md", "id": "1"}}\n\nnot json\n')
    assert [tuple(r) for r in sources.json_chunks(spark, str(tmp_path / "c.jsonl")).collect()] == [("1", "a/b.md", "t")]
    (tmp_path / "g.jsonl").write_text('{"query": " q ", "source_prefixes": ["a/"]}\n{"query": "n", "empty": true}\n')
    assert sorted((r.text, r.label) for r in sources.golden(spark, str(tmp_path / "g.jsonl")).collect()) == [("n", "negative"), ("q", "positive")]
    (tmp_path / "h.jsonl").write_text('{"query": "q"}\n')
    with pytest.raises(ValueError):
        sources.golden(spark, str(tmp_path / "h.jsonl"))


def test_annotation_reads_a_text_once_for_each_pattern(spark):
    """what was shown if not empty, and what was cut if too long, was worked out anew for each look at it."""
    texts = ["", None, "x86_64 AMD64 i386 x86 on LINUX and aarch64, armv7l; mipsel win32 OSX", "x86 64 xlinux linux_ glibc 2.31 libc-2.4 cve-2021-44228 (CVE-2020-1)", "flag{AbC_12345xyz} if{AbC_12345xyz9} a\\flag{AbC_12345xyz} flag{abcdefghij}",
             '![ a b ](x.png "t") ![c](x.png) ![d](<y z.png>) ![e](javascript:x) <img src="w.png">', "---\nnotice: kept\nnotice: last\nusage:\nother: x\n---\n\nrest ![ s ](i.png)"]
    df = spark.createDataFrame([(i, "00_a/b.md", t) for i, t in enumerate(texts)], "row int, source string, text string")
    noted = B.annotated(df)
    got = {r.row: r for r in noted.collect()}
    assert got[2].facts.arch == ["amd64", "i386", "arm64", "arm", "mips", "windows", "macos", "linux"] and got[3].facts.arch is None
    assert (got[3].facts.glibc, got[3].facts.cve, got[0].facts.cve) == (["2.4", "2.31"], ["CVE-2021-44228"], None)
    assert got[4].flags == ["flag{AbC_12345xyz}"] and [(x.src, x.alt) for x in got[5].images] == [("x.png", "a b"), ("w.png", "")]
    assert got[6].provenance == {"notice": "last"} and got[6].text == "rest s" and (got[1].text, got[1].images) == (None, [])
    plan = noted.select("facts", "provenance", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CVE-") == 1 and plan.count("libc)") == 1 and plan.count("4092") <= 3


def test_names_of_many_collisions_stay_short(spark):
    """the n-th file of a name was given all numbers up to n, the square of the files in characters."""
    made = spark.createDataFrame([(f"{i:03}", "a/R.md" if i % 2 else "a/r.md") for i in range(300)], "source_path string, destination string")
    got = {r.source_path: r for r in I.without_collisions(made).collect()}
    assert got["000"].destination == "a/r.md" and got["000"].collides_with is None and len({r.destination.lower() for r in got.values()}) == 300
    assert [got[p].destination for p in ("001", "002", "299")] == ["a/R__duplicate_1.md", "a/r__duplicate_2.md", "a/R__duplicate_299.md"] and got["299"].collides_with == "000"
    files = spark.createDataFrame([(f"x{i}/p.md", b"text") for i in range(3)], "path string, content binary")
    plan = I.totals(I.imported(files, "c", "d", "r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Window")[0] and "octet_length" not in plan.split("Window")[0]  # rows are sorted without their files


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("A line that says something.\n\ntoken = abcdefgh " + "word " * 200)
    (tmp_path / "in" / "b.md").write_text("A line that says something.")
    (tmp_path / "in" / "c.md").write_text("!!!")
    for _ in range(2):  # what has been read isn't read again
        chunks = streaming.clean_chunks(streaming.landing(spark, str(tmp_path / "in")), 400)
        streaming.append_chunks(chunks, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    texts = sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(texts) == len(set(texts)) and any("<REDACTED>" in t for t in texts) and "!!!" not in texts
    lines = [(1, 0, 'data: {"choices": [{"delta": {"content": "he"}}]}'), (1, 2, 'data: {"choices": [{"delta": {"content": "o"}, "finish_reason": "stop"}]}'), (1, 1, 'data: {"choices": [{"delta": {"content": "ll", "reasoning": "hm"}}]}'), (1, 3, "data: [DONE]"), (1, 4, ": ping"), (1, 5, "")]
    assert [tuple(r) for r in streaming.messages(spark.createDataFrame(lines, "conv_id int, seq int, line string")).collect()] == [(1, "hello", 2, "stop")]


def test_signature_sees_neither_case_nor_white_space():
    assert P.signature_of("a b") == [0] * 12 and P.signature_of("The same  text here") == P.signature_of("the same text\nhere")


def test_mirrors_and_neighbours(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and len(r.text) >= C.MIRROR_LEAST]
    signs = [(i, P.signature_of(t)) for i, t in docs]
    want = {(a, b) for a, x in signs for b, y in signs if a < b and sum(p == q for p, q in zip(x, y, strict=True)) >= C.MIRROR}
    got = {tuple(r) for r in C.mirror_pairs(spark.createDataFrame(docs, "id long, text string")).collect()}
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in got:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got <= want and all(find(a) == find(b) for a, b in want)
    rows = [(i, "s" if i != 3 else "t", f"text {i}") for i in range(7)]
    chunks = spark.createDataFrame(rows, "row long, source string, text string")
    hits = spark.createDataFrame([(0, 1, 1, "s"), (0, 2, 5, "s")], "query_id int, rank int, row long, source string")
    assert {r.row: r.rows for r in B.merged(hits, chunks).collect()} == {1: [0, 1, 2], 5: [4, 5, 6]}
