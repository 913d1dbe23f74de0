"""Operators 11 to 13, and what earlier ones were mended for, against brute force, over odd rows and over the tables of sf0.01."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from veinstone.llm import audit, crosstok, decontam, htmltext, lcparse, licenses, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "a", "a  b", " a", "b ", "a \nb\t c", "x▁y z", "<|endoftext|> <s> <0x41>", "é é 中文 👍", "\x00 \x1c \x85", "it's 'll  12 345", "don't　stop", "the the the cat", "q" * 20_000, "word " * 20_000]


@pytest.fixture(scope="module")
def aligner():
    return crosstok.Aligner(open(A).read(), open(B, "rb").read())


def brute_alignment(it, text):
    """n_a, n_b, groups and links from whole encodings and sets of ends."""
    if not text:
        return 0, 0, [], []
    ids = it.a.encode(f" {text}", add_special_tokens=False).ids, it.b.encode(text)
    given = [[side[k] for k in x] for side, x in zip((it.a_bytes, it.b_bytes), ids, strict=True)]
    if any(b"".join(x) != f" {text}".encode() for x in given):
        return 0, 0, [], []
    ends = [list(itertools.accumulate(map(len, x))) for x in given]
    place, begin, groups, links = [{e: k + 1 for k, e in enumerate(x)} for x in ends], (0, 0), [], []
    for cut in sorted(set(ends[0]) & set(ends[1])):
        now = place[0][cut], place[1][cut]
        a, b = (x[i:j] for x, i, j in zip(ids, begin, now, strict=True))
        groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        links.append((a[-1], b[-1]))
        begin = now
    return len(ids[0]), len(ids[1]), groups, links


def brute_scores(it, texts):
    found = [brute_alignment(it, t) for t in texts]
    count = Counter(x for *_, links in found for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [(a, b, len(g), len(x), sum(count[y] == most[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, x in found]


def test_units_equal_whole_texts(aligner):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "▁", "1", "23", "<s>", "'s", "\xa0", "中文", "👍", "\x00", "\x1c", "\x85", "."]
    texts = [t or "" for t in ODD[:-2]] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    for text, (n_a, n_b, n_groups, n_links, groups, codes, times) in zip(texts, aligner.align(texts), strict=True):
        a, b, g, links = brute_alignment(aligner, text)
        assert (n_a, n_b, n_groups, n_links, groups) == (a, b, len(g), len(links), ";".join(g)), text
        assert dict(zip(codes.tolist(), times.tolist(), strict=True)) == Counter(x * aligner.b.vocab_size() + y for x, y in links), text


def test_remembered_units_are_bounded(aligner, monkeypatch):
    monkeypatch.setattr(crosstok, "UNITS", 50)
    texts = [f"the cat {k}x sat on number{k}" for k in range(300)]
    for t in texts:
        assert [x[:5] for x in aligner.align([t])] == [(*(y := brute_alignment(aligner, t))[:2], len(y[2]), len(y[3]), ";".join(y[2]))]
        aligner.trim()
        assert len(aligner.at) <= 60


@pytest.mark.parametrize("heavy", [1 << 18, 5])
def test_scores(spark, aligner, monkeypatch, heavy):
    """With few heavy pairs the other ones take the shuffled join."""
    monkeypatch.setattr(crosstok, "HEAVY", heavy)
    rows = [(k if k != 3 else None, t, "x", k) for k, t in enumerate(ODD)] + [(5, ODD[5], "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, n long")
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((str(r.doc_id), *[r[c] for c in cols]) for r in crosstok.scores(df, A, B).collect())
    assert got == sorted((str(r[0]), *x) for r, x in zip(rows, brute_scores(aligner, [r[1] for r in rows]), strict=True))
    assert crosstok.scores(df.limit(0), A, B).count() == 0


def test_op11_whole_table(spark, aligner):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op11_cross_tokenizer(spark, SF).orderBy("doc_id").collect()
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [(r.doc_id, *[r[c] for c in cols]) for r in got] == [(r.doc_id, *x) for r, x in zip(docs, brute_scores(aligner, [r.text for r in docs]), strict=True)]


def brute_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    by_text, fails, out = {}, [], []
    for i, t, _ in rows:
        by_text.setdefault(t or "", []).append(i)
    for i, t, part in rows:
        t = t or ""
        w = [x for x in t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
        others = [x for x in by_text[t] if x is not None]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": any(i is None or x < i for x in others)}
        fails.append((part or "", i, {k for k, v in f.items() if v}))
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                here = [x for x in left if k in x[2]]
                left = [x for x in left if k not in x[2]]
                removed[k] += len(here)
                out.append([part, "".join(order), step, len(left), len(here), sum(k in x[2] for x in mine) - len(here), sum(x[2] == {k} for x in mine), sum(x[1] in good for x in here), sum(x[1] in toxic for x in here)])
        for x in out:
            if x[0] == part:
                x.append(removed[x[1][x[2] - 1]])
    return sorted(map(tuple, out))


def test_audit(spark):
    rng = random.Random(2)
    texts = [None, "", "a b", "A B C", "x # y", " ".join(f"w{k}" for k in range(250)), "long " * 300, "\x0b\x1c\x85 a", "Caps " + " ".join(f"u{k}" for k in range(400)), "same " * 20_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(300)] + [(7, "a b", "en")] * 3
    labels = [(k % 45, k % 2, k % 3 == 0 and 1 or 0) for k in range(60)] + [(None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, good int").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit.audit(docs, said).collect())) == brute_audit(rows, labels)
    assert audit.audit(docs.limit(0), said).count() == 0 and audit.audit(docs, said.limit(0)).count() == 4 * 0 + 600 * len({r[2] or "" for r in rows})


def test_a_full_chain_is_sent_on(monkeypatch):
    monkeypatch.setattr(audit, "HELD", 40)
    rows = [(k % 3 and 7, k, "en", 0, f"text {k % 3}".encode()) for k in (5, 4, 9, 3, 1, 2, 0, 8, 7, 6)]  # two texts share a key
    out = list(audit._routed(iter(list(audit._local(iter(rows))))))
    assert sorted((i, mask & audit.REPEATED > 0) for i, _, _, mask in out) == [(i, i > 2) for i in range(10)]


def brute_parse(text):
    """Names by level, one symbol at a time."""
    u = lambda x: np.uint64(x)
    mix = lambda x: int(lcparse._mix(np.array([x], dtype=np.uint64))[0])
    low = lambda x: (x & -x).bit_length() - 1
    mask, x, level, out = (1 << 64) - 1, [ord(c) + 1 for c in text], 0, []
    while x:
        level += 1
        runs = [(k, len(list(g))) for k, g in itertools.groupby(x)]
        x = [mix((k + n * int(lcparse._M1)) & mask) if n > 1 else k for k, n in runs]
        label = x
        for _ in range(4):
            label = [2 * (p := low(a ^ b)) + (b >> p & 1) for a, b in zip([label[0] ^ 1, *label], label)]
        starts = [k for k in range(len(x)) if k == 0 or 1 < k < len(x) - 1 and label[k - 1] < label[k] > label[k + 1]]
        blocks = [x[a:b] for a, b in zip(starts, [*starts[1:], len(x)], strict=True)]
        x = [mix((sum(mix((s + level) & mask) * int(lcparse._POWERS[k]) for k, s in enumerate(b)) + len(b)) & mask) for b in blocks]
        out.append(x)
        if len(x) == 1:
            break
    assert u(0) == 0
    return out


def test_parse_by_hand():
    rng = random.Random(3)
    texts = ["", "a", "ab", "aaa", "\x00\x00a", "".join(rng.choice("ab") for _ in range(300)), "né " * 50, "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(500))]
    sizes = np.array(list(map(len, texts)))
    got = {k: [] for k in range(len(texts))}
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32) + np.uint32(1)
    for _, names, owner in lcparse.parse(points, sizes):
        for k in set(owner.tolist()):
            got[k].append(names[owner == k].tolist())
    assert got == {k: brute_parse(t) for k, t in enumerate(texts)}
    whole = lcparse.fingerprints(texts)
    assert all((lcparse.fingerprints([t])[0] == f).all() for t, f in zip(texts, whole, strict=True))


def test_equal_substrings_share_phrases():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    a, b = say(900), say(900)
    like = lambda x, y: float(lcparse.likeness(lcparse.fingerprints([x]), lcparse.fingerprints([y]))[0])
    assert like(a, a) == 1.0 and like(a, b) < 0.1 and like(a, "shifted: " + a) > 0.9 and like(a, a[:3000] + "!" + a[3000:]) > 0.85
    assert 0.2 < like(a, a[: len(a) // 2] + b[: len(a) // 2]) < 0.5 and like("", "") == 1.0 and like("", a) == 0.0


def test_compare(spark):
    rng = random.Random(5)
    texts = [None, "", "one", "two words", "x" * 5000, "é" * 7, "long text " * 30_000, *[" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(40)) for _ in range(60)]]
    rows = [(3 * k, t, "x") for k, t in enumerate(texts)] + [(None, "null id", "y"), (9, "same id", "z"), (9, "same id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(7)
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).digest())
    chain, want = sorted(rows, key=key), []
    for a, b in zip(chain, [*chain[1:], chain[0]], strict=True):
        t, following = a[1] or "", b[1] or ""
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        f = [lcparse.fingerprints([x]) for x in (t, new, following)]
        want.append((str(a[0]), len(t), hashlib.sha256(new.encode()).hexdigest(), f[0].tobytes().hex(), f[1].tobytes().hex(), float(lcparse.likeness(f[0], f[1])[0]), float(lcparse.likeness(f[0], f[2])[0])))
    got = sorted((str(r[0]), *r[1:]) for r in lcparse.compare(df).collect())
    assert got == sorted(want)
    assert lcparse.compare(df.limit(0)).count() == 0
    single = lcparse.compare(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(single) == 1 and single[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and single[0].near_next == 1.0


def test_op13_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    got = {r.doc_id: r for r in queries.op13_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for a, b in zip(docs, [*docs[1:], docs[0]], strict=True):
        t, following = a.text or "", b.text or ""
        r = got[a.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + following[: len(t) // 2]).encode()).hexdigest())
        assert r.fingerprint == lcparse.fingerprints([t])[0].tobytes().hex()


PAGES = {
    "<article><h1>T</h1><p><a href=x>All of this paragraph is a link</a></p><p>text</p></article>": "T\nAll of this paragraph is a link\ntext",
    "<article><h1>T</h1><ul><li><a href=x>first link</a></li><li><a href=y>second link</a></li></ul><p>text</p></article>": "T\nfirst link\nsecond link\ntext",
    '<article><p>one</p><ol class="responses"><li>reader says</li></ol></article>': "one",
    '<article><p>one two three</p></article><ol class="responses"><li>reader says</li></ol>': "one two three",
    '<article><p>one</p><p class="ad">x</p><p>two</p></article>': "one\ntwo",
    "<article><p>price 5 <": "price 5 <",
    "<nav><ul><li><a>m</a></li></ul></nav><main><p><a>x y</a></p></main>": "x y",
    '<article><h1>Title</h1><p>body</p><div class="related"><ul><li><a>r</a></li></ul></div></article>': "Title\nbody",
    '<div id=content><p>x</p><section class="reader-comments"><p>u</p></section></div>': "x",
    '<div class="links"><ul><li><a href=x>m1</a></li></ul></div><main><h2>h</h2><p>z</p><ul class="related"><li><a>r</a></li></ul></main>': "h\nz",
    "<article><p>a</p><!-- never ends <p>b</p>": "a",
    "<article><p>a</p><a href='never ends": "a",
}


def test_pages_of_links_ads_and_comments():
    assert {k: htmltext.model().extract(k) for k in PAGES} == PAGES


def test_broken_tags_take_linear_time():
    began = time.process_time()
    for part in ("<a ", '<a b="', "<!--", "<", "</", "<!", "<?", "<p>&", "<![CDATA["):
        htmltext.model().extract(part * 20_000)
        htmltext.model().extract(part * 20_000 + ">")
    assert time.process_time() - began < 20


def brute_matches(docs, items):
    out = set()
    for (d, t), (i, u) in itertools.product(enumerate(docs), enumerate(items)):
        need = min(13, len(u))
        for a, b in itertools.product(range(len(t)), range(len(u) - need + 1)):
            if need and t[a : a + need] == u[b : b + need] and not (need == 13 and a and b and t[a - 1] == u[b - 1]):
                n = need
                while a + n < len(t) and b + n < len(u) and t[a + n] == u[b + n]:
                    n += 1
                out.add((d, a, i, b, n))
    return out


@pytest.mark.parametrize("by_word", [256, 2])
def test_longest_matches_of_repetitive_texts(monkeypatch, by_word):
    monkeypatch.setattr(decontam, "BY_WORD", by_word)
    monkeypatch.setattr(decontam, "PAIRS", 97)
    rng = random.Random(by_word)
    for _ in range(25):
        words = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        items = [[rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40]))] for _ in range(4)]
        docs = [[rng.choice(words + [b"z"] * (rng.random() < 0.1)) for _ in range(rng.choice([0, 2, 13, 60]))] for _ in range(4)]
        got = list(decontam.TestSet([(str(i), 0, b" ".join(u).decode()) for i, u in enumerate(items)]).search(docs))
        assert len(got) == len(set(got)) and set(got) == brute_matches(docs, items)


def test_equal_words_stay_small():
    tracemalloc.start()
    n = sum(1 for _ in decontam.TestSet([("x", 0, "w " * 20_000)]).search([[b"w"] * 20_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * (20_000 - 12) - 1 and peak < 100e6


def test_altered_licenses_are_found(spark):
    """Whole texts, and texts of which up to a fifth of the shingles are broken, in the midst of other words."""
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(400):
        name = rng.choice(["mit-text", "isc-text", "bsd-2-clause-text", "unlicense-text"])
        words = licenses.TEMPLATES[name].split()
        for _ in range(rng.randint(0, len(words) // 25)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join([f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 300))] + words + ["end"] * rng.randint(0, 30))))
        plain = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
        grams = lambda t: {tuple(w[i : i + 5]) for w in [plain(t)] for i in range(len(w) - 4)}
        own = grams(rows[-1][1])
        want[k] = ",".join(sorted(n for n, t in licenses.TEMPLATES.items() if len(own & grams(t)) >= 0.75 * len(grams(t))))
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(v != "" for v in want.values()) > 300
