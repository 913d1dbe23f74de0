"""Marginals against enumeration, predictions against plain sums, and tables of odd, empty and long rows."""

import itertools
import math
import random

import numpy as np

from veinstone.llm import htmltext, langid, nearest


def test_marginals_by_enumeration():
    model = htmltext.model()
    for html in ("<div class=ad><p>a</p></div><article><p>b</p><p>c</p></article>", "<article><div><p>x</p><a href=y>z</a></div></article>", "<nav><ul><li><a>m</a></li></ul></nav>", "text alone", "<p>a<p>b<p>c"):
        tree = htmltext.Tree(html)
        n = len(tree.nodes)
        own = [(0.0, -50.0) if x.tag in ("#root", "html", "body") else (0.0, sum(model.odds.get(f, 0.0) for f in htmltext.features(x))) for x in tree.nodes]
        total, content = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(own[i][s] for i, s in enumerate(states)) + sum(model.pair[states[x.parent]][states[i]] for i, x in enumerate(tree.nodes) if x.parent >= 0))
            total += weight
            for i, s in enumerate(states):
                content[i] += weight * s
        assert np.allclose(model.marginals(tree), [c / total for c in content])


def test_predictions_by_plain_sums():
    counts = [("en", "the", 5), ("en", "cat", 2), ("fr", "le", 4), ("fr", "chat", 2), ("fr", "the", 1)]
    model = langid.Model(counts)
    words = sorted({w for _, w, _ in counts})
    log = lambda lang, w: math.log(sum(n for k, x, n in counts if (k, x) == (lang, w)) + 0.5) - math.log(sum(n for k, x, n in counts if k == lang) + 0.5 * len(words))
    grams = lambda size: sorted({w[i : i + size] for w in words for i in range(len(w) - size + 1)})

    def of_gram(lang, g):
        n = lambda x: sum(c * sum(w[i : i + len(x)] == x for i in range(len(w) - len(x) + 1)) for k, w, c in counts if k == lang)
        return math.log(n(g) + 0.5) - math.log(sum(n(x) + 0.5 for x in grams(len(g))))

    def score(lang, word):
        if word in words:
            return log(lang, word)
        for size in langid.GRAMS:
            known = [word[i : i + size] for i in range(len(word) - size + 1) if word[i : i + size] in grams(size)]
            if known:
                return sum(of_gram(lang, g) for g in known) / len(known)
        return 0.0

    for text in ("The cat", "le chat le", "chats", "hat the hat", "zzz", "LE THE 12", "x" * 30_000 + "chat"):
        found = [w for w in langid._WORD.findall(text.lower())]
        sums = {lang: sum(score(lang, w) for w in found) for lang in ("en", "fr")}
        best = max(sorted(sums), key=lambda k: sums[k])
        lang, share = model.predict(text)
        assert lang == best and math.isclose(share, 1 / sum(math.exp(s - sums[best]) for s in sums.values()), rel_tol=1e-9), text


def test_pages_of_a_table(spark):
    page = "<html><nav><a>m</a></nav><article><h1>T</h1>" + "<p>Wh the.</p>" * 50 + f"<p>{'long words ' * 900}</p></article><footer>f</footer></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, "<article><p>é&nbsp;b</p></article>", None), (2, "v", None, "x"), (3, "w", "", "x"), (4, "w", "<nav>only</nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in htmltext.extract(df).collect()), key=str)
    whole = "\n".join(["T", *["Wh the."] * 50, ("long words " * 900).strip()])
    assert got == sorted([(0, None, "é b", 3), (1, "u", whole, len(whole)), (1, "u", whole, len(whole)), (2, "v", "", 0), (3, "w", "", 0), (4, "w", "", 0)], key=str)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    for html in ("<span>" * 40_000 + "x" + "<hr>" * 40_000, "<p>a" * 60_000, "<ul><li>a" * 30_000):
        htmltext.model().extract(html)
    assert time.process_time() - began < 30


def test_nearest_stops_early(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    v = np.concatenate([c + 0.1 * rng.standard_normal((100, 24)) for c in centres])
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    seen = nearest.candidates(df).groupBy("query_id").agg({"verified": "max", "points": "max"}).toPandas()
    assert seen["max(verified)"].sum() < 0.5 * seen["max(points)"].sum()
    got, x = nearest.search(df).toPandas(), np.array([r[1] for r in rows])
    hits = sum(len((set(np.argsort(-(x @ x[q]), kind="stable")[:21].tolist()) - {q}) & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * len(got) and nearest.search(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nearest.search(same).where("query_id = 20").orderBy("rank").collect()] == [i for i in range(21) if i != 20][:20]


def test_nearest_of_spread_norms_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 48))
    x *= np.exp(1.2 * rng.standard_normal((3000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    tree = nearest.Tree(np.arange(len(x)), x)
    assert len(tree.bands) > 5 and sorted(np.concatenate([b.rows for b in tree.bands]).tolist()) == list(range(len(tree.points)))
    asked = np.arange(0, 3000, 20)
    hits = verified = opened = 0
    for q, (best, v, o) in zip(asked, tree.search(x[asked], asked.tolist(), 20, nearest.quantile(nearest.CONFIDENCE)), strict=True):
        wanted = [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:20]
        hits, verified, opened = hits + len({i for _, i in best} & set(wanted)), verified + v, opened + o
        assert best == sorted(best, key=lambda r: (-r[0], r[1])) and all(math.isclose(s, float(x[i] @ x[q]), rel_tol=1e-9, abs_tol=1e-12) for s, i in best)
    assert hits >= 0.95 * 20 * len(asked) and verified < 0.3 * len(asked) * len(x) and opened < 0.7 * len(asked) * len(x)


def test_nearest_verifies_in_order_of_projected_distance():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, seen = nearest.Tree(np.arange(600), x), []

    class Kept(nearest.Best):
        def add(self, rows, scores):
            seen.extend(rows.tolist())
            super().add(rows, scores)

    best = Kept(5, tree.matrix)
    verified, opened = tree.bands[0].nearest(tree.points[0], 1.0, best, np.inf)  # without a test every point comes
    assert verified == opened == len(seen) == len(set(seen)) == 600
    away = ((np.column_stack((tree.points, np.sqrt(np.maximum(0, tree.bands[0].top ** 2 - (tree.points**2).sum(1))))) - np.append(tree.points[0] * tree.bands[0].top, 0)) @ tree.matrix) ** 2
    seeds = nearest.FIRST * nearest.LEAF  # at most, and in order among themselves
    rest = away.sum(1)[seen][seeds:]
    assert (np.diff(rest) >= -1e-6).all()


def test_nearest_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "q", 9), (0, [1.0, 2.0], "q", 9), (20, [2.0, 1.0], "r", 8), (1, [1.0, 2.0], None, None), (2, None, "x", 1), (3, [0.0, 0.0], "x", 1), (4, [nan, 1.0], "x", 1), (5, [inf, 1.0], "x", 1), (6, [None, 1.0], "x", 1), (None, [9.0, 9.0], "x", 1), (7, [1e-300, 0.0], "x", 1), (8, [1.0, 1.0, 1.0], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 20), (0, 3, 7), (20, 1, 0), (20, 2, 1), (20, 3, 7)]


def test_language_model_is_small():
    """A model of many words is built without an array for each, and sent without an object for each."""
    import pickle
    import tracemalloc

    r = random.Random(4)
    counts = [(r.choice(["de", "en", "fr", "zh"]), "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))), r.randint(1, 5)) for _ in range(40_000)]
    tracemalloc.start()
    model = langid.Model(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / (len(model.words) + sum(map(len, model.grams))) < 300
    sent = pickle.loads(pickle.dumps(model))
    assert (sent.words, sent.grams, sent.langs) == (model.words, model.grams, model.langs)
    assert [sent.predict(t) for t in ("abc pon", "q", "", None)] == [model.predict(t) for t in ("abc pon", "q", "", None)]
    assert pickle.loads(pickle.dumps(langid.Model([]))).predict("abc") == ("und", 0.0)
