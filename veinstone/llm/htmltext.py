"""Main text of pages by a tree-structured graphical model.

Each DOM element is content or not. An element's tag, names and links give its own potential, and parent-child
potentials connect the tree; one sum-product pass upward and one downward yield every element's marginal. The
potentials are counts over labelled pages, which are made here from templates with a fixed seed.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

PAGES, SEED, TEMPER = 1200, 11, 0.8
# Fixed values of HTML: elements without content, without rendered text, that break lines, and what closes a paragraph.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = set("head script style noscript template title iframe object svg select option textarea button form".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "html", "nav", "aside", "footer", "header", "main"}
BOXES = {"div", "section", "table"}
MEMBERS = {"a", "li", "tr", "td", "th", "dt", "dd"}  # come in numbers: what holds them speaks for them, not each of them anew
HOLDERS = {"table", "ul", "ol", "dl", "body"}
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")


class _Node:
    __slots__ = ("tag", "names", "parent", "text", "links", "silent", "linked", "owner")

    def __init__(self, tag: str, names: list[str], parent: int, silent: bool, linked: bool, owner: int) -> None:
        self.tag, self.names, self.parent, self.silent, self.linked, self.owner = tag, names, parent, silent, linked, owner
        self.text = self.links = 0


class Tree(HTMLParser):
    """Elements in page order (parents first) and blocks of text, each with the block element that owns it.

    Work is linear in the page: the open elements of each tag are kept apart, characters are summed at the end, and a
    tag that never ends is not tried anew at each of its characters.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.blocks = [_Node("#root", [], -1, False, False, 0)], []
        self.open, self.run, self.where = [0], [], defaultdict(list)
        self.feed(html)
        if _UNFINISHED.match(self.rawdata):  # a tag or comment that the page's end cuts off is no text; looked at once
            self.rawdata = ""
        self.close()
        self._flush()
        for node in reversed(self.nodes[1:]):
            above = self.nodes[node.parent]
            above.text += node.text
            above.links += node.links

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((self.nodes[self.open[-1]].owner, text))
            self.run = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
            self._close_open({"p"}, SCOPE)
        if tag in SIBLING:
            self._close_open(SIBLING[tag], HOLDERS)
        if tag == "br":
            self.run.append(" ")
        if tag in VOID:
            return
        names = [w for k, v in attrs if k in ("class", "id", "role", "aria-label") and v for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v).lower())]
        hidden = any(k == "hidden" or k == "style" and re.search(r"display\s*:\s*none", v or "") for k, v in attrs)
        parent, at = self.nodes[self.open[-1]], len(self.nodes)
        self.nodes.append(_Node(tag, names, self.open[-1], parent.silent or hidden or tag in SILENT, parent.linked or tag == "a", at if tag in BLOCK else parent.owner))
        self.where[tag].append(len(self.open))
        self.open.append(at)

    def _last(self, tags: set[str]) -> int:
        """The place among the open elements of the innermost one with such a tag; 0 without any."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def _pop(self, k: int) -> None:
        for i in self.open[k:]:
            self.where[self.nodes[i].tag].pop()
        del self.open[k:]

    def _close_open(self, tags: set[str], stop: set[str]) -> None:
        if (k := self._last(tags)) > self._last(stop - tags):
            self._flush()
            self._pop(k)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if self.where.get(tag):
            self._pop(self.where[tag][-1])

    def handle_data(self, data: str) -> None:
        node = self.nodes[self.open[-1]]
        if not node.silent:
            self.run.append(data)
            node.text += len(data)
            node.links += len(data) * node.linked


def features(node: _Node) -> list[str]:
    """What an element shows of itself: its tag, but for members of lists, its names and, of boxes, the share of text in links. Lengths say nothing."""
    density = node.links / node.text if node.text else 0
    out = [f"tag={node.tag}"] * (node.tag not in MEMBERS) + [f"links={'all' if density > 0.8 else 'some' if density > 0.2 else 'none'}"] * (node.tag in BOXES)
    return out + [f"name={w}" for w in sorted(set(node.names))]


class Model:
    """Smoothed log potentials: of features by state, of a child's state by its parent's."""

    def __init__(self, pages: list[tuple[Tree, list[int]]]) -> None:
        by: list[Counter] = [Counter(), Counter()]
        pair, size = [[1.0, 1.0], [1.0, 1.0]], [1.0, 1.0]
        for tree, states in pages:
            for node, s in zip(tree.nodes, states, strict=True):
                by[s].update(features(node))
                size[s] += 1
                if node.parent >= 0:
                    pair[states[node.parent]][s] += 1
        self.odds = {f: TEMPER * (math.log((by[1][f] + 0.5) / size[1]) - math.log((by[0][f] + 0.5) / size[0])) for f in by[0] | by[1]}
        self.pair = [[math.log(x / sum(row)) for x in row] for row in pair]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every element, by messages from the leaves to the root and back."""
        n, nodes, pair = len(tree.nodes), tree.nodes, self.pair
        own = [(0.0, -50.0) if x.silent or x.tag in ("#root", "html", "body") else (0.0, sum(self.odds.get(f, 0.0) for f in features(x))) for x in nodes]
        both = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        belief, sent = [list(x) for x in own], [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            if nodes[i].silent:
                continue  # a script tells nothing about what holds it
            b0, b1 = belief[i]
            m0, m1 = (both(pair[s][0] + b0, pair[s][1] + b1) for s in (0, 1))
            top = max(m0, m1)
            sent[i] = m0 - top, m1 - top
            p = belief[nodes[i].parent]
            p[0] += sent[i][0]
            p[1] += sent[i][1]
        for i in range(1, n):
            p0, p1 = belief[nodes[i].parent]
            p0, p1 = p0 - sent[i][0], p1 - sent[i][1]
            d0, d1 = (both(p0 + pair[0][s], p1 + pair[1][s]) for s in (0, 1))
            top = max(d0, d1)
            belief[i][0] += d0 - top
            belief[i][1] += d1 - top
        return [1 / (1 + math.exp(max(-700, min(700, b0 - b1)))) for b0, b1 in belief]

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        tree = Tree(html)
        p = self.marginals(tree)
        return "\n".join(t for owner, t in tree.blocks if p[owner] > 0.5 and not tree.nodes[owner].silent)


def labelled_page(r: random.Random) -> tuple[Tree, list[int]]:
    """A made page with each element's state; content stands inside one article among the usual surroundings."""
    text = lambda a, b: " ".join("".join(r.choice("the an er in on re st".split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))
    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{text(1, 3)}</a></li>' for _ in range(r.randint(3, 8))) + "</ul>"
    names = {
        "nav": ["nav", "menu", "navbar", "breadcrumb", "navigation"], "side": ["sidebar", "side", "widget", "related", "share", "social", "newsletter", "subscribe"],
        "note": ["cookie", "banner", "notice", "consent", "alert", "popup"], "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo"], "comment": ["comments", "comment", "discussion", "replies", "disqus", "responses", "response", "reader comments", "feedback", "reviews"],
    }
    name = lambda k: f'{r.choice(["class", "id"])}="{r.choice(names[k])}{r.choice(["", "", " box", "-wrap"])}"'
    ad = lambda: r.choice([f"<div {name('ad')}>{r.choice(['', '<p>'])}{text(4, 14)}</div>", f"<p {name('ad')}>{text(1, 14)}</p>"])
    said = lambda: r.choice([f"<section {name('comment')}><h3>{text(1, 2)}</h3>" + "".join(f"<div {name('comment')}><p>{text(5, 30)}</p></div>" for _ in range(r.randint(1, 3))) + "</section>", f"<{(k := r.choice(['ol', 'ul']))} {name('comment')}>" + "".join(f"<li>{text(1, 30)}</li>" for _ in range(r.randint(1, 4))) + f"</{k}>", f"<div {name('comment')}><p>{text(2, 30)}</p></div>"])
    linked = lambda: r.choice([f"<p><a href='/l'>{text(1, 30)}</a></p>", f"<p><a href='/l'>{text(1, 30)}</a> {text(1, 3)}</p>", "<ul>" + "".join(f"<li><a href='/l'>{text(1, 8)}</a></li>" for _ in range(r.randint(2, 9))) + "</ul>"])
    body = []
    for _ in range(r.randint(0, 9)):
        body.append(r.choice([lambda: f"<p>{text(5, 90)}</p>"] * 5 + [lambda: f"<p>{text(1, 3)}</p>"] * 2 + [lambda: f"<p>{text(200, 900)}</p>"] + [linked] * 6 + [lambda: f"<h2>{text(2, 6)}</h2>", lambda: f"<section><h2>{text(1, 6)}</h2><p>{text(3, 40)}</p></section>", lambda: f"<ul><li>{text(4, 15)}</li><li>{text(4, 15)}</li></ul>", lambda: f"<blockquote><p>{text(8, 30)}</p></blockquote>", lambda: f"<p><b>{text(5, 40)}<br><p>{text(5, 40)}</p>", lambda: f"<table><tr><td>{text(2, 6)}</td><td>{text(2, 6)}</td></tr></table>", lambda: f"<pre>{text(4, 20)}</pre>", lambda: f"<div><p>{text(9, 30)}</p></div>"])())
        if r.random() < 0.35:
            body.append("<!--0-->" + r.choice([ad, said, lambda: f"<aside {name('side')}><p>{text(5, 20)}</p>{links()}</aside>"])() + "<!--1-->")
    body = [linked()] * (len(body) < 2 and r.random() < 0.3) + body
    title = r.choice(["", "<h1>{}</h1>", "<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(text(1, 9))
    tag, attr = r.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ' id="content"'), ("div", ' id="content"'), ("div", ' class="article-body"'), ("div", ' class="post-content"'), ("section", ' class="entry content"')])
    parts = [f"<nav>{links()}</nav>", f"<div {name('nav')}>{links()}</div>", f"<header><div {name('nav')}>{text(1, 5)}</div></header>", f"<aside {name('side')}><h3>{text(1, 3)}</h3>{links()}<p>{text(4, 25)}</p></aside>", f"<div {name('side')}><p>{text(5, 20)}</p></div>", f"<div {name('note')}><p>{text(6, 25)}</p><a href='/c'>{text(1, 2)}</a></div>", ad(), f"<div {name('nav')}><a href='/'>{text(1, 2)}</a> {text(1, 2)}</div>"]
    after = [said(), said(), f"<aside {name('side')}>{links()}</aside>", ad(), f"<div {name('side')}>{links()}</div>", f"<form action='/s'><p>{text(2, 6)}</p></form>"]
    html = f"<html><head><title>{text(2, 9)}</title></head><body>" + "".join(r.sample(parts, r.randint(1, 5))) + f"<{tag}{attr} data-c>{title}{''.join(body)}</{tag}>" + "".join(r.sample(after, r.randint(0, 4))) + f"<footer>{r.choice(['<p>', ''])}{text(3, 12)}</footer></body></html>"
    return _labels(html)


class _Labelled(Tree):
    def __init__(self, html: str) -> None:
        self.on, self.states = False, [0]
        super().__init__(html)

    def handle_comment(self, data: str) -> None:
        self.on = data == "1"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        marked, n = any(k == "data-c" for k, _ in attrs), len(self.nodes)
        self.on = self.on or marked
        super().handle_starttag(tag, attrs)
        self.states += [int(self.on)] * (len(self.nodes) - n)
        if marked:
            self.main = self.open[-1]

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        if self.on and self.main not in self.open:
            self.on = False


def _labels(html: str) -> tuple[Tree, list[int]]:
    tree = _Labelled(html)
    return tree, tree.states


@lru_cache(1)
def model() -> Model:
    r = random.Random(SEED)
    return Model([labelled_page(r) for _ in range(PAGES)])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each input row.

    Null, empty and contentless pages have an empty text; repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [model().extract(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
