"""Extraction against pages whose content is known."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pytest

from corvane.llm import html_extract as h
from corvane.llm.gbdt import Forest, fit


def page(i, rng):
    body = "".join(f"<p>Sentence {i} number {j}, with several words in it, that is content. More of it follows here.</p>" for j in range(rng.integers(2, 8)))
    nav = "".join(f'<li><a href="/{j}">Link {j}</a></li>' for j in range(rng.integers(3, 9)))
    return f'<html><head><title>t</title><script>var x = "<p>";</script></head><body><div class="nav menu"><ul>{nav}</ul></div><article class="post"><h1>Head {i}</h1>{body}</article><div class="footer"><a href="/c">Contact us</a> Imprint</div></body></html>'


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, page(i, rng), "z", "z") for i in range(80)], "page_id long, html string, text string, nodes string")


@pytest.fixture(scope="module")
def forest(pages):
    return h.train(pages.where("page_id < 50"))


def test_held_out_pages(pages, forest):
    for r in h.extract(pages.where("page_id >= 50"), forest).collect():
        assert f"Head {r.page_id}" in r.text and "Sentence" in r.text
        assert "Link" not in r.text and "Contact" not in r.text and "var x" not in r.text
        assert 0 < r.kept < r.nodes


def test_held_out_over_the_table(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    x, y, page = h.node_sample(pages)
    assert x.shape[1] == h.FEATURES
    train = page % 3 > 0
    assert ((fit(x[train], y[train], trees=40).probability(x[~train]) > 0.5) == y[~train]).mean() > 0.97


def test_no_kept_node_under_a_dropped_one_and_greatest_sum():
    rng = np.random.default_rng(2)
    for _ in range(40):
        nodes = h.Nodes()
        h.parse("<div>a<p>b<b>c</b></p><ul><li>d</li><li>e</li></ul></div>f", nodes)
        n, parent = len(nodes.kind), np.array(nodes.parent)
        margin = rng.normal(size=n)
        keep = h.decode(nodes, margin)
        if keep.any():
            assert all(parent[i] < 0 or keep[parent[i]] for i in np.flatnonzero(keep))
        best = 0.0
        for m in range(1 << n):
            s = np.array([m >> i & 1 for i in range(n)], bool)
            if all(parent[i] < 0 or s[parent[i]] for i in np.flatnonzero(s)):
                best = max(best, margin[s].sum())
        assert margin[keep].sum() == pytest.approx(best)


def test_parse_ranges():
    nodes = h.Nodes()
    h.parse("<ul><li>one<li>two</ul><br>three &amp; <b>four</b>", nodes)
    assert [t for t in nodes.text if t] == ["one", "two", "three & ", "four"]
    assert nodes.end[0] == len(nodes.kind)


def test_awkward(spark, forest):
    rows = [(1, None), (2, ""), (3, "   "), (4, "<div"), (5, "plain words"), (None, "<p>x</p>"), (5, "plain words"), (6, "<div>" * 3000 + "deep" + "</div>" * 10), (7, "<p>word " * 30_000), (8, "<!-- open"), (9, "</p></div>")]
    out = h.extract(spark.createDataFrame(rows, "page_id long, html string"), forest).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r.text for r in out}
    assert by[1] is None and by[2] == by[3] == by[8] == by[9] == ""
    none = spark.createDataFrame([], "page_id long, html string")
    assert h.extract(none, h.train(none)).count() == 0


def test_without_marked_pages_all_text_stays(spark):
    rows = spark.createDataFrame([(1, "<div>a<p>b</p></div>")], "page_id long, html string")
    assert h.extract(rows, h.train(rows)).first().text == "a\nb"


def test_forest_without_trees_scores_the_prior():
    f = fit(np.zeros((0, 3)), np.zeros(0))
    assert isinstance(f, Forest) and f.probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]


class Walk(HTMLParser):
    """Pages as nested lists [tag, attributes, children], for pages whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.stack = [["", "", []]]

    def handle_starttag(self, tag, attrs):
        node = [tag, " ".join(v for k, v in attrs if k in ("class", "id", "role")), []]
        self.stack[-1][2].append(node)
        if tag not in h.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip() and self.stack[-1][0] not in ("script", "style"):
            self.stack[-1][2].append(re.sub(r"\s+", " ", data))


def flat(node, depth=0, parent=-1, around=frozenset(), link=False):
    """Nodes in document order, with what the features say, each by itself."""
    if isinstance(node, str):
        return [{"chars": len(node), "text": node, "depth": depth, "parent": parent, "tokens": around, "linked": len(node) * link, "tags": 0, "size": 1}]
    around = around | {h.bucket(t) for t in re.findall("[a-z]+", node[1].lower())}
    me = {"text": None, "depth": depth, "parent": parent, "tokens": around}
    out = [me]
    for child in node[2]:
        out += [{**x, "parent": x["parent"] + len(out) if x["parent"] >= 0 else 0} for x in flat(child, depth + 1, -1, around, link or node[0] == "a")]
    kids = [x for x in out[1:] if x["parent"] == 0]
    me |= {"chars": sum(x["chars"] for x in kids), "linked": sum(x["linked"] for x in kids), "tags": 1 + sum(x["tags"] for x in kids), "size": len(out), "children": len(kids)}
    return out


def plain_decode(nodes, margin):
    """The kept nodes, by recursion over the tree."""
    kids = {i: [j for j, x in enumerate(nodes) if x["parent"] == i] for i in range(len(nodes))}
    value = {}
    for i in reversed(range(len(nodes))):
        value[i] = margin[i] + sum(max(0.0, value[j]) for j in kids[i])
    keep = set()
    for i, x in enumerate(nodes):
        if value[i] >= 0 and (x["parent"] < 0 or x["parent"] in keep):
            keep.add(i)
    return keep


def test_query_as_by_recursion(pages, forest):
    """Tree, features and decoding of whole pages by another parser and plain recursion."""
    for r in h.extract(pages, forest).join(pages.select("page_id", "html"), "page_id").collect():
        nodes = h.Nodes()
        h.parse(r.html, nodes)
        walk = Walk()
        walk.feed(r.html)
        plain = flat(walk.stack[0])
        for i, x in enumerate(plain):
            x["parent"] = -1 if i == 0 else x["parent"]
        got = h.node_features(nodes)
        texts = [t for t in nodes.text if t]
        assert texts == [x["text"] for x in plain if x["text"]]
        leaves = [i for i, t in enumerate(nodes.text) if t]
        for i, x in zip(leaves, (x for x in plain if x["text"])):
            assert got[i, 3] == x["depth"] and got[i, 4] == np.log1p(x["chars"]) and got[i, 10] == (x["linked"] > 0)
            assert {b for b in range(h.BUCKETS) if got[i, 24 + b]} == set(x["tokens"])
        tree = [{"parent": p} for p in nodes.parent]
        keep = plain_decode(tree, forest.margin(got))
        assert (r.kept, r.nodes) == (len(keep), len(tree))
        assert "".join(r.text.split()) == "".join("".join(nodes.text[i].split()) for i in sorted(keep) if nodes.text[i])
        for i in range(len(tree)):
            below = [j for j in range(len(tree)) if _under(tree, j, i)]
            assert got[i, 4] == np.log1p(sum(len(nodes.text[j] or "") for j in below)) and got[i, 12] == sum(tree[j]["parent"] == i for j in below)


def _under(tree, j, i):
    while j >= 0 and j != i:
        j = tree[j]["parent"]
    return j == i
