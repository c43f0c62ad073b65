"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page is parsed into nodes in document order (elements, and text runs as
leaves), so that a subtree is a range and its sums are differences of running
sums. Each node gets ``FEATURES``. Trees are fitted on the driver to the nodes
of at most ``most`` pages that mark their content with ``article`` or ``main``
(these two tags themselves are not features): a node is positive if text marked
so lies below it. Decoding finds the set of nodes with the greatest sum of
log-odds among those that hold, with a node, all its ancestors; so no kept node
lies under a dropped one. The text is that of the kept leaves, a line for each
block.

Defined results: null pages give null text; empty ones, and ones without text,
an empty text. Broken markup is read as far as it goes. Without any page that
marks its content, all text is kept. Null ids and repeated rows give a row each.
Empty tables give empty results. Further columns don't matter.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.gbdt import Forest, fit
from corvane.llm.shared import id_type, map_text

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*+>.*?(?:</(?P=raw)\b[^>]*+>|\Z)
    |</(?P<end>[a-zA-Z][\w:-]*+)[^>]*+>
    |<(?P<tag>[a-zA-Z][\w:-]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<[!?/a-zA-Z][^>]*+>
    |(?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKENS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_KINDS = {t: i for i, ts in enumerate(("p", "h1 h2 h3 h4 h5 h6", "li dd dt", "a", "div section", "ul ol dl", "table tr td th tbody thead", "nav footer aside header menu", "form button label fieldset", "head title meta", "blockquote pre code", "b i em strong span u small"), 1) for t in ts.split()}
_TEXT, _MARKS = 14, frozenset(("article", "main"))
_CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Attribute tokens (words of class, id and role) are hashed into so many buckets.
BUCKETS = 32
FEATURES = 24 + BUCKETS


@dataclass
class Nodes:
    """Nodes of pages in document order; ``end``: one past the last node below."""

    kind: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    token_node: list[int] = field(default_factory=list)
    token: list[int] = field(default_factory=list)
    mark: list[bool] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)


@lru_cache(1 << 14)
def bucket(token: str) -> int:
    return crc32(token.encode()) % BUCKETS


def parse(page: str, to: Nodes) -> None:
    """Adds a page's nodes, the first of them a root without a tag."""
    root = len(to.kind)
    stack, names = [root], [""]
    opened: dict[str, int] = {}

    def add(kind: int, mark: bool, block: int, text: str | None) -> int:
        i = len(to.kind)
        to.kind.append(kind)
        to.parent.append(stack[-1] if i > root else -1)
        to.depth.append(len(stack) if i > root else 0)
        to.end.append(i + 1)
        to.mark.append(mark)
        to.block.append(block)
        to.text.append(text)
        return i

    def pop() -> None:
        name = names.pop()
        opened[name] -= 1
        i = stack.pop()
        to.end[i] = len(to.kind)
        if name in BLOCKS:
            breaks[0] += 1

    breaks = [0]
    add(0, False, root, None)
    for m in _TOKEN.finditer(page):
        which = m.lastgroup
        if which == "text":
            t = m["text"]
            if not t.isspace():
                if "&" in t:
                    t = html.unescape(t)
                add(_TEXT, False, breaks[0], _SPACE.sub(" ", t))
        elif which == "attributes":
            name, attributes = m["tag"].lower(), m["attributes"]
            if name == "br":
                breaks[0] += 1
            for other in _CLOSES.get(name, ("p",) if name in BLOCKS else ()):
                if names[-1] == other:
                    pop()
            i = add(_KINDS.get(name, 13), name in _MARKS, 0, None)
            if attributes:
                for a in _NAMES.finditer(attributes):
                    for token in _TOKENS.findall((a[1] or a[2] or a[3] or "").lower()):
                        to.token_node.append(i)
                        to.token.append(bucket(token))
            if name in VOID or attributes.endswith("/"):
                continue
            stack.append(i)
            names.append(name)
            opened[name] = opened.get(name, 0) + 1
            if name in BLOCKS:
                breaks[0] += 1
        elif which == "end":
            name = m["end"].lower()
            if opened.get(name):
                while names[-1] != name:
                    pop()
                pop()
    while len(stack) > 1:
        pop()
    to.end[root] = len(to.kind)


def _arrays(nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(nodes.parent, np.int64), np.array(nodes.end, np.int64), np.array(nodes.depth, np.int64)


def node_features(nodes: Nodes) -> np.ndarray:
    """A row of features for each node."""
    n = len(nodes.kind)
    parent, end, depth = _arrays(nodes)
    kind, here = np.array(nodes.kind), np.arange(n)
    root = np.flatnonzero(parent < 0)
    page = np.searchsorted(root, here, "right") - 1
    up = np.where(parent < 0, here, parent)
    chars = np.array([len(t) if t else 0 for t in nodes.text], float)
    spaces = np.array([t.count(" ") if t else 0 for t in nodes.text], float)
    stops = np.array([t.count(".") + t.count(",") if t else 0 for t in nodes.text], float)

    def below(x: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(x)]
        return sums[end] - sums[here]

    def covered(which: np.ndarray) -> np.ndarray:
        """How many nodes of ``which`` each node lies in."""
        change = np.bincount(here[which], minlength=n + 1)[: n + 1].astype(float)
        change -= np.bincount(end[which], minlength=n + 1)[: n + 1]
        return np.cumsum(change)[:n]

    length, words, marks = below(chars), below(spaces) + 1, below(stops)
    tags = below((kind != _TEXT).astype(float))
    linked = below(np.where(covered(kind == 4) > 0, chars, 0.0))
    inner = parent >= 0
    children = np.bincount(parent[inner], minlength=n).astype(float)
    order = np.lexsort((here, parent))
    first = np.r_[True, parent[order][1:] != parent[order][:-1]]
    at = np.empty(n)
    at[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    before, after = np.zeros(n), np.zeros(n)
    same = ~first[1:]
    before[order[1:][same]] = length[order[:-1][same]]
    after[order[:-1][same]] = length[order[1:][same]]
    total = np.maximum(length[root][page], 1)
    log = np.log1p
    columns = [
        kind, kind[up], kind[up[up]], depth, log(length), log(words), length / words, marks / words, log(tags), length / (tags + 1), linked / np.maximum(length, 1), length / total,
        children, at, children[up], at / np.maximum(children[up], 1), log(before), log(after), log(length[up]), length / np.maximum(length[up], 1), linked[up] / np.maximum(length[up], 1), length[up] / (tags[up] + 1),
        covered(np.isin(kind, (8, 9))), (here - root[page]) / np.maximum(end[root][page] - root[page], 1),
    ]
    # Whether a node or one around it has a token of each bucket.
    change = np.zeros((n + 1, BUCKETS), np.int32)
    owner, token = np.array(nodes.token_node, np.int64), np.array(nodes.token, np.int64)
    np.add.at(change, (owner, token), 1)
    np.add.at(change, (end[owner], token), -1)
    return np.concatenate([np.stack([np.asarray(c, float) for c in columns], 1), np.cumsum(change, 0, dtype=np.int32)[:n] > 0], 1)


def marked(nodes: Nodes) -> np.ndarray:
    """Whether text below each node is marked as content."""
    _, end, _ = _arrays(nodes)
    here, n = np.arange(len(end)), len(end)
    which = np.array(nodes.mark, bool)
    inside = np.cumsum(np.bincount(here[which], minlength=n + 1) - np.bincount(end[which], minlength=n + 1))[:n] > 0
    sums = np.r_[0, np.cumsum(inside & (np.array(nodes.kind) == _TEXT))]
    return sums[end] - sums[here] > 0


def decode(nodes: Nodes, margin: np.ndarray) -> np.ndarray:
    """The nodes to keep: of greatest sum of ``margin`` among sets that hold all ancestors of their nodes."""
    parent, _, depth = _arrays(nodes)
    value = margin.astype(float).copy()
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    for level in reversed(levels[1:]):
        np.add.at(value, parent[level], np.maximum(value[level], 0))
    keep = value >= 0
    for level in levels[1:]:
        keep[level] &= keep[parent[level]]
    return keep


def page_texts(pages: list[str | None], forest: Forest) -> list[tuple[str | None, int, int]]:
    """(text, kept nodes, nodes) of each page."""
    nodes, firsts = Nodes(), []
    for page in pages:
        firsts.append(len(nodes.kind))
        parse(page or "", nodes)
    firsts.append(len(nodes.kind))
    keep = decode(nodes, forest.margin(node_features(nodes)))
    out = []
    for i, page in enumerate(pages):
        lo, hi = firsts[i], firsts[i + 1]
        if page is None:
            out.append((None, 0, 0))
            continue
        lines: list[str] = []
        last = None
        for j in lo + np.flatnonzero(keep[lo:hi]):
            if (t := nodes.text[j]) is not None:
                if nodes.block[j] == last:
                    lines[-1] += t
                else:
                    lines.append(t)
                last = nodes.block[j]
        out.append(("\n".join(x for x in (line.strip() for line in lines) if x), int(keep[lo:hi].sum()), hi - lo))
    return out


def node_sample(pages: DataFrame, page_id: str = "page_id", text: str = "html", most: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, page) of the nodes of ``most`` pages that mark their content, least by hash of the id."""
    rows = pages.where(F.col(text).rlike("(?i)<(article|main)[\\s>]")).select(F.col(page_id).alias("page_id"), F.col(text).alias("html"))
    ids = rows.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(most)
    schema = T.StructType([T.StructField("page_id", id_type(rows, "page_id")), T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = [], []
        for page in batch.column(1).to_pylist():
            nodes = Nodes()
            parse(page, nodes)
            x.append(node_features(nodes).tobytes())
            y.append(marked(nodes).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(y, pa.binary())], schema.names)

    got = map_text(rows.join(F.broadcast(ids), "page_id"), "html", schema, run).toPandas().sort_values(["page_id", "x"], kind="stable")
    x = np.frombuffer(b"".join(got.x)).reshape(-1, FEATURES)
    sizes = [len(b) for b in got.y]
    return x, np.frombuffer(b"".join(got.y), bool), np.repeat(np.arange(len(sizes)), sizes)


def train(pages: DataFrame, page_id: str = "page_id", text: str = "html", most: int = 400) -> Forest:
    """A forest over nodes, from at most ``most`` pages."""
    x, y, _ = node_sample(pages, page_id, text, most)
    return fit(x, y, trees=40)


def extract(pages: DataFrame, forest: Forest, page_id: str = "page_id", text: str = "html") -> DataFrame:
    """(page_id, text, kept, nodes) for each row."""
    sent = pages.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([T.StructField("page_id", id_type(pages, page_id)), T.StructField("text", T.StringType()), T.StructField("kept", T.LongType()), T.StructField("nodes", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = page_texts(batch.column(1).to_pylist(), sent.value)
        texts, kept, nodes = zip(*found)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kept, pa.int64()), pa.array(nodes, pa.int64())], schema.names)

    return map_text(pages.select(F.col(page_id).alias("page_id"), F.col(text).alias("html")), "html", schema, run)
