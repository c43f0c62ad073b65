"""HTML to Markdown, by a streaming parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset(("script", "style", "aside", "noscript", "template"))
_INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*"}


class _Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str | None], parent: _Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[_Node | str] = []

    def find(self, tag: str) -> list[_Node]:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if n.tag == tag:
                out.append(n)
            todo += [c for c in reversed(n.children) if isinstance(c, _Node)]
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li", "tr", "td", "th") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _inline(node: _Node | str) -> str:
    out: list[str] = []
    todo: list[object] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, tuple):
            start, end = n
            body = re.sub(r"\s+", " ", "".join(out[start:])).strip()
            del out[start:]
            out.append(end(body) if body else "")
        elif n.tag in _SKIP:
            continue
        elif n.tag == "br":
            out.append("\n")
        else:
            if n.tag in _INLINE:
                mark = _INLINE[n.tag]
                todo.append((len(out), lambda s, m=mark: f"{m}{s}{m} "))
            elif n.tag == "a" and n.attributes.get("href"):
                todo.append((len(out), lambda s, h=n.attributes["href"]: f"[{s}]({h}) "))
            todo += list(reversed(n.children))
    return re.sub(r" +", " ", "".join(out)).strip()


def _table(node: _Node) -> str:
    rows = [[_inline(c).replace("\n", " ") for c in r.children if isinstance(c, _Node) and c.tag in ("td", "th")] for r in node.find("tr")]
    lines = ["|" + "|".join(r) + "|" for r in rows if r]
    if len(lines) > 1:
        lines.insert(1, "|" + "---|" * len([r for r in rows if r][0]))
    return "\n".join(lines)


_BLOCKS = frozenset("article address blockquote body center dd div dl dt fieldset figure figcaption footer form header html li main nav ol p pre section table ul h1 h2 h3 h4 h5 h6 q code".split())


def _blocks(node: _Node, article: bool) -> list[str]:
    """Markdown blocks in order; done with a stack, as pages may nest without end."""
    out: list[str] = []
    run: list[_Node | str] = []

    def flush() -> None:
        holder = _Node("", {}, None)
        holder.children = list(run)
        run.clear()
        if s := _inline(holder):
            out.append(s)

    todo: list[object] = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag in _SKIP or (n.tag in ("header", "footer", "nav") and not article):
            continue
        elif re.fullmatch("h[1-6]", n.tag):
            flush()
            if s := _inline(n):
                out.append("#" * int(n.tag[1]) + " " + s)
        elif n.tag in ("blockquote", "q"):
            flush()
            if s := _inline(n):
                out.append("\n".join("> " + x for x in s.split("\n")))
        elif n.tag in ("ul", "ol"):
            flush()
            items = [s for c in n.children if isinstance(c, _Node) and c.tag == "li" and (s := _inline(c))]
            if items:
                out.append("\n".join(f"{i}. {s}" if n.tag == "ol" else f"- {s}" for i, s in enumerate(items, 1)))
        elif n.tag in ("pre", "code"):
            flush()
            text = "".join(x for x in _texts(n)).strip("\n")
            if text.strip():
                out.append(f"```\n{text}\n```")
        elif n.tag == "table":
            flush()
            if s := _table(n):
                out.append(s)
        elif n.tag in _BLOCKS or any(isinstance(c, _Node) and c.tag in _BLOCKS for c in n.children):
            flush()
            if "page" in (n.attributes.get("class") or "").split():
                out.append("\f")
            todo.append(None)
            todo += list(reversed(n.children))
        elif n.tag == "":
            todo.append(None)
            todo += list(reversed(n.children))
        else:
            run.append(n)
    flush()
    return out


def _texts(node: _Node) -> list[str]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo += list(reversed(n.children))
    return out


def to_markdown(html: str | None, paragraphs: bool = False, sections: bool = False) -> str | None:
    """Markdown of a page: its articles (with a paragraph), else ``main``, else the body; title and description first.

    ``paragraphs``: blocks two line ends apart, else one; ``sections``: a form
    feed before each header and after the title.
    """
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    nodes = [n for n in root.find("article") if n.find("p")]
    article = bool(nodes)
    nodes = nodes or root.find("main")[:1] or root.find("body")[:1] or [root]
    blocks = [b for n in nodes for b in _blocks(n, article)]
    head = []
    for t in root.find("title")[:1]:
        if s := _inline(t):
            head.append(f"**{s}**")
    for m in root.find("meta"):
        if (m.attributes.get("name") or "").lower() == "description" and (m.attributes.get("content") or "").strip():
            head.append(f"*{m.attributes['content'].strip()}*")
    gap = "\n\n" if paragraphs else "\n"
    body = gap.join(("\f" + b if sections and b.startswith("#") else b) for b in blocks)
    return (("\n\n".join(head) + ("\f" if sections else "\n\n") + body) if head else body).strip("\n ")


def markdown(html: Column, paragraphs: bool = False, sections: bool = False) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: to_markdown(x, paragraphs, sections))

    return run(html)
