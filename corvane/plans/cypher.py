"""Path queries: MATCH (A)-[R]->(B), (A)<-[*1..3]-(B); WHERE; RETURN; ORDER BY; LIMIT, as chains of joins.

The graph is undirected, so arrows either way mean the same. A named edge of one
hop has ``src``, ``dst`` and ``weight``; one of several hops is an array of such.
Defined results: no edge is used twice in a path; unknown properties are errors;
empty graphs give no rows; ties of ORDER BY go by the path.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import Graph

_NODE = r"\(\s*(\w*)\s*(?:\{([^}]*)\})?\s*\)"
_EDGE = r"<?-\[\s*(\w*)\s*(?:\*(\d+)(?:\.\.(\d+))?)?\s*(?:\{([^}]*)\})?\s*\]->?"
_PROPERTY = r"(\w+)\s*:\s*(\"[^\"]*\"|'[^']*'|[^,\s]+)"
#: similar(node, "text"[, number]); the text may hold anything but its own quotes.
_SIMILAR = re.compile(r"similar\(\s*(\w+)\s*,\s*(\"[^\"]*\"|'[^']*')\s*(?:,\s*(\d+))?\s*\)", re.I)


class PathError(ValueError):
    """The query isn't of a form that is understood."""


@dataclass
class Path:
    name: str | None
    nodes: list[tuple[str, dict[str, str]]]
    hops: list[tuple[int, int, str, dict[str, str]]]
    where: str | None
    returns: list[str]
    order: list[tuple[str, bool]]
    limit: int | None
    similar: list[tuple[str, str, int | None]]


def isquery(query: object) -> bool:
    return isinstance(query, str) and query.strip().startswith("MATCH ") and "RETURN " in query


def parse(query: str) -> Path:
    m = re.fullmatch(r"(?is)\s*match\s+(.+?)(?:\s+where\s+(.+?))?\s+return\s+(.+?)(?:\s+order\s+by\s+(.+?))?(?:\s+limit\s+(\d+))?\s*", query)
    if not m:
        raise PathError(query)
    pattern, where, returns, order, limit = m.groups()
    named = re.match(r"(\w+)\s*=\s*(.+)", pattern, re.S)
    name, pattern = (named[1], named[2]) if named else (None, pattern)
    pattern = pattern.strip()
    if pattern.startswith("(("):
        pattern = pattern[1:-1]
    nodes, hops, at = [], [], 0
    while True:
        n = re.compile(_NODE).match(pattern, at)
        if not n:
            raise PathError(pattern)
        nodes.append((n[1] or f"_{len(nodes)}", {k: v.strip("'\"") for k, v in re.findall(_PROPERTY, n[2] or "")}))
        at = n.end()
        if not pattern[at:].strip():
            break
        e = re.compile(r"\s*" + _EDGE + r"\s*").match(pattern, at)
        if not e:
            raise PathError(pattern)
        least = int(e[2]) if e[2] else 1
        hops.append((least, int(e[3]) if e[3] else least, e[1], {k: v.strip("'\"") for k, v in re.findall(_PROPERTY, e[4] or "")}))
        at = e.end()
    similar = []
    for s in _SIMILAR.finditer(where or ""):
        similar.append((s[1], s[2][1:-1], int(s[3]) if s[3] else None))
    orders = [(o.split()[0], o.split()[-1].lower() == "desc") for o in (order or "").split(",") if o.strip()]
    return Path(name, nodes, hops, where, [r.strip() for r in returns.split(",")], orders, int(limit) if limit else None, similar)


def run(graph: Graph, query: str, search: Callable[[str, int], DataFrame], limit: int) -> DataFrame:
    """Rows with a column for each item of RETURN: a property, a node as its id, or the path as an array of ids.

    With SIMILAR the graph is first cut down to what the searches found.
    """
    p = parse(query)
    limit = p.limit or limit
    where, found = p.where, {}
    for i, (node, text, n) in enumerate(p.similar):
        found.setdefault(node, []).append((i, search(text, n or limit * 10).select("indexid", F.col("score").alias(f"score{i}"))))
        where = _SIMILAR.sub(f"{node}.match_{i} > 0", where, count=1)
    nodes = graph.nodes
    if "id" not in nodes.columns:
        nodes = nodes.withColumn("id", F.col("indexid").cast("string"))
    both = graph.both().select("src", "dst", F.struct("src", "dst", "weight").alias("__edge"))
    rows = None
    for at, (name, props) in enumerate(p.nodes):
        own = nodes
        for k, v in props.items():
            own = own.where(F.col(k).cast("string") == v)
        scores = [f"score{i}" for i, _ in found.get(name, [])]
        for i, hits in found.get(name, []):
            own = own.join(hits, "indexid", "left").withColumn(f"match_{i}", F.coalesce(f"score{i}", F.lit(0.0)))
        score = F.coalesce(*scores, F.lit(0.0)) if scores else F.lit(None).cast("double")
        own = own.withColumn("score", score).drop(*scores)
        packed = own.select(F.col("indexid").alias(f"{name}__key"), F.struct(*own.columns).alias(name))
        if rows is None:
            rows = packed.withColumn("__path", F.array(f"{name}__key")).withColumn("__used", F.array().cast("array<string>"))
            continue
        least, most, edge_name, edge_props = p.hops[at - 1]
        link = both
        for k, v in edge_props.items():
            link = link.where(F.col(f"__edge.{k}").cast("string") == v)
        walk, out = rows.withColumn("__walk", F.array().cast(f"array<{dict(both.dtypes)['__edge']}>")), None
        for step in range(1, most + 1):
            walk = walk.withColumn("src", F.element_at("__path", -1)).join(link, "src").withColumn("__walk", F.concat("__walk", F.array("__edge")))
            edge = F.concat_ws("-", F.least("src", "dst"), F.greatest("src", "dst"))
            walk = walk.where(~F.array_contains("__used", edge)).withColumn("__used", F.concat("__used", F.array(edge))).withColumn("__path", F.concat("__path", F.array("dst"))).drop("src", "dst", "__edge")
            if step >= least:
                one = walk.withColumn(f"{name}__key", F.element_at("__path", -1)).join(packed, f"{name}__key")
                out = one if out is None else out.unionByName(one)
        rows = out.withColumnRenamed("__walk", edge_name) if edge_name and most > 1 else out.withColumn(edge_name, F.element_at("__walk", 1)).drop("__walk") if edge_name else out.drop("__walk")
    edges = {h[2] for h in p.hops if h[2]}
    if where:
        rows = rows.where(F.expr(re.sub(r"\"([^\"]*)\"", r"'\1'", where)))

    def item(text: str) -> Column:
        if text == p.name:
            return F.col("__path")
        return F.col(text) if "." in text or text in edges else F.col(f"{text}.id")

    chosen = [item(r).alias(r) for r in p.returns]
    order = [F.desc(item(o)) if down else F.asc(item(o)) for o, down in p.order]
    return rows.orderBy(*order, "__path").select(*chosen).limit(limit)
