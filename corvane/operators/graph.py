"""Graphs as two tables: nodes (indexid, ...) and edges (src, dst, weight) with src < dst.

Defined results: loops and edges without one of their nodes are dropped by
``canonical`` and by the joins with nodes; of repeated edges the heaviest stays;
null weights count as 0 where weights are summed; graphs without nodes or edges
give empty or lone results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import Encoder, encode
from corvane.operators import dense
from corvane.operators import rounds as held
from corvane.sources.scratch import release, stage


def canonical(edges: DataFrame) -> DataFrame:
    """Edges once each, from the lesser to the greater node, with the greatest weight; no loops."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    return rows.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def knn_edges(vectors: DataFrame, limit: int = 15, minscore: float = 0.1, cells: tuple[DataFrame, np.ndarray] | None = None, probes: int = 4) -> DataFrame:
    """Edges to each row's nearest ``limit`` other rows whose similarity is over ``minscore``, from (indexid, vector).

    Exact, by all pairs, unless ``cells`` (see ``dense.clusters``) are given, of which each row looks into ``probes``.
    """
    pairs = dense.neighbours(*cells, limit, probes) if cells is not None else dense.search(vectors, vectors.select(F.col("indexid").alias("qid"), "vector"), limit, loops=False)
    return canonical(pairs.where(F.col("score") > minscore).select(F.col("qid").alias("src"), F.col("indexid").alias("dst"), F.col("score").alias("weight")))


def related_edges(docs: DataFrame, ids: DataFrame, relationships: str = "relationships") -> DataFrame:
    """Edges from a column of arrays of ids or of structs (id, weight): joined to ``ids`` (id, indexid)."""
    rows = docs.select(F.col("indexid").alias("src"), F.explode(relationships).alias("r"))
    plain = dict(rows.dtypes)["r"].startswith("struct")
    to = F.col("r.id").cast("string") if plain else F.col("r").cast("string")
    weight = F.coalesce(F.col("r.weight").cast("double"), F.lit(1.0)) if plain and "weight" in rows.schema["r"].dataType.names else F.lit(1.0)
    return canonical(rows.select("src", to.alias("id"), weight.alias("weight")).join(ids.select("id", F.col("indexid").alias("dst")), "id").select("src", "dst", "weight"))


@dataclass
class Graph:
    """An undirected graph."""

    nodes: DataFrame
    edges: DataFrame

    def both(self) -> DataFrame:
        """Each edge in both directions."""
        e = self.edges.select("src", "dst", "weight")
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def neighbours(self, node: int) -> DataFrame:
        """(dst, weight) of a node, heaviest first."""
        return self.both().where(F.col("src") == node).select("dst", "weight").orderBy(F.desc("weight"), "dst")

    def adjacency(self) -> DataFrame:
        """(src, dst, weight, rank): every node's edges, ranked by weight."""
        return self.both().withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")))

    def has_edge(self, src: int, dst: int | None = None) -> bool:
        e = self.both().where(F.col("src") == src)
        return not (e if dst is None else e.where(F.col("dst") == dst)).isEmpty()

    def node(self, node: int) -> dict[str, object] | None:
        """A node's attributes, None where there is no such node."""
        row = self.nodes.where(F.col("indexid") == node).first()
        return None if row is None else row.asDict(recursive=True)

    def has_node(self, node: int) -> bool:
        return not self.nodes.where(F.col("indexid") == node).isEmpty()

    def attribute(self, node: int, name: str) -> object:
        """One attribute of a node, None where node or attribute are missing."""
        return (self.node(node) or {}).get(name)

    def with_attribute(self, name: str, values: DataFrame) -> Graph:
        """With an attribute from (indexid, value) in place of what nodes had by that name; null where no value is given."""
        given = values.select("indexid", F.col("value").alias(name))
        return Graph(self.nodes.drop(name).join(given, "indexid", "left"), self.edges)

    def without_attribute(self, *names: str) -> Graph:
        return Graph(self.nodes.drop(*names), self.edges)

    def scan(self, attribute: str | None = None) -> DataFrame:
        """Nodes, or those that have an attribute."""
        return self.nodes if attribute is None else self.nodes.where(F.col(attribute).isNotNull())

    def count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def without(self, ids: DataFrame) -> Graph:
        """The graph less nodes (indexid) and their edges."""
        e = self.edges.join(ids.select(F.col("indexid").alias("src")), "src", "left_anti").join(ids.select(F.col("indexid").alias("dst")), "dst", "left_anti")
        return Graph(self.nodes.join(ids.select("indexid"), "indexid", "left_anti"), e.select("src", "dst", "weight"))

    def induced(self, ids: DataFrame) -> Graph:
        """The graph on some nodes (indexid); a score among their columns goes to the nodes."""
        e = self.edges.join(ids.select(F.col("indexid").alias("src")), "src", "left_semi").join(ids.select(F.col("indexid").alias("dst")), "dst", "left_semi")
        return Graph(self.nodes.join(ids, "indexid"), e.select("src", "dst", "weight"))

    def degree(self) -> DataFrame:
        """(indexid, degree, centrality): centrality is degree / (nodes - 1)."""
        n = self.both().groupBy(F.col("src").alias("indexid")).agg(F.count(F.lit(1)).alias("degree"))
        total = self.nodes.agg(F.count(F.lit(1)).alias("total"))
        rows = self.nodes.select("indexid").join(n, "indexid", "left").crossJoin(F.broadcast(total))
        d = F.coalesce("degree", F.lit(0))
        return rows.select("indexid", d.cast("long").alias("degree"), F.when(F.col("total") > 1, d / (F.col("total") - 1)).otherwise(F.lit(1.0)).alias("centrality"))

    def pagerank(self, rounds: int = 20, damping: float = 0.85) -> DataFrame:
        """(indexid, rank) after a number of rounds of weighted PageRank.

        Each round is written out: the next one reads it twice, for what the
        links carry and for the rank of nodes without links, which all share.
        """
        links = self.both()
        out = links.groupBy("src").agg(F.sum("weight").alias("out"))
        links = stage(links.join(out, "src").where("out > 0").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "links")
        total = max(self.nodes.count(), 1)
        linked = links.select(F.col("src").alias("indexid"), F.lit(True).alias("linked")).distinct()
        ranks = stage(self.nodes.select("indexid").join(linked, "indexid", "left").select("indexid", F.col("linked").isNull().alias("loose"), F.lit(1.0 / total).alias("rank")), "ranks")
        for _ in range(rounds):
            sent = ranks.join(links, ranks.indexid == links.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            shared = ranks.agg((F.coalesce(F.sum(F.when(F.col("loose"), F.col("rank"))), F.lit(0.0)) / total).alias("shared"))
            rows = ranks.select("indexid", "loose").join(sent, F.col("indexid") == F.col("dst"), "left").crossJoin(F.broadcast(shared))
            ranks = stage(rows.select("indexid", "loose", (F.lit((1 - damping) / total) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("shared"))).alias("rank")), "ranks")
        return ranks.select("indexid", "rank")

    def labels(self, rounds: int | None = None) -> DataFrame:
        """(indexid, label) by synchronous label propagation: each node takes the label of most weight around it, then the least one.

        It runs until no label changes, or for ``rounds``. Where labels come
        back in turns instead, each node gets the least of those it takes in a turn.
        Up to ``rounds.HELD`` nodes a round is one pass over the links without a
        shuffle, and labels go through the driver; beyond it a round is joins.
        """
        if (ids := held.numbers(self.nodes.select("indexid"))) is not None:
            return self._held_labels(ids, rounds)
        links = stage(self.both(), "links")
        labels = self.nodes.select("indexid", F.col("indexid").alias("label"))
        marks, passed = [], []
        while rounds is None or len(passed) < rounds:
            if rounds is None:
                mark = labels.agg(F.sum(F.xxhash64("indexid", "label").cast("decimal(38,0)"))).first()
                if mark in marks:
                    turn = passed[marks.index(mark) :]
                    return labels if len(turn) == 1 else reduce(DataFrame.unionByName, turn).groupBy("indexid").agg(F.min("label").alias("label"))
                marks.append(mark)
            passed.append(labels)
            votes = links.join(labels, links.dst == labels.indexid).groupBy("src", "label").agg(F.sum("weight").alias("w"))
            best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.round("w", 9), F.col("label"))).alias("new"))
            labels = stage(labels.join(best, labels.indexid == best.src, "left").select("indexid", F.coalesce("new", "label").alias("label")), "labels")
        return labels

    def _held_labels(self, ids: np.ndarray, rounds: int | None) -> DataFrame:
        links = held.Rounds.of(self.both(), ids)

        def step(labels: np.ndarray) -> np.ndarray:
            found, new = links.ask(held.vote, "place int, label int", labels), labels.copy()
            new[found["place"]] = found["label"]
            return new

        labels, seen, done = np.arange(len(ids), dtype=np.int32), {}, 0
        while rounds is None or done < rounds:
            if rounds is None:
                mark = hashlib.blake2b(labels.tobytes()).digest()
                if mark in seen:
                    least = labels
                    for _ in range(done - seen[mark] - 1):  # the rest of the turn once more
                        labels = step(labels)
                        least = np.minimum(least, labels)
                    labels = least
                    break
                seen[mark] = done
            labels, done = step(labels), done + 1
        links.release()
        return links.labelled(self.nodes, labels)

    def components(self) -> DataFrame:
        """(indexid, label): the least node of each node's component."""
        labels = stage(self.nodes.select("indexid", F.col("indexid").alias("label")), "labels")
        links = stage(self.both().select("src", "dst"), "links")
        while True:
            got = links.join(labels, links.dst == labels.indexid).groupBy("src").agg(F.min("label").alias("near"))
            new = labels.join(got, labels.indexid == got.src, "left").select("indexid", F.least("label", "near").alias("label"))
            jump = new.select(F.col("indexid").alias("label"), F.col("label").alias("far"))
            new = stage(new.join(jump, "label", "left").select("indexid", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
            if new.join(labels.withColumnRenamed("label", "old"), "indexid").where("label <> old").isEmpty():
                return new
            labels = new

    def louvain(self, resolution: float = 1.0) -> DataFrame:
        """(indexid, label) of greedy modularity communities, by rounds of joins: local moving, then contraction, until nothing gains.

        In a round each node looks for the community around it with the
        greatest gain, and a half of the nodes (another one each time, by hash)
        may move. Local moving ends when no node wants to move, or when the
        modularity hasn't grown for two rounds; the best round counts. A label
        is the least member's number; nodes without edges stay alone. Up to
        ``rounds.HELD`` nodes a round is one pass over the links without a
        shuffle, and a few numbers of each node go through the driver; beyond
        it a round is joins, and only totals reach the driver.
        """
        if (ids := held.numbers(self.both().select("src"))) is not None:
            return self._held_louvain(ids, resolution)
        edges = stage(self.both().groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "links")
        total = edges.agg(F.sum("weight")).first()[0]
        whole = self.nodes.select("indexid", F.col("indexid").alias("label"))
        if not total:
            return whole
        while True:
            group, moved = _moved(edges, total, resolution)
            if not moved:
                return whole
            names = group.groupBy("label").agg(F.min("indexid").alias("name"))
            group = group.join(names, "label").select(F.col("indexid").alias("label"), "name")
            whole = stage(whole.join(group, "label", "left").select("indexid", F.coalesce("name", "label").alias("label")), "communities")
            ends = group.withColumnRenamed("name", "to")
            smaller = edges.join(ends.withColumnRenamed("label", "src").withColumnRenamed("to", "a"), "src").join(ends.withColumnRenamed("label", "dst").withColumnRenamed("to", "b"), "dst")
            edges = stage(smaller.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "links")

    def _held_louvain(self, ids: np.ndarray, resolution: float) -> DataFrame:
        total = self.both().agg(F.sum("weight")).first()[0]
        if not total:
            return self.nodes.select("indexid", F.col("indexid").alias("label"))
        links, whole = held.Rounds.of(self.both(), ids), ids
        while True:
            label, moved = _held_moved(links, total, resolution)
            if not moved:
                break
            name = np.full(len(label), len(label), np.int32)
            np.minimum.at(name, label, np.arange(len(label), dtype=np.int32))
            names = links.ids[name[label]]  # of each node, the least member of its community
            whole = names[np.searchsorted(links.ids, whole)]
            smaller = links.map(held.contract, "src long, dst long, weight double", names).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
            before, links = links, held.Rounds.of(smaller, np.unique(names))
            before.release()
        links.release()
        return held.Rounds(ids, links.table).labelled(self.nodes, np.searchsorted(ids, whole).astype(np.int32))

    def communities(self, algorithm: str = "louvain", resolution: float = 1.0) -> DataFrame:
        """(indexid, label) by ``louvain``, ``lpa`` (label propagation) or ``components``."""
        return {"louvain": lambda: self.louvain(resolution), "lpa": self.labels, "components": self.components}[algorithm]()

    def with_topics(self, algorithm: str = "louvain", terms: int = 4, resolution: float = 1.0, stopwords: tuple[str, ...] = (), categories: list[str] | None = None, encoder: Encoder | None = None) -> Graph:
        """With ``topic``, ``topicrank`` (0 is the best row) and ``category`` of each node, from communities and their words.

        A community is named by the words that most of its texts have; those
        without words are ``topic_`` and their place by size, and rank by
        degree. Communities of one name are one topic. ``categories`` are
        labels of which each topic gets the nearest, by ``encoder``.
        """
        from corvane.operators import topics

        found = stage(self.communities(algorithm, resolution).withColumnRenamed("label", "grp"), "communities")
        texts = self.nodes.select("indexid", "text") if "text" in self.nodes.columns else self.nodes.select("indexid", F.lit(None).cast("string").alias("text"))
        rows = stage(topics.named(found.join(texts, "indexid"), self.degree(), terms, stopwords), "topics")
        if categories and encoder:
            spark = self.nodes.sparkSession
            vector = lambda c: encode(F.col(c), encoder).alias("vector")
            names = spark.createDataFrame([(c,) for c in categories], "category string").select("category", vector("category"))
            distinct = rows.select("topic").distinct().select("topic", F.translate("topic", "_", " ").alias("words")).select("topic", vector("words"))
            rows = rows.join(topics.categories(distinct, names), "topic", "left")
        else:
            rows = rows.withColumn("category", F.lit(None).cast("string"))
        return Graph(self.without_topics().nodes.join(rows.select("indexid", "topic", "topicrank", "category"), "indexid", "left"), self.edges)

    def without_topics(self) -> Graph:
        return self.without_attribute("topic", "topicrank", "category")

    def topics(self) -> DataFrame:
        """(topic, category, n): topics from the largest on."""
        return self.nodes.where("topic is not null").groupBy("topic").agg(F.first("category").alias("category"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic")

    def with_inferred(self) -> Graph:
        """With topics of nodes that have none, from the nodes around them; they rank after those that have."""
        new = self.nodes.where("topic is null").select("indexid")
        found = self.infer(new).withColumnRenamed("topic", "new_topic").withColumnRenamed("category", "new_category")
        size = self.nodes.where("topic is not null").groupBy(F.col("topic").alias("new_topic")).agg((F.max("topicrank") + 1).alias("after"))
        place = F.row_number().over(Window.partitionBy("new_topic").orderBy("indexid")) - 1
        ranked = found.join(size, "new_topic").withColumn("new_rank", F.col("after") + place).select("indexid", "new_topic", "new_category", "new_rank")
        nodes = self.nodes.join(ranked, "indexid", "left")
        pick = {"topic": "new_topic", "category": "new_category", "topicrank": "new_rank"}
        return Graph(nodes.select(*(F.coalesce(c, pick[c]).alias(c) if c in pick else c for c in self.nodes.columns)), self.edges)

    def shortest(self, source: int, target: int | None = None) -> DataFrame:
        """(indexid, distance, path) of the nearest paths from a node, by frontier joins.

        An edge is 1 - weight long, and 1 if that is under 0.15 (near copies
        are no shortcuts). Of equal paths the one least in order stays.
        """
        length = F.greatest(1 - F.col("weight"), F.lit(0.0))
        links = stage(self.both().select("src", "dst", F.when(length >= 0.15, length).otherwise(F.lit(1.0)).alias("length")), "links")
        spark = self.nodes.sparkSession
        best = spark.createDataFrame([(source, 0.0, [source])], "indexid long, distance double, path array<long>")
        frontier = best
        while True:
            step = frontier.join(links, frontier.indexid == links.src).where(~F.array_contains("path", F.col("dst")))
            step = step.select(F.col("dst").alias("indexid"), F.round(F.col("distance") + F.col("length"), 12).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
            old = best.withColumn("old", F.lit(1))
            every = old.unionByName(step.withColumn("old", F.lit(0)))
            pick = every.groupBy("indexid").agg(F.min(F.struct("distance", "path", "old")).alias("x"))
            before, merged = best, stage(pick.select("indexid", "x.distance", "x.path", "x.old"), "paths")
            release(before)
            best, frontier = merged.drop("old"), merged.where("old = 0").drop("old")
            best._scratch = merged._scratch
            if frontier.isEmpty():
                break
        return best if target is None else best.where(F.col("indexid") == target)

    def paths(self, start: Column, end: Column, least: int, most: int) -> DataFrame:
        """(path) of ``least`` to ``most`` edges between nodes that fulfil conditions on their columns, no edge twice."""
        link = self.both().select("src", "dst")
        first = self.nodes.where(start).select(F.array("indexid").alias("path"), F.array().cast("array<string>").alias("used"))
        last = self.nodes.where(end).select(F.col("indexid").alias("tail"))
        rows, found = first, None
        for i in range(1, most + 1):
            rows = rows.withColumn("src", F.element_at("path", -1)).join(link, "src")
            edge = F.concat_ws("-", F.least("src", "dst"), F.greatest("src", "dst"))
            rows = rows.where(~F.array_contains("used", edge)).select(F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array(edge)).alias("used"))
            if i >= least:
                hit = rows.withColumn("tail", F.element_at("path", -1)).join(last, "tail").select("path")
                found = hit if found is None else found.unionByName(hit)
        return found

    def infer(self, new: DataFrame) -> DataFrame:
        """(indexid, topic, category) for new nodes: what is most frequent around them, then what comes first."""
        around = self.both().join(new.select(F.col("indexid").alias("src")), "src").join(self.nodes.select(F.col("indexid").alias("dst"), "topic", "category"), "dst")
        topic = around.where("topic is not null").groupBy("src", "topic").agg(F.count(F.lit(1)).alias("n")).groupBy("src").agg(F.min_by("topic", F.struct(-F.col("n"), F.col("topic"))).alias("topic"))
        category = around.where("category is not null").groupBy("src", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("src").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"))
        return topic.join(category, "src", "left").select(F.col("src").alias("indexid"), "topic", "category")

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    def json_lines(self) -> DataFrame:
        """(value): a JSON object for each node (``{"node": ...}``) and edge (``{"edge": ...}``)."""
        one = lambda df, kind: df.select(F.to_json(F.struct(F.struct(*df.columns).alias(kind))).alias("value"))
        return one(self.nodes, "node").unionByName(one(self.edges, "edge"))

    @classmethod
    def from_json_lines(cls, lines: DataFrame, attributes: str = "indexid long, id string, text string") -> Graph:
        """The graph of such lines; ``attributes`` is the schema of nodes."""
        kind = f"node struct<{', '.join(': '.join(a.split()) for a in attributes.split(','))}>, edge struct<src: long, dst: long, weight: double>"
        rows = lines.select(F.from_json("value", kind).alias("x"))
        return cls(rows.where("x.node is not null").select("x.node.*"), rows.where("x.edge is not null").select("x.edge.*"))

    def save_jdbc(self, url: str, properties: dict[str, str] | None = None, prefix: str = "") -> None:
        """Nodes and edges as tables of a relational database, which are replaced."""
        self.nodes.write.jdbc(url, prefix + "nodes", "overwrite", properties or {})
        self.edges.write.jdbc(url, prefix + "edges", "overwrite", properties or {})

    @classmethod
    def load_jdbc(cls, spark, url: str, properties: dict[str, str] | None = None, prefix: str = "") -> Graph:  # noqa: ANN001
        found = [spark.read.jdbc(url, prefix + name, properties=properties or {}) for name in ("nodes", "edges")]
        return cls(*(t.toDF(*(c.lower() for c in t.columns)) for t in found))

    @classmethod
    def load(cls, spark, path: str) -> Graph:  # noqa: ANN001
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def _moved(edges: DataFrame, total: float, resolution: float) -> tuple[DataFrame, bool]:
    """(indexid, label) of the best round of local moving over links in both directions (loops are twice what they hold), and whether any node moved."""
    degree = stage(edges.groupBy(F.col("src").alias("indexid")).agg(F.sum("weight").alias("degree")), "degrees")
    now = degree.select("indexid", "degree", F.col("indexid").alias("label"))
    best, most, poor, turn = None, None, 0, 0
    while True:
        ends = now.select(F.col("indexid").alias("dst"), F.col("label").alias("near"))
        links = edges.join(ends, "dst").groupBy(F.col("src").alias("indexid"), "near").agg(F.sum(F.when(F.col("src") != F.col("dst"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight"))).alias("loop"))
        mass = now.groupBy(F.col("label").alias("near")).agg(F.sum("degree").alias("mass"))
        mine = now.select("indexid", "degree", "label")
        own = F.col("near") == F.col("label")
        rows = links.join(mine, "indexid").join(mass, "near")
        gain = F.round(F.coalesce("w", F.lit(0.0)) - resolution * (F.col("mass") - F.when(own, F.col("degree")).otherwise(F.lit(0.0))) * F.col("degree") / total, 9)
        # A node whose own community holds no neighbour of it may leave it for one that gains anything.
        choice = rows.groupBy("indexid").agg(F.max_by(F.struct("near", gain.alias("gain")), F.struct(gain, own, -F.col("near"))).alias("to"), F.max(F.when(own, gain)).alias("stay"), F.sum(F.when(own, F.coalesce("w", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0)))).alias("inside"))
        alone = mass.withColumnRenamed("near", "label").withColumnRenamed("mass", "of")
        state = mine.join(choice, "indexid").join(alone, "label")
        stay = F.coalesce("stay", F.round(-resolution * (F.col("of") - F.col("degree")) * F.col("degree") / total, 9))
        state = stage(state.select("indexid", "degree", "label", F.when(F.col("to.gain") > stay, F.col("to.near")).otherwise(F.col("label")).alias("wish"), "inside"), "moves")
        inside = state.agg(F.sum("inside"), F.sum(F.when(F.col("wish") != F.col("label"), 1).otherwise(0))).first()
        spread = state.groupBy("label").agg(F.sum("degree").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
        quality = (inside[0] or 0.0) / total - resolution * spread / total**2
        if most is None or quality > most + 1e-9:
            best, most, poor = (turn, state), quality, 0
        else:
            poor += 1
        if not inside[1] or poor == 2:
            return best[1].select("indexid", "label"), best[0] > 0
        may = F.pmod(F.xxhash64("indexid", F.lit(turn // 2)), F.lit(2)) == turn % 2
        now = state.select("indexid", "degree", F.when(may, F.col("wish")).otherwise(F.col("label")).alias("label"))
        turn += 1


def _held_moved(links: held.Rounds, total: float, resolution: float) -> tuple[np.ndarray, bool]:
    """``_moved`` with the numbers of all nodes at hand: the label of each place, and whether any node moved."""
    n = len(links.ids)
    found, degree = links.ask(held.degrees, "place int, degree double"), np.zeros(n)
    degree[found["place"]] = found["degree"]
    label = np.arange(n, dtype=np.int32)
    best, most, poor, turn = None, None, 0, 0
    while True:
        mass = np.bincount(label, degree, n)
        may = F.pmod(F.xxhash64("indexid", F.lit(turn // 2)), F.lit(2)) == turn % 2
        found = links.ask(held.move, "place int, wish int, inside double, may boolean", label, degree, mass, total, resolution, flag=may)
        wants = found["wish"] != label[found["place"]]
        quality = found["inside"].sum() / total - resolution * (mass**2).sum() / total**2
        if most is None or quality > most + 1e-9:
            best, most, poor = (turn, label), quality, 0
        else:
            poor += 1
        if not wants.any() or poor == 2:
            return best[1], best[0] > 0
        go, label = wants & found["may"], label.copy()
        label[found["place"][go]] = found["wish"][go]
        turn += 1
