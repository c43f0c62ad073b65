"""The facade: one index with content, keyword and dense views and a graph, and what can be asked of it."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.tokenize import alphanum
from corvane.functions.vectors import Encoder, encode, hashing_encoder, normalise, principal_axes, remove_axes
from corvane.operators import dense, fusion, retrieval, scoring
from corvane.operators.graph import Graph, canonical, knn_edges, related_edges
from corvane.plans import cypher
from corvane.plans.dialect import SIMILAR, Clause, Query, Rewriter, SqlError, issql
from corvane.sources.content import Columns, Content, numbered
from corvane.sources.scratch import stage


class IndexNotFoundError(KeyError):
    """There is no index of that name."""


class ReadOnlyError(PermissionError):
    """The index isn't writable."""


@dataclass
class Settings:
    """What an index consists of, and defaults of its queries."""

    keyword: bool = True
    dense: bool = False
    method: str = "bm25"
    method_options: dict[str, float] = field(default_factory=dict)
    normalize: str | bool = True
    weights: float = 0.5
    limit: int = 3
    instructions: dict[str, str] = field(default_factory=dict)
    dimensions: int | None = None
    pca: int | None = None
    columns: Columns = field(default_factory=Columns)
    types: dict[str, str] = field(default_factory=dict)
    expressions: dict[str, str] = field(default_factory=dict)
    writable: bool = True
    probes: int = 4


#: Up to so many candidates a table of them is broadcast.
_FEW = 200_000


def _small(found: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, broadcast where that is a bound."""
    return F.broadcast(found) if rows <= _FEW else found


def stored_settings(settings: Settings) -> dict[str, Any]:
    return asdict(settings)


def read_settings(stored: dict[str, Any]) -> Settings:
    return Settings(**{**stored, "columns": Columns(**stored["columns"])})


def other_text(sections: DataFrame, docs: DataFrame, id: str, column: str) -> DataFrame:
    """Sections with the text of another column of the documents, where it isn't null."""
    texts = docs.where(F.col(column).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(column).cast("string").alias("text"))
    return sections.drop("text").join(texts, "id").select("indexid", "id", "text", "tags", "entry")


def given_vectors(sections: DataFrame, docs: DataFrame, id: str, vector: str) -> DataFrame:
    """(indexid, vector) from a column of the documents."""
    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(vector).alias("vector")).where("vector is not null").dropDuplicates(["id"])
    return sections.select("indexid", "id").join(rows, "id").select("indexid", normalise(F.col("vector")).alias("vector"))


@dataclass
class Index:
    """Views of one set of rows. Tables are DataFrames; changes give a new index."""

    content: Content
    settings: Settings = field(default_factory=Settings)
    vectors: DataFrame | None = None
    encoder: Encoder = field(default_factory=hashing_encoder)
    graph: Graph | None = None
    indexes: dict[str, Index] = field(default_factory=dict)
    sources: dict[str, str] = field(default_factory=dict)
    tokenizer: scoring.Tokenizer = alphanum
    given: bool = False
    axes: np.ndarray | None = None
    cells: tuple[DataFrame, np.ndarray] | None = None
    words: scoring.Terms | None = None
    translator: Callable[[str], str] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.content.sections.sparkSession

    @classmethod
    def of(cls, docs: DataFrame, id: str | None, settings: Settings | None = None, tags: str | None = None, vector: str | None = None, encoder: Encoder | None = None, indexes: dict[str, tuple[str, Settings]] | None = None, **content: Any) -> Index:
        """Builds an index; ``vector`` names a column with ready vectors, else texts are encoded where the settings want dense search.

        ``indexes``: further indexes by name, each over another text column with its own settings.
        """
        settings = settings or Settings()
        # Where nothing is indexed, rows without text are still found, by their id.
        bare = not (settings.keyword or settings.dense or vector or indexes)
        table = Content.of(docs, id, settings.columns, tags, **{"idtext": bare, **content})
        self = cls(table, settings, encoder=encoder or hashing_encoder())
        if vector:
            self.vectors, self.given = given_vectors(table.sections, docs, id, vector), True
        elif settings.dense:
            self.vectors = self.encoded(table.sections)
        for name, (column, own) in (indexes or {}).items():
            part = replace(table, sections=other_text(table.sections, docs, id, column))
            self.indexes[name], self.sources[name] = cls(part, own, encoder=self.encoder), column
            if own.dense:
                self.indexes[name].vectors = self.indexes[name].encoded(part.sections)
        return self

    def encoded(self, sections: DataFrame) -> DataFrame:
        """(indexid, vector) of sections, with the main axes removed where the settings say so."""
        v = encode(F.col("text"), self.encoder, self.settings.instructions.get("data", ""), self.settings.dimensions)
        rows = sections.where("text is not null").select("indexid", v.alias("vector"))
        if self.settings.pca:
            if self.axes is None:
                _, self.axes = principal_axes(rows, "vector", self.settings.pca)
            rows = rows.select("indexid", remove_axes(F.col("vector"), self.axes).alias("vector"))
        return rows

    def encoded_at(self, path: str, parts: int = 16) -> DataFrame:
        """(indexid, vector) of all sections, encoded part by part under ``path``; parts that an earlier try with the same settings finished are kept.

        Parts go by hash of text, so texts that didn't change since then are found again.
        """
        key = hashlib.sha256(json.dumps([self.settings.instructions, self.settings.dimensions, parts], sort_keys=True).encode()).hexdigest()[:16]
        spark, root = self.spark, f"{path}/{key}"
        texts = self.content.sections.where("text is not null").select("text").distinct().withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        v = encode(F.col("text"), self.encoder, self.settings.instructions.get("data", ""), self.settings.dimensions).alias("vector")
        for i in range(parts):
            at = f"{root}/part-{i}"
            rows = texts.where(F.col("part") == i).select("text")
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
                done = spark.read.parquet(at)
                rows = rows.join(done.select("text"), "text", "left_anti")
                if rows.isEmpty():
                    continue
            rows.select("text", v).write.mode("append").parquet(at)
        known = spark.read.parquet(*(f"{root}/part-{i}" for i in range(parts))).dropDuplicates(["text"])
        return self.content.sections.select("indexid", "text").join(known, "text").select("indexid", "vector")

    def transform(self, texts: list[str], category: str = "query") -> list[list[float]]:
        """Vectors of texts."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "qid int, text string")
        v = encode(F.col("text"), self.encoder, self.settings.instructions.get(category, ""), self.settings.dimensions)
        rows = rows.select("qid", v.alias("v"))
        if self.axes is not None:
            rows = rows.select("qid", remove_axes(F.col("v"), self.axes).alias("v"))
        return [list(r["v"]) for r in rows.orderBy("qid").collect()]

    # Changes

    def _writable(self) -> None:
        if not self.settings.writable:
            raise ReadOnlyError("the index isn't writable")

    def upsert(self, docs: DataFrame, id: str, tags: str | None = None, vector: str | None = None) -> Index:
        """With documents that replace those of the same ids; only their texts are encoded and only their edges are looked for."""
        self._writable()
        content = self.content.upsert(Content.of(docs, id, self.settings.columns, tags))
        out = self._less(content)
        new = content.sections.where(F.col("indexid") >= content.offset)
        if self.vectors is not None:
            vectors = given_vectors(new, docs, id, vector) if vector else self.encoded(new)
            out.vectors = out.vectors.unionByName(vectors)
            if out.graph is not None:
                nodes = out.graph.nodes.unionByName(new.select("indexid", "id", "text"), allowMissingColumns=True)
                found = dense.search(out.vectors, vectors.withColumnRenamed("indexid", "qid"), 15, loops=False).where("score > 0.1")
                edges = found.select(F.col("qid").alias("src"), F.col("indexid").alias("dst"), F.col("score").alias("weight"))
                out.graph = Graph(nodes, canonical(out.graph.edges.unionByName(edges)))
                if "topic" in nodes.columns:
                    out.graph = out.graph.with_inferred()
        for name, part in out.indexes.items():
            if (column := self.sources[name]) in docs.columns:
                part.content = replace(part.content, sections=part.content.sections.unionByName(other_text(new, docs, id, column)))
                if part.vectors is not None:
                    part.vectors = part.vectors.unionByName(part.encoded(other_text(new, docs, id, column)))
        return out

    def delete(self, ids: list[str]) -> Index:
        self._writable()
        return self._less(self.content.delete(self.spark.createDataFrame([(str(i),) for i in ids], "id string")))

    def reindex(self, settings: Settings | None = None, function: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        """Numbers made dense, with new settings and a change of the sections if asked for.

        Texts are encoded anew; vectors that were given move to the new numbers. A graph has to be made anew.
        """
        self._writable()
        content = self.content.reindex()
        if function:
            content = replace(content, sections=function(content.sections))
        out = replace(self, content=content, settings=settings or self.settings, graph=None, indexes={}, axes=None, cells=None, words=None)
        moved = numbered(self.content.sections.select(F.col("indexid").alias("old")), "old")
        for name, part in self.indexes.items():
            sections = part.content.sections.withColumnRenamed("indexid", "old").join(moved, "old").select("indexid", "id", "text", "tags", "entry")
            out.indexes[name] = replace(part, content=replace(content, sections=sections), cells=None, words=None)
            if part.vectors is not None:
                out.indexes[name].vectors = part.encoded(sections)
        if self.given and self.vectors is not None:
            out.vectors = self.vectors.withColumnRenamed("indexid", "old").join(moved, "old").select("indexid", "vector")
        elif self.vectors is not None or out.settings.dense:
            out.vectors = out.encoded(content.sections)
        return out

    def _less(self, content: Content) -> Index:
        """The views of the rows that ``content`` still has."""
        live = content.sections.select("indexid")
        keep = lambda t: None if t is None else t.join(live, "indexid", "left_semi")
        out = replace(self, content=content, vectors=keep(self.vectors), indexes={}, cells=None, words=None)
        if self.graph is not None:
            out.graph = self.graph.without(self.graph.nodes.select("indexid").join(live, "indexid", "left_anti"))
        for name, part in self.indexes.items():
            out.indexes[name] = replace(part, content=replace(part.content, sections=keep(part.content.sections)), vectors=keep(part.vectors), cells=None, words=None)
        return out

    def count(self) -> int:
        return self.content.count()

    def save(self, path: str) -> None:
        """All views under ``path``, subindexes and settings too; what is to be loaded is written last."""
        self.content.save(path)
        if self.vectors is not None:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        if self.graph is not None:
            self.graph.save(f"{path}/graph")
        if self.cells is not None:
            self.cells[0].write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/cells")
        if self.settings.keyword:
            self.terms_index().build(f"{path}/terms")
        for name, part in self.indexes.items():
            part.save(f"{path}/indexes/{name}")
        names = {
            "vectors": self.vectors is not None, "graph": self.graph is not None, "given": self.given, "axes": None if self.axes is None else self.axes.tolist(), "settings": stored_settings(self.settings),
            "indexes": list(self.indexes), "sources": self.sources, "centres": None if self.cells is None else self.cells[1].tolist(),
        }
        self.spark.createDataFrame([(json.dumps(names),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings | None = None, encoder: Encoder | None = None, tokenizer: scoring.Tokenizer = alphanum) -> Index:
        """A saved index, with the settings that it was saved with unless others are given."""
        names = json.loads(spark.read.text(f"{path}/index").first()[0])
        self = cls(Content.load(spark, path), settings or read_settings(names["settings"]), encoder=encoder or hashing_encoder(), tokenizer=tokenizer)
        self.vectors = spark.read.parquet(f"{path}/vectors") if names["vectors"] else None
        self.graph = Graph.load(spark, f"{path}/graph") if names["graph"] else None
        self.given, self.axes = names["given"], None if names["axes"] is None else np.array(names["axes"])
        self.cells = None if names["centres"] is None else (spark.read.parquet(f"{path}/cells"), np.array(names["centres"]))
        if self.settings.keyword and names["settings"]["keyword"]:
            self.words = scoring.Terms.load(spark, f"{path}/terms", self._method())
        self.indexes = {name: cls.load(spark, f"{path}/indexes/{name}", None, encoder, tokenizer) for name in names["indexes"]}
        self.sources = names["sources"]
        return self

    # Search

    def _method(self) -> scoring.Method:
        return scoring.METHODS[self.settings.method](**self.settings.method_options)

    def terms_index(self) -> scoring.Terms:
        return self.words or scoring.Terms.of(self.content.sections, "indexid", "text", self._method(), self.tokenizer)

    def built(self) -> Index:
        """With the terms index written out, which pays from the second search on."""
        self.words = self.terms_index().build()
        return self

    def keyword(self, queries: list[str], k: int | None) -> DataFrame:
        """(qid, indexid, score) by words. Normalising needs counts of all terms, so it builds the terms index."""
        if self.settings.normalize is True:
            self.built()
        terms = self.terms_index()
        found = terms.search(queries, k, self.tokenizer).where("score > 0")
        if self.settings.normalize is True:
            return scoring.normalise(found, terms.corpus().select("avgscore"))
        return scoring.bayes(found) if self.settings.normalize else found

    def clustered(self, cells: int | None = None, probes: int | None = None) -> Index:
        """With vectors in cells (about the square root of their number times four), of which a search reads ``probes`` (a 16th of them, four at least).

        The centres are fitted to at most ``dense.SAMPLE`` vectors; every vector is in a cell.
        """
        n = cells or dense.cell_count(self.vectors.count())
        return replace(self, cells=dense.clusters(self.vectors, n), settings=replace(self.settings, probes=probes or max(4, -(-n // 16))))

    def nearest(self, queries: list[str] | list[list[float]], k: int | None) -> DataFrame:
        """(qid, indexid, score) by vectors; scores of 0 and less are left out. With cells it is approximate."""
        rows = self.transform(queries) if queries and isinstance(queries[0], str) else queries
        asked = dense.vectors(self.spark, rows)
        if self.cells is not None and k is not None:
            return dense.probe(*self.cells, asked, k, self.settings.probes).where("score > 0")
        return dense.search(self.vectors, asked, k).where("score > 0")

    def candidates(self, queries: list[str], k: int, weights: float | None = None, index: str | None = None) -> DataFrame:
        """(qid, indexid, score) by what the index has: words, vectors, or both fused."""
        if index:
            if index not in self.indexes:
                raise IndexNotFoundError(index)
            return self.indexes[index].candidates(queries, k, weights)
        if self.vectors is None and not self.settings.keyword and self.indexes:
            return next(iter(self.indexes.values())).candidates(queries, k, weights)
        w = self.settings.weights if weights is None else weights
        both = self.vectors is not None and self.settings.keyword
        if not both or w in (0, 1):
            return self.keyword(queries, k) if self.vectors is None or both and w == 0 else self.nearest(queries, k)
        d, s = self.nearest(queries, k * 10), self.keyword(queries, k * 10)
        fuse = fusion.log_odds if self.settings.normalize not in (True, False) else fusion.convex if self.settings.normalize else fusion.reciprocal
        return scoring.top(fuse(d, s, w), k)

    def search(self, query: str, limit: int | None = None, weights: float | None = None, index: str | None = None, parameters: dict[str, Any] | None = None) -> DataFrame:
        """The rows of SQL, of a path query, or (id, text, score) of the best rows for a text."""
        limit = limit or self.settings.limit
        if self.translator is not None and not issql(query) and not cypher.isquery(query):
            query = self.translator(query)  # plain words to a query, by a model or by rules
        if self.graph is not None and cypher.isquery(query):
            return self.cypher(query, limit)
        if issql(query):
            return self.sql(query, limit, parameters, weights, index)
        found = self.candidates([query], limit, weights, index)
        rows = self.content.sections.join(_small(found.select("indexid", "score"), limit), "indexid")
        return rows.select("id", "text", "score").orderBy(F.desc("score"), "id")

    def batchsearch(self, queries: list[str], limit: int | None = None, weights: float | None = None) -> DataFrame:
        """(qid, id, text, score) of plain-text queries, in one job."""
        found = self.candidates(queries, limit or self.settings.limit, weights)
        return self.content.sections.join(found, "indexid").select("qid", "id", "text", "score")

    def sql(self, query: str, limit: int | None = None, parameters: dict[str, Any] | None = None, weights: float | None = None, index: str | None = None) -> DataFrame:
        """A query of the dialect. ``limit`` holds only for queries without LIMIT; None returns all rows."""
        q = Rewriter(self.settings.types, self.settings.expressions, self.content.typed, self.content.objects is not None)(query)
        spark = self.spark
        own = int(q.limit) if q.limit and q.limit.isdigit() else int((parameters or {})[q.limit[1:]]) if q.limit else limit
        names = {n: f"v{uuid.uuid4().hex}" for n in "sdocg"}
        sections, documents, where, few = self.content.sections, self.content.documents, q.where, 0
        try:
            tables = f"{names['s']} s {'' if q.inner else 'LEFT '}JOIN {names['d']} d ON s.id = d.id"
            if q.similar:
                where, scores, few = self._similar(q, where, own or self.settings.limit, parameters or {}, weights, index)
                _small(scores, few).createOrReplaceTempView(names["c"])
                tables += f" LEFT JOIN {names['c']} c ON s.indexid = c.indexid"
                if q.narrow:  # then JSON is parsed for candidates only
                    sections = sections.join(_small(scores.select("indexid"), few), "indexid", "left_semi")
                    documents = documents.join(_small(sections.select("id"), few), "id", "left_semi")
            sections.createOrReplaceTempView(names["s"])
            documents.select("id", "data", F.try_parse_json("data").alias("v")).createOrReplaceTempView(names["d"])
            if self.content.objects is not None:
                self.content.objects.select("id", "object").createOrReplaceTempView(names["o"])
                tables += f" LEFT JOIN {names['o']} o ON s.id = o.id"
            if q.graph:
                if self.graph is None:
                    raise SqlError("there is no graph")
                self.graph.nodes.createOrReplaceTempView(names["g"])
                tables += f" LEFT JOIN {names['g']} g ON s.indexid = g.indexid"
            return spark.sql(self._text(q, tables, where, limit), args=parameters or None)
        except SqlError:
            raise
        except Exception as e:
            if "similar" in str(e) or type(e).__name__ in ("ParseException", "AnalysisException", "SparkNumberFormatException"):
                raise SqlError(str(e).splitlines()[0]) from e
            raise
        finally:
            for n in names.values():
                spark.catalog.dropTempView(n)

    def _text(self, q: Query, tables: str, where: str | None, limit: int | None) -> str:
        out = f"SELECT {q.select} FROM {tables}"
        out += f" WHERE {where}" if where else ""
        out += f" GROUP BY {q.groupby}" if q.groupby else ""
        out += f" HAVING {q.having}" if q.having else ""
        if q.orderby:
            out += f" ORDER BY {q.orderby}"
        elif q.similar and not q.groupby and re.search(r"\bc\.score\b", q.select) and not q.select.startswith("distinct "):
            out += " ORDER BY c.score DESC, s.indexid"
        cut = q.limit or limit
        out += f" LIMIT {cut}" if cut else ""
        return out + (f" OFFSET {q.offset}" if q.offset and cut else "")

    def _similar(self, q: Query, where: str, limit: int, parameters: dict[str, Any], weights: float | None, index: str | None) -> tuple[str, DataFrame, int]:
        """The condition over candidate sets, staged (indexid, clauses, score) (the mean over the clauses that found a row), and a bound of its rows."""
        every, bound = None, 0
        for i, c in enumerate(q.similar):
            c = Clause(str(parameters[c.query[1:]]) if c.query.startswith(":") else c.query, c.candidates, c.weights, c.index)
            many = c.candidates or (limit * 10 if q.filters > 1 else limit)
            bound += many
            one = self.candidates([c.query], many, weights if c.weights is None else c.weights, c.index or index).select(F.lit(i).alias("clause"), "indexid", "score")
            every = one if every is None else every.unionByName(one)
        scores = every.groupBy("indexid").agg(F.collect_set("clause").alias("clauses"), F.avg("score").alias("score"))
        for i in reversed(range(len(q.similar))):
            where = where.replace(f"{SIMILAR}{i}", f"coalesce(array_contains(c.clauses, {i}), false)")
        return where, stage(scores, "candidates"), bound

    def similarity(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        """All of ``texts`` ranked by their similarity to ``query``."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "indexid long, text string")
        v = rows.select("indexid", encode(F.col("text"), self.encoder, dimensions=self.settings.dimensions).alias("vector"))
        found = dense.search(v, dense.vectors(self.spark, self.transform([query])), None)
        return [(r["indexid"], r["score"]) for r in found.orderBy(F.desc("score"), "indexid").collect()]

    def explain(self, query: str, limit: int | None = None) -> DataFrame:
        """What each token of the best rows for a query adds to the similarity."""
        found = self.candidates([query], limit or self.settings.limit)
        rows = self.content.sections.join(_small(found.select("indexid"), limit or self.settings.limit), "indexid").select("indexid", "text")
        return retrieval.explain(rows, query, self.encoder)

    def terms(self, query: str) -> list[str]:
        """The words that a query (plain or with ``similar``) searches for."""
        text = " ".join(c.query for c in Rewriter()(query).similar) if issql(query) else query
        row = self.spark.createDataFrame([(text,)], "q string").select(self.tokenizer(F.col("q")).alias("t")).first()
        return row["t"]

    # Graph

    def with_graph(self, limit: int = 15, minscore: float = 0.1) -> Index:
        """With a graph whose edges join rows of similar vectors: exact by all pairs, or by cells where the index has them (see ``clustered``)."""
        nodes = self.content.sections.select("indexid", "id", "text")
        return replace(self, graph=Graph(nodes, stage(knn_edges(self.vectors, limit, minscore, self.cells, self.settings.probes), "edges")))

    def with_topics(self, **options: Any) -> Index:
        """With topics on the graph (see ``Graph.with_topics``); rows that are upserted later take those around them."""
        return replace(self, graph=self.graph.with_topics(encoder=self.encoder, **options))

    def with_relationships(self, docs: DataFrame, id: str, relationships: str = "relationships") -> Index:
        """With edges that documents name themselves, added to those of the graph."""
        ids = self.content.sections.select("id", "indexid")
        rows = docs.select(F.col(id).cast("string").alias("id"), relationships).join(ids, "id").select("indexid", relationships)
        given = related_edges(rows, ids, relationships)
        old = self.graph or Graph(self.content.sections.select("indexid", "id", "text"), given.where("false"))
        return replace(self, graph=Graph(old.nodes, canonical(old.edges.unionByName(given))))

    def cypher(self, query: str, limit: int | None = None) -> DataFrame:
        """A path query; its SIMILAR conditions use this index."""
        return cypher.run(self.graph, query, lambda text, n: self.candidates([text], n), limit or self.settings.limit)

    def subgraph(self, query: str, limit: int | None = None) -> Graph:
        """The graph on the best rows for a query, with their scores."""
        found = self.candidates([query], limit or self.settings.limit)
        return self.graph.induced(found.select("indexid", "score"))
