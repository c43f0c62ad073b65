"""Indexes that change, are stored, streamed into, and asked as graphs."""

from __future__ import annotations

import zipfile
from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.vectors import hashing_encoder
from corvane.operators import dense, fusion
from corvane.operators.graph import Graph
from corvane.plans.engine import Index, Settings
from corvane.plans.shards import merge_shards, order_of, shard_of
from corvane.sources import archive
from corvane.sources.content import Columns, Content, numbered
from corvane.streaming import ingest, windows

TEXTS = ["virus cases in the states", "ice shelf in the north collapses", "park bear attack", "lottery ticket wins a million", "bear seen near the lottery shop"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"title {t.split()[0]}") for i, t in enumerate(TEXTS)], "id long, text string, title string")


@pytest.fixture(scope="module")
def index(docs):
    return Index.of(docs, "id", Settings(dense=True), indexes={"titles": ("title", Settings(normalize=False))})


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_hybrid_search_and_explain(index):
    assert index.search("bear attack", 1).first()["id"] == "2"
    assert index.batchsearch(["ice shelf", "million lottery"], 1).orderBy("qid").select("id").collect() == [("1",), ("3",)]
    best = index.explain("bear attack", 1).orderBy(F.desc("score")).first()
    assert best["token"] in ("bear", "attack")
    assert index.terms("select id from x where similar('Bear attack')") == ["bear", "attack"]
    assert index.similarity("bear", TEXTS)[0][0] in (2, 4)


def test_weights_choose_a_side(index):
    words = index.candidates(["bear"], 3, weights=0).count()
    assert words == 2 and index.candidates(["bear"], 5, weights=1).count() >= 2


def test_delete_then_count_and_search(index):
    less = index.delete(["2", "99"])
    assert less.count() == 4 and ids(less.search("bear attack", 5))[0] == "4"
    assert less.vectors.count() == 4 and less.indexes["titles"].count() == 4


def test_upsert_replaces_and_adds(spark, index):
    new = spark.createDataFrame([(2, "quiet day at the beach", "title beach"), (9, "comet over the sea", "title comet")], "id long, text string, title string")
    more = index.upsert(new, "id")
    assert more.count() == 6 and more.vectors.count() == 6
    assert ids(more.search("select id from d where similar('bear attack', 1, 0)")) == ["4"]
    assert ids(more.search("comet sea", 1)) == ["9"]
    assert ids(more.sql("select id from d where similar('comet', 5, titles)")) == ["9"]
    assert more.upsert(new, "id").count() == 6


def test_given_vectors_survive_changes(spark):
    rows = spark.createDataFrame([(i, f"t{i}", [float(i == j) for j in range(3)]) for i in range(3)], "id long, text string, v array<double>")
    index = Index.of(rows, "id", Settings(keyword=False), vector="v").delete(["0"])
    assert {r["indexid"]: list(r["vector"]) for r in index.vectors.collect()} == {1: [0, 1, 0], 2: [0, 0, 1]}
    assert {r["indexid"]: list(r["vector"]) for r in index.reindex().vectors.collect()} == {0: [0, 1, 0], 1: [0, 0, 1]}
    more = index.upsert(spark.createDataFrame([(7, "t7", [1.0, 1.0, 0.0])], rows.schema), "id", vector="v")
    assert more.nearest([[1.0, 1.0, 0.0]], 1).join(more.content.sections, "indexid").first()["id"] == "7"


def test_reindex_makes_numbers_dense(index):
    again = index.delete(["0", "3"]).reindex()
    assert sorted(r["indexid"] for r in again.content.sections.collect()) == [0, 1, 2]
    assert again.search("ice shelf", 1).first()["id"] == "1"


def test_save_and_load(spark, index, tmp_path):
    index.with_graph(3).save(str(tmp_path / "i"))
    back = Index.load(spark, str(tmp_path / "i"))
    assert back.count() == 5 and back.graph.count() == 5 and back.settings == index.settings and back.words.stored
    assert ids(back.search("select id from d where similar('title lottery', 1, titles)")) == ["3"]
    assert ids(back.upsert(spark.createDataFrame([(9, "x", "title comet")], "id long, text string, title string"), "id").sql("select id from d where similar('comet', 1, titles)")) == ["9"]
    assert back.search("bear attack", 1).first()["id"] == "2"


def test_instructions_dimensions_and_axes(spark, docs, tmp_path):
    index = Index.of(docs, "id", Settings(dense=True, keyword=False, pca=1, instructions={"query": "find ", "data": "text "}))
    assert index.search("bear attack", 1).first()["id"] == "2"
    assert abs(np.array(index.transform(["bear"])) @ index.axes.T).max() < 1e-9
    index.save(str(tmp_path / "p"))
    assert np.allclose(Index.load(spark, str(tmp_path / "p"), index.settings).axes, index.axes)
    short = Index.of(docs, "id", Settings(dense=True, keyword=False, dimensions=64))
    assert short.vectors.where("size(vector) = 64").count() == 5 and len(short.transform(["bear"])[0]) == 64


def test_graph_follows_changes(spark, index):
    g = index.with_graph(3, -1.0)
    assert g.delete(["2"]).graph.count() == 4
    more = g.upsert(spark.createDataFrame([(9, "park bear attack again", "t")], "id long, text string, title string"), "id")
    assert more.graph.count() == 6 and more.graph.degree().where("indexid >= 5 and degree > 0").count() == 1
    assert g.subgraph("bear", 2).count() == 2


def test_duplicate_ids_and_rows_without_text(spark):
    rows = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("b", None, 3)], "id string, text string, n int")
    c = Content.of(rows, "id", order=["n"], now=datetime(2024, 1, 1))
    assert sorted((r["indexid"], r["text"]) for r in c.sections.collect()) == [(0, "one"), (1, "two")]
    assert sorted(r["data"] for r in c.documents.collect()) == ['{"id":"a","text":"two","n":2}', '{"id":"b","n":3}']


def test_stored_columns_and_token_lists(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], "x")], "id long, text array<string>, more string")
    c = Content.of(rows, "id", Columns(store=["more"]))
    assert c.sections.first()["text"] == "a b" and c.documents.first()["data"] == '{"more":"x"}'
    assert Content.of(rows, "id", Columns(store=[])).documents.first()["data"] is None


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = numbered(rows, "k", start=10).collect()
    assert sorted((r["k"], r["indexid"]) for r in got) == [(i, i + 10) for i in range(1000)]
    assert numbered(rows.where("false"), "k").count() == 0


def test_stream_into_an_index(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "index")
    schema = "id long, text string"
    for part in ([(1, "one"), (2, "two")], [(2, "new two"), (3, "three")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        ingest.ingest(stream, "id", target, str(tmp_path / "checkpoint")).awaitTermination(120)
    found = ingest.latest(spark, target)
    assert sorted((r["id"], r["text"]) for r in found.sections.collect()) == [("1", "one"), ("2", "new two"), ("3", "three")]
    assert ingest.versions(spark, target) == [1, 3] and ingest.latest(spark, str(tmp_path / "none")) is None
    assert spark.read.parquet(f"{target}/v3/sections").count() == 2  # a batch writes its own rows only
    assert len({r["indexid"] for r in found.sections.collect()}) == 3 and found.documents.count() == 3
    ingest.compact(spark, target)
    assert ingest.versions(spark, target) == [4] and sorted(r["text"] for r in ingest.latest(spark, target).sections.collect()) == ["new two", "one", "three"]
    spark.createDataFrame([(1, None), (5, "five")], schema).coalesce(1).write.mode("append").json(str(source))
    ingest.ingest(spark.readStream.schema(schema).json(str(source)), "id", target, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r["text"] for r in ingest.latest(spark, target).sections.collect()) == ["five", "new two", "three"]


def test_windows_of_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (0, 1, 7, 30)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "e"))
    total = [F.sum("v").alias("s")]
    q = windows.windowed(stream, "ts", "5 minutes", ["k"], total, late="1 minute").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["s"] for r in spark.table("w").orderBy("start").collect()] == [2.0, 1.0]
    assert [r["s"] for r in windows.sessions(spark.read.parquet(str(tmp_path / "e")), "ts", "10 minutes", ["k"], total).orderBy("start").collect()] == [3.0, 1.0]


def test_shards(spark):
    parts = [spark.createDataFrame([(12, 0, 11, 6.3)], ["count(*)", "min(x)", "max(x)", "avg(x)"]), spark.createDataFrame([(16, 2, 14, 6.7)], ["count(*)", "min(x)", "max(x)", "avg(x)"])]
    assert tuple(merge_shards(parts, naive_average=True).first()) == (28, 0, 14, 6.5)
    with pytest.raises(ValueError, match="average"):
        merge_shards(parts)
    scored = [spark.createDataFrame([("a", 0.3)], "id string, score double"), spark.createDataFrame([("b", 0.9)], "id string, score double")]
    assert [r["id"] for r in merge_shards(scored, limit=1).collect()] == ["b"]
    assert order_of("select id from x order by id desc, text") == [("id", True), ("text", False)]
    assert shard_of("abc", 4) == shard_of("abc", 4) < 4


def test_complete_graph(spark):
    nodes = spark.range(5).select(F.col("id").alias("indexid"))
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(5) for b in range(a + 1, 5)], "src long, dst long, weight double")
    g = Graph(nodes, edges)
    assert g.count() == 5 and g.edge_count() == 10 and g.has_edge(3, 1) and not g.has_edge(7)
    assert {r["centrality"] for r in g.degree().collect()} == {1.0}
    assert all(abs(r["rank"] - 0.2) < 1e-9 for r in g.pagerank(5).collect())
    assert g.components().select("label").distinct().count() == 1
    assert g.louvain().select("label").distinct().count() == 1
    assert g.labels().count() == 5


def test_pagerank_shares_what_loose_nodes_hold(spark):
    nodes = spark.range(4).select(F.col("id").alias("indexid"))
    g = Graph(nodes, spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.0)], "src long, dst long, weight double"))
    m = np.array([[0, 2 / 3, 0, 0.25], [1, 0, 1, 0.25], [0, 1 / 3, 0, 0.25], [0, 0, 0, 0.25]])
    r = np.full(4, 0.25)
    for _ in range(6):
        r = 0.15 / 4 + 0.85 * m @ r
    assert np.allclose([x["rank"] for x in g.pagerank(6).orderBy("indexid").collect()], r)


def test_dense_search_in_parts_and_clusters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "indexid long, vector array<double>")
    queries = rows.where("indexid < 20").withColumnRenamed("indexid", "qid")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: set(np.argsort(-(u @ u[q]))[:5].tolist()) for q in range(20)}

    def sets(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["qid"], set()).add(r["indexid"])
        return out

    assert sets(dense.search(rows, queries, 5)) == want
    assert sets(dense.search(rows, queries, 5, most=300)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # several batches in a task
    assert sets(dense.search(rows.coalesce(1), queries, 5)) == want
    assert all(r["indexid"] != r["qid"] for r in dense.search(rows.coalesce(2), queries, 5, loops=False).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = sets(dense.probe(*dense.clusters(rows, 4), queries, 5, 4))
    assert np.mean([len(found[q] & want[q]) / 5 for q in range(20)]) >= 0.9


def test_fusion_with_all_weight_on_a_side(spark):
    d = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5)], "qid long, indexid long, score double")
    s = spark.createDataFrame([(0, 2, 0.8)], "qid long, indexid long, score double")
    got = {r["indexid"]: r["score"] for r in fusion.convex(d, s, 1.0).collect()}
    assert got[1] == 0.9 and got[2] == 0.5


def test_hashing_encoder_is_deterministic():
    import pandas as pd

    e = hashing_encoder()
    assert np.array_equal(e(pd.Series(["a b"])), e(pd.Series(["a b"])))


def test_upsert_into_one_row(spark):
    one = Content.of(spark.createDataFrame([(1, "a")], "id long, text string"), "id")
    both = one.upsert(Content.of(spark.createDataFrame([(2, "b")], "id long, text string"), "id"))
    assert sorted((r["indexid"], r["id"]) for r in both.sections.collect()) == [(0, "1"), (1, "2")]


def test_rows_without_an_id_stay_apart(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b"), (3, "c")], "id long, text string")
    c = Content.of(rows, "id")
    assert c.documents.count() == 3 and c.documents.where("id is null").count() == 0
    assert c.sections.select("id").distinct().count() == 3 and c.sections.count() == 4


def test_candidates_of_a_lone_similar(index):
    assert index.search("select count(*) as n from d where similar('bear')", 1).first()["n"] == 1
    assert index.search("select count(*) as n from d where similar('bear') and id > 0", 1).first()["n"] > 1


def test_literals_and_stars(index):
    row = index.sql("select id, 'c.score and o.object' as said, * from d where id = '2'").first()
    assert row["said"] == "c.score and o.object" and row.__fields__.count("id") == 1 and row["score"] is None
    assert index.sql("select distinct * from d").count() == 5


def test_types_of_paths(spark):
    rows = spark.createDataFrame([(i, "x", n, f"t{n}") for i, n in enumerate([9, 2, 100, 10])], "id long, text string, n int, s string")
    index = Index.of(rows, "id", Settings(keyword=False))
    assert tuple(index.sql("select max(n) as a, min(n) as b, max(s) as c from d").first()) == (100, 2, "t9")
    assert [r["n"] for r in index.sql("select n from d order by n desc").collect()] == [100, 10, 9, 2]
    assert ids(index.sql("select id from d where n > id")) == ["0", "1", "2", "3"] and ids(index.sql("select id from d where n = 'no number' or n > text")) == []
    assert index.sql("select count(*) as n from d where entry >= date('now', '-1 day')").first()["n"] == 4


def test_cells_of_an_index(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "id long, text string, v array<double>")
    index = Index.of(rows, "id", Settings(keyword=False), vector="v")
    q = [rows.first()["v"]]
    near = [r.indexid for r in index.clustered(8, 8).nearest(q, 5).orderBy(F.desc("score")).collect()]
    assert near == [r.indexid for r in index.nearest(q, 5).orderBy(F.desc("score")).collect()]
    assert index.clustered().settings.probes >= 4


def test_translated_queries(index):
    asked = replace(index, translator=lambda q: f"select id from d where similar('{q}', 1, 0.0) and id > 2")
    assert ids(asked.search("lottery")) in (["3"], ["4"]) and asked.search("select id from d").count() == 3


def test_rows_without_text_where_nothing_is_indexed(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "two", 6)], "id long, text string, n int")
    assert [tuple(r) for r in Index.of(rows, "id", Settings(keyword=False)).sql("select id, text, n from d order by id").collect()] == [("1", "1", 5), ("2", "two", 6)]
    assert Index.of(rows, "id").count() == 1


def test_archive(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    archive.archive(spark, str(tmp_path / "i"), str(tmp_path / "i.zip"))
    archive.extract(spark, str(tmp_path / "i.zip"), str(tmp_path / "j"))
    assert Index.load(spark, str(tmp_path / "j")).search("bear attack", 1).first()["id"] == "2"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out", "x")
    with pytest.raises(ValueError, match="leads out"):
        archive.extract(spark, str(tmp_path / "bad.zip"), str(tmp_path / "k"))


def test_graphs_as_lines_and_in_a_database(spark, index, tmp_path):
    g = index.with_graph(2, -1.0).graph
    nodes, edges = sorted(map(tuple, g.nodes.collect())), sorted(map(tuple, g.edges.collect()))
    back = Graph.from_json_lines(g.json_lines())
    assert sorted(map(tuple, back.nodes.collect())) == nodes and [x[:2] for x in sorted(map(tuple, back.edges.collect()))] == [x[:2] for x in edges]
    url, kinds = f"jdbc:derby:{tmp_path}/g;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    g.save_jdbc(url, kinds)
    back = Graph.load_jdbc(spark, url, kinds)
    assert sorted(map(tuple, back.nodes.collect())) == nodes and sorted(map(tuple, back.edges.collect())) == edges
