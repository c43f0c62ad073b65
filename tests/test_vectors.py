"""Vector functions and searches against plain numpy."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import dense, graph, retrieval
from corvane.plans import catalogue_search
from corvane.plans.registered import ORACLES


def vec(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").orderBy("vec_id").toPandas()
    return rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)


def test_pca_removed_as_by_numpy(spark, tiny):
    ids, x = vec(spark, tiny)
    found = catalogue_search.pca_removed(spark, tiny).orderBy("vec_id").toPandas()
    axis = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, -1]
    y = x - np.outer(x @ axis, axis)
    assert np.allclose(np.stack(found.vector), y / np.linalg.norm(y, axis=1, keepdims=True), atol=1e-6)


def test_explain_tokens_by_leaving_out_each(spark, tiny):
    encoder = V.hashing_encoder()
    q = encoder(pd.Series(["the of and"]))[0]
    found = {(r.indexid, r.pos): (r.token, r.score) for r in catalogue_search.explain_tokens(spark, tiny).collect()}
    want = {}
    for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect():
        words = r.text.split()
        whole = encoder(pd.Series([" ".join(words)]))[0] @ q
        for i, w in enumerate(words):
            rest = encoder(pd.Series([" ".join(words[:i] + words[i + 1 :])]))[0] @ q
            want[r.item_id, i] = w, whole - abs(rest)
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_quantise_with_nulls(spark, bits):
    rows = spark.createDataFrame([(0, [0.5, -0.5, 0.99, -1.0]), (1, None), (2, [0.0, 2.0, -2.0, 0.1])], "id int, v array<double>")
    got = {r.id: r.q for r in rows.select("id", V.quantise(F.col("v"), bits).alias("q")).collect()}
    assert got[1] is None
    half = 2 ** (bits - 1)
    for i, v in ((0, [0.5, -0.5, 0.99, -1.0]), (2, [0.0, 2.0, -2.0, 0.1])):
        level = [int(min(max(x * half, -half), half - 1) + half) for x in v]
        text = "".join(f"{n:0{bits}b}" for n in level)
        assert "".join(f"{b:08b}" for b in got[i])[: len(text)] == text


def test_nulls_and_odd_lengths_match_nothing(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, 0.0]), (0, [1.0, 0.0])], "indexid long, vector array<double>")
    found = dense.search(rows, dense.vectors(spark, [[1.0, 0.0]]), 5).orderBy(F.desc("score"), "indexid").collect()
    assert [(r.indexid, r.score) for r in found] == [(0, 1.0), (0, 1.0), (3, 0.0)]
    assert dense.search(rows.where("false"), dense.vectors(spark, [[1.0, 0.0]]), 5).count() == 0
    assert dense.search(rows, dense.vectors(spark, []), 5).count() == 0
    axes = np.array([[1.0, 0.0]])
    assert [r[0] for r in rows.where("vector is null or size(vector) = 2").select(V.remove_axes(F.col("vector"), axes)).collect()].count(None) == 1


def test_cells_find_most_and_hold_all(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 2
    x = np.concatenate([c + rng.normal(size=(40, 16)) for c in centres])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "indexid long, vector array<double>")
    celled, found = dense.clusters(rows, 30)
    assert celled.count() == len(x)
    asked = rows.where("indexid % 50 = 0").withColumnRenamed("indexid", "qid")
    exact = {(r.qid, r.indexid) for r in dense.search(rows, asked, 10).collect()}
    near = {(r.qid, r.indexid) for r in dense.probe(celled, found, asked, 10, 6).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)
    every = {(r.qid, r.indexid) for r in dense.probe(celled, found, asked, 10, 30).collect()}
    assert every == exact


@pytest.mark.parametrize("chunk", [20_000, 17])
def test_neighbours_of_all_rows_by_cells(spark, chunk):
    rng = np.random.default_rng(14)
    x = np.concatenate([c + 0.5 * rng.normal(size=(30, 8)) for c in rng.normal(size=(10, 8)) * 3])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "indexid long, vector array<double>")
    cells = dense.clusters(rows, 8)
    exact = {(r.qid, r.indexid) for r in dense.search(rows, rows.withColumnRenamed("indexid", "qid"), 5, loops=False).collect()}
    assert {(r.qid, r.indexid) for r in dense.neighbours(*cells, 5, 8, chunk).collect()} == exact
    near = {(r.qid, r.indexid) for r in dense.neighbours(*cells, 5, 3, chunk).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    some = {(r.src, r.dst) for r in graph.knn_edges(rows, 5, 0.1, cells, 8).collect()}
    assert some == {(r.src, r.dst) for r in graph.knn_edges(rows, 5, 0.1).collect()}


def test_muvera_keeps_the_order_of_late_interaction(spark):
    rng = np.random.default_rng(5)
    docs = [rng.normal(size=(4, 8)) for _ in range(30)]
    queries = [d + 0.1 * rng.normal(size=d.shape) for d in docs[:10]]
    encode = lambda ms, query: [r[1] for r in spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(ms)], "i int, m array<array<double>>").select("i", V.muvera(F.col("m"), 8, query=query)).orderBy("i").collect()]
    d, q = np.array(encode(docs, False)), np.array(encode(queries, True))
    assert ((q @ d.T).argmax(1) == np.arange(10)).mean() >= 0.9
    none = spark.createDataFrame([(None,)], "m array<array<double>>").select(V.muvera(F.col("m"), 8)).first()[0]
    assert none is None


@pytest.mark.parametrize("how", ["mean", "weighted", "max", "cls", "last"])
def test_pooling(spark, how):
    rng = np.random.default_rng(6)
    m, w = rng.normal(size=(5, 3)), rng.random(5)
    rows = spark.createDataFrame([(0, m.tolist(), w.tolist()), (1, None, None), (2, [], [])], "id int, m array<array<double>>, w array<double>")
    got = {r.id: r.p for r in rows.select("id", V.pool(F.col("m"), how, F.col("w")).alias("p")).collect()}
    want = {"mean": m.mean(0), "weighted": np.average(m, 0, w), "max": m.max(0), "cls": m[0], "last": m[-1]}[how]
    assert np.allclose(got[0], want) and got[1] is None and got[2] is None


def test_values_rounded_to_zero_keep_their_sign_as_in_sql(spark, tmp_path):
    v = [-1e-7, 1e-7, -0.0, 0.0, 1.0] + [0.0] * 59
    spark.createDataFrame([(0, v, 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalogue_search.truncate_normalize(spark, str(tmp_path)).first().vector
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(ORACLES["truncate_normalize"]).to_arrow_table().to_pylist()[0]["vector"]
    assert [*map(repr, found)] == [*map(repr, want)]


def test_context_and_labels(spark):
    rows = spark.createDataFrame([(0, 1, "alpha beta gamma", 0.9), (0, 2, "beta", 0.8), (0, 3, "alpha delta epsilon", 0.1)], "qid int, indexid long, text string, score double")
    assert [r.indexid for r in retrieval.context(rows, "+alpha", 3, minscore=0.5).collect()] == [1]


def test_recall_of_cells_over_the_table(spark, tiny):
    ids, x = vec(spark, tiny)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r.qid, r.vec_id) for r in catalogue_search.dense_cells(spark, tiny).collect()}
    want = {(int(ids[q]), int(ids[i])) for q in np.flatnonzero(ids % 50 == 0) for i in np.lexsort((ids, -np.round(x @ x[q], 9)))[:10]}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


def test_sparse_cells(spark):
    rng = np.random.default_rng(9)
    x = np.where(rng.random((200, 30)) < 0.2, rng.random((200, 30)), 0.0)
    x[7] = 0
    rows = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(200) for j in range(30) if x[i, j]], "indexid long, dim int, value double")
    celled, centres = dense.sparse_cells(rows, 8)
    assert celled.count() == rows.count()
    asked = rows.where("indexid % 50 = 0").withColumnRenamed("indexid", "qid")
    exact = {(r.qid, r.indexid) for r in dense.sparse_search(rows, asked, 5).collect()}
    assert {(r.qid, r.indexid) for r in dense.sparse_probe(celled, centres, asked, 5, 8).collect()} == exact
    some = {(r.qid, r.indexid) for r in dense.sparse_probe(celled, centres, asked, 5, 6).collect()}
    assert len(some & exact) >= 0.7 * len(exact)
    tops = celled.where("cell >= 0").groupBy("cell", "dim").agg(F.max("value").alias("value"))
    assert sorted(map(tuple, tops.collect())) == sorted(map(tuple, centres.collect()))
