"""The best rows found in blocks, against the scores of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dense, nearest
from corvane.plans import catalogue_search


def packed(x):
    return [np.concatenate([np.flatnonzero(v), v[v != 0]]) for v in x]


def values(kind, rng):
    x = rng.normal(size=(700, 20))
    x[600:] = x[:100]  # copies tie with what they copy
    x[5] = 0
    if kind == "cosine":
        return nearest.COSINE, list(x)
    if kind == "hamming":
        return nearest.hamming(64), list(rng.integers(0, 1 << 32, (700, 2)) >> rng.integers(20, 32, (700, 2)))
    if kind == "late":
        return nearest.MAX_SIM, list(x.reshape(700, 5, 4))
    if kind == "ragged":
        return nearest.MAX_SIM, [v.reshape(5, 4)[: 1 + i % 5] for i, v in enumerate(x)]
    if kind == "sparse":
        return nearest.SPARSE, packed(np.where(x > 0.5, x, 0.0))
    if kind == "signed":  # sums that are zero or less, over common dimensions
        return nearest.SPARSE, packed(np.where(np.abs(x) > 1, np.round(x), 0.0))
    wide = np.zeros((700, 5000))
    wide[np.arange(700)[:, None], rng.integers(0, 5000, (700, 40)) // rng.integers(1, 200, (700, 40))] = 1 + rng.random((700, 40))
    return nearest.SPARSE, packed(wide)


@pytest.mark.parametrize("loops", [True, False])
@pytest.mark.parametrize("kind", ["cosine", "hamming", "late", "ragged", "sparse", "signed", "wide"])
def test_best_in_blocks_as_by_all_pairs(monkeypatch, kind, loops):
    monkeypatch.setattr(nearest, "QUERIES", 90)
    monkeypatch.setattr(nearest, "ROWS", 130)
    monkeypatch.setattr(nearest, "_PAIRS", 50)
    measure, rows = values(kind, np.random.default_rng(2))
    if kind in ("sparse", "signed", "wide"):
        assert any(len(v) == 0 for v in rows) == (kind != "wide")
        rows = [v for v in rows if len(v)]
    n = len(rows)
    x, ids = measure.lay(rows), np.arange(n) * 3
    best = nearest.Best(x, ids, 4, loops, measure)
    for part in (slice(n // 2, n), slice(0, n // 2)):  # greater ids first
        best.meet(x[part], ids[part])
    s = measure.score(x, x)
    if not loops:
        np.fill_diagonal(s, -np.inf)
    want = []
    for i in range(n):
        order = np.lexsort((ids, -np.round(s[i], 9)))[:4]
        want += [(i * 3, int(ids[j])) for j in order if np.isfinite(s[i, j])]
    found = best.frame()
    assert list(zip(found.qid.tolist(), found.indexid.tolist())) == want
    assert np.allclose(found.score, [s[a // 3, b // 3] for a, b in want], atol=1e-12)


def test_sparse_scores_as_by_hand():
    q, x = (nearest.SPARSE.lay(v) for v in ([[1, 2, 2, 0.5, 1, 1]], [[2, 5, 3, 9], [4, 1], [1, 2, 2, -1]]))
    assert nearest.SPARSE.score(q, x).tolist() == [[6.0, -np.inf, -1.0]]


def test_search_of_all_rows_for_all_rows(spark):
    """In several parts, with copies, nulls and vectors of two lengths, which only match their like."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(1300, 6)), 1)
    rows = [(i, None if i % 100 == 9 else v[:4].tolist() if i % 100 == 7 else v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "indexid long, vector array<double>")
    found = {}
    for r in dense.search(table, table.withColumnRenamed("indexid", "qid"), 3, loops=False, most=20_000).collect():
        found.setdefault(r.qid, []).append((round(r.score, 9), r.indexid))
    for length in (4, 6):
        ids = np.array([i for i, v in rows if v is not None and len(v) == length])
        unit = nearest.unit(x[ids, :length])
        s = np.round(unit @ unit.T, 9)
        np.fill_diagonal(s, -np.inf)
        for i, q in enumerate(ids):
            want = [int(ids[j]) for j in np.lexsort((ids, -s[i]))[:3]]
            assert [b for _, b in sorted(found.pop(int(q)), key=lambda p: (-p[0], p[1]))] == want
    assert not found


def test_parts_of_the_corpus_are_held_one_at_a_time(spark):
    table = spark.range(1200).select(F.col("id").alias("indexid"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("vector"))
    queries = table.withColumnRenamed("indexid", "qid")
    one, many = (dense.search(table, queries, 4, most=m) for m in (64 << 20, 4000))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("MapInPandas") == 1  # each task sends the best of all parts, not of each
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_sparse_pairs_are_never_rows(spark, tiny):
    """Neither the search of all rows nor that of some makes a row for each pair, or for each of its dimensions."""
    for name in ("sparse_topk", "sparse_normalized"):
        plan = getattr(catalogue_search, name)(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        assert "dim" not in plan.split("MapInPandas")[0] and "MapInPandas" in plan


def test_sparse_queries_are_sent_to_the_rows(spark, tiny):
    """A few queries meet the rows where these are: what is shuffled are the vectors, once each."""
    from corvane.operators.nearest import SPARSE

    rows = spark.range(3000).select(F.col("id").alias("indexid"), F.array(F.lit(1.0), F.lit(2.0), F.col("id") * 1.0, F.lit(1.0)).alias("vector"))
    plan = dense.search(rows, rows.where("indexid % 50 = 0").withColumnRenamed("indexid", "qid"), 3, measure=SPARSE)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("MapInPandas")[1].count("Exchange") == 0


def test_sparse_search_of_odd_rows(spark):
    """A dimension that comes twice counts as the sum; nulls match nothing; text dimensions are joined."""
    rows = [(0, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0), (1, 2, 4.0), (2, 3, 1.0), (3, 2, None), (4, None, 1.0), (5, 2, -1.0)]
    table = spark.createDataFrame(rows, "indexid long, dim int, value double")
    want = [(0, 0, 9.0), (0, 1, 3.0), (1, 1, 17.0), (1, 0, 3.0), (1, 5, -4.0), (2, 2, 1.0), (5, 5, 1.0), (5, 1, -4.0)]
    get = lambda t: sorted((r.qid, r.indexid, r.score) for r in dense.sparse_search(t, t.withColumnRenamed("indexid", "qid"), 5).collect() if r.score is not None)
    assert get(table) == sorted(want)
    assert get(table.where("value is not null").withColumn("dim", F.concat(F.lit("d"), "dim"))) == sorted(want)


def test_probing_holds_the_best_of_a_task_and_sends_them_once(spark):
    """However cells and batches cut the rows, a task sends no more than ``k`` rows for each query."""
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 8)))], "indexid long, vector array<double>").coalesce(1)
    celled, centres = dense.clusters(rows, 40)
    asked = rows.where("indexid % 50 = 0").withColumnRenamed("indexid", "qid")
    before = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = dense.probe(celled.coalesce(1), centres, asked, 5, 40)
        sent = found._jdf.queryExecution().analyzed()
        while "MapInPandas" != sent.nodeName():
            sent = sent.children().head()
        from pyspark.sql import DataFrame

        assert DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent), spark).count() == 40 * 5
        exact = {(r.qid, r.indexid) for r in dense.search(rows, asked, 5).collect()}
        assert {(r.qid, r.indexid) for r in found.collect()} == exact
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(before))


def test_centres_are_fitted_to_a_share_of_many_vectors(spark, monkeypatch):
    """The sample is spread, not gathered in one task."""
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(dense, "_FEW", 100)
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (seen.append(df), fit(self, df))[1])
    rng = np.random.default_rng(13)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 4)))], "indexid long, vector array<double>")
    celled, centres = dense.clusters(rows, 10, most=1000)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and 500 < seen[0].count() <= 1000 and seen[0].rdd.getNumPartitions() > 1
    assert len(centres) == 10 and celled.count() == 3000


def test_sparse_vectors_are_not_taken_apart(spark, tiny, monkeypatch):
    """No row for each dimension is made, shuffled and put together again, and no table of them is written."""
    monkeypatch.setattr(dense, "stage", lambda *_: pytest.fail("a table is written"))
    for name in ("sparse_topk", "sparse_normalized"):
        plan = getattr(catalogue_search, name)(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "posexplode" not in plan and "MapInPandas" in plan


def test_positive_part(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0],), ([-1.0],), ([],), (None,), ([None, 3.0],)], "vector array<float>")
    assert [r[0] for r in rows.select(dense.positive_part()).collect()] == [[0.0, 3.0, 0.5, 2.0], [], [], None, [1.0, 3.0]]


def test_candidates_of_many_blocks_are_ranked_at_once(monkeypatch):
    """After the first blocks few rows are candidates: they wait for others, and queries without any are passed over."""
    monkeypatch.setattr(nearest, "ROWS", 100)
    ranked, looked, merge, pairs = [], [], nearest.Best._merge, nearest.COSINE.pairs
    monkeypatch.setattr(nearest.Best, "_merge", lambda self, *a: (ranked.append(1), merge(self, *a))[1])
    monkeypatch.setattr(nearest.COSINE, "pairs", lambda q, x, i, j: (looked.append(1), pairs(q, x, i, j))[1])
    x = nearest.unit(np.random.default_rng(4).normal(size=(20_000, 8)))
    x[7] = np.nan
    best = nearest.Best(x[:20], np.arange(20), 3, False, nearest.COSINE)
    best.meet(x, np.arange(len(x)))
    found = best.frame()
    assert len(ranked) < 40 and len(looked) < 160
    for i in (*range(7), *range(8, 20)):
        s = np.round(x @ x[i], 9)
        s[[i, 7]] = -np.inf
        assert found[found.qid == i].indexid.tolist() == np.lexsort((np.arange(len(x)), -s))[:3].tolist()
    assert 7 not in set(found.qid) | set(found.indexid)


def test_rows_of_a_task_are_final_unless_a_query_comes_again(spark):
    table = spark.range(1500).select(F.col("id").alias("indexid"), F.array(F.sin("id"), F.cos(F.col("id") * 2), F.sin(F.col("id") * 3)).alias("vector"))
    once = dense.search(table, table.withColumnRenamed("indexid", "qid"), 2)
    again = dense.search(table, table.unionByName(table.where("indexid < 9")).withColumnRenamed("indexid", "qid"), 2)
    windows = ["Window" in q._jdf.queryExecution().optimizedPlan().toString() for q in (once, again)]
    assert windows == [False, True]
    repeated = [r for r in again.collect() if r.qid < 9]
    assert len(repeated) == 18 and all(1 - r.score < 1e-9 for r in repeated if r.indexid == r.qid)
    assert sorted((r.qid, r.indexid) for r in once.collect() if r.qid > 8) == sorted((r.qid, r.indexid) for r in again.collect() if r.qid > 8)
