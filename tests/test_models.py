"""What comes before and after models, with plain functions as models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import models


def test_entities(spark):
    rows = spark.createDataFrame([(0, "Anna in Rome"), (1, None), (2, "none")], "n int, t string")
    model = lambda s: [[{"text": w, "label": "place" if w == "Rome" else "person", "score": 0.9 if w == "Rome" else 0.4} for w in t.split() if w[0].isupper()] for t in s]
    got = {r.n: None if r.e is None else [tuple(x) for x in r.e] for r in rows.select("n", models.entities(F.col("t"), model, least=0.5).alias("e")).collect()}
    assert got == {0: [("Rome", "place", 0.9)], 1: None, 2: []}
    assert rows.select(F.size(models.entities(F.col("t"), model, ["person"]))).first()[0] == 1


def test_summary_skips_short_texts(spark):
    rows = spark.createDataFrame([(0, "a b"), (1, "a b c d"), (2, None), (3, "")], "n int, t string")
    got = [r[0] for r in rows.orderBy("n").select(models.summary(F.col("t"), lambda s: s.str[:3], 3)).collect()]
    assert got == ["a b", "a b", None, ""]


def test_answers_under_the_limit_are_null(spark):
    rows = spark.createDataFrame([("who", "anna 0.9"), ("who", "bert 0.01"), (None, "x 1")], "q string, c string")
    model = lambda q, c: [(x.split()[0], float(x.split()[1])) for x in c]
    assert [r[0] for r in rows.select(models.answer(F.col("q"), F.col("c"), model)).collect()] == ["anna", None, None]


def test_translation_by_language(spark):
    rows = spark.createDataFrame([("de eins",), ("fr un",), ("en one",), ("xx y",), (None,)], "t string")
    detect = lambda s: s.str[:2]
    known = {"de": lambda s: s.str.upper(), "fr": lambda s: s + "!"}
    assert [r[0] for r in rows.select(models.translated(F.col("t"), detect, known)).collect()] == ["DE EINS", "fr un!", "en one", "xx y", None]


def test_similar(spark):
    rows = spark.createDataFrame([(0, "aab"), (1, "b"), (2, None)], "n int, t string")
    got = sorted((r.n, r.qid, r.score) for r in models.similar(rows, "t", ["a", "b"], lambda s, q: s.str.count(q).astype(float)).collect())
    assert got == [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 1.0)]


def test_labels_as_numbers(spark):
    rows = spark.createDataFrame([("x", "b"), ("y", "a"), ("z", None)], "t string, label string")
    found, names = models.labelled(rows)
    assert names == ["a", "b"] and [r.label_id for r in found.orderBy("t").collect()] == [1, 0, None]
