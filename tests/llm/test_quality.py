"""The classifier: features, trees, held-out accuracy."""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa

from corvane.llm import gbdt, quality


def test_features_are_those_of_each_text_alone():
    texts = ["Hello, world! 12 HELLO", None, "", "a a a b", "x" * 5000, "ünï çodé 漢字", "\n\n| | $ #"]
    together = quality.features(pa.array(texts))
    for t, row in zip(texts, together):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], row)
    f = dict(zip(quality.FEATURES, together[3]))
    assert f["log_words"] == np.log1p(4) and f["distinct"] == 0.5 and f["top_word"] == 0.75 and f["echoes"] == 0.5
    assert not together[1].any() and not together[2].any()


def test_flat_trees_as_node_by_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    f = gbdt.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int), trees=12)
    for row, m in zip(x, f.margin(x)):
        total = f.base
        for feature, threshold, leaf in zip(f.feature, f.threshold, f.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + bool(row[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        assert np.isclose(total, m)
    assert ((f.probability(x) > 0.5) == (x[:, 0] + x[:, 1] * x[:, 2] > 0)).mean() > 0.95


def test_one_class_gives_the_prior():
    assert np.allclose(gbdt.fit(np.zeros((8, 2)), np.ones(8)).probability(np.zeros((1, 2))), 0.9)


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (rows.keep == (rows.quality == 1)).mean() > 0.95
    assert rows.keep[rows.quality == 1].mean() > 0.97


def test_awkward(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "word " * 100_000), (3, "again"), (3, "again")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (2, None, 0), (2, 0, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(docs, labels)
    out = quality.score(docs, forest).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    kept = quality.keep_good(docs, forest)
    assert kept.columns == docs.columns
    keeps = {(r.doc_id, round(r.score, 9)) for r in out if r.keep}
    assert kept.count() == sum(r.keep for r in out) and {r.doc_id for r in kept.collect()} == {i for i, _ in keeps}
    none = quality.train(docs_of([]), labels.where("false"))
    assert quality.score(docs_of([]), none).count() == 0
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_sample_bound(docs_of, spark):
    docs = docs_of([(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    x, y = quality.labelled_features(docs, labels, "doc_id", "text", "quality", 20)
    assert x.shape == (20, len(quality.FEATURES)) and len(y) == 20


def plain_features(text):
    """The features of one text, each by its definition."""
    out = dict.fromkeys(quality.FEATURES, 0.0)
    raw = (text or "").encode()
    if not raw:
        return out
    share = lambda test: sum(map(test, raw)) / len(raw)
    among = lambda chars: share(lambda b: b < 128 and chr(b) in chars)
    kinds = {"letters": string.ascii_letters, "upper": string.ascii_uppercase, "digits": string.digits, "spaces": " \t\r", "newlines": "\n", "stops": ".?;:", "commas": ",", "bangs": "!", "symbols": "#$%&*+=^~@<>\\/_", "bars": "|", "quotes": "\"'`()[]{}", "other_punct": "-"}
    out |= {k: among(v) for k, v in kinds.items()} | {"high": share(lambda b: b >= 128), "log_bytes": math.log1p(len(raw))}
    out["entropy"] = -sum(n / len(raw) * math.log(n / len(raw)) for n in Counter(raw).values())
    w = [x for x in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\xa0-\xbf\u2000-\u207f\u3000-\u303f]+", text.lower()) if x]
    out["log_words"] = math.log1p(len(w))
    if w:
        size = [len(x.encode()) for x in w]
        out |= {"word_length": np.mean(size), "word_length_sd": np.std(size), "long_words": np.mean([n > 12 for n in size]), "distinct": len(set(w)) / len(w), "top_word": max(Counter(w).values()) / len(w)}
        pairs = list(zip(w, w[1:]))
        out |= {"echoes": sum(a == b for a, b in pairs) / len(w), "distinct_pairs": len(set(pairs)) / max(len(pairs), 1)}
    return out


def test_query_by_brute_force(spark, tiny):
    """Every score over the table, from plain features and a walk down each tree."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs, labels)
    got = {r.doc_id: (r.score, r.keep) for r in quality.score(docs, forest).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(rows)
    batch = quality.features(pa.array(list(rows.values())))
    for (i, text), found in zip(rows.items(), batch):
        x = list(plain_features(text).values())
        assert np.allclose(x, found, atol=1e-9), (i, dict(zip(quality.FEATURES, zip(x, found))))
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + bool(found[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        assert np.isclose(got[i][0], 1 / (1 + math.exp(-total))) and got[i][1] == (got[i][0] >= quality.THRESHOLD)
