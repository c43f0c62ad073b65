"""The registered queries and the pipeline over a whole small table."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from compare import differences, duck

import corpus_pipeline
from corvane.llm import bpe, decontaminate, near_dedup, quality, queries
from corvane.llm.words import WORD_SEPARATOR

NAMES = [f.__name__ for f in queries.queries().values()]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, tiny, name):
    found = queries.queries()[name](spark, tiny).toArrow()
    assert differences(found, duck(tiny).execute(queries.oracle_sql()[name]).to_arrow_table()) == []


@pytest.mark.parametrize(("name", "table", "key"), [("op1_html_extraction", "pages", "page_id"), ("op4_bpe", "documents", "doc_id"), ("op6_pii_surrogates", "documents", "doc_id"), ("op8_url_rules", "pages", "page_id"), ("op10_quality_classifier", "documents", "doc_id")])
def test_a_row_for_each_row(spark, tiny, name, table, key):
    ids = sorted(r[0] for r in spark.read.parquet(f"{tiny}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in queries.queries()[name](spark, tiny).select(key).collect()) == ids


def plain_words(text):
    return [w for w in re.split(WORD_SEPARATOR.replace("x{a0}", "xa0").replace("x{bf}", "xbf").replace("x{", "u").replace("}", ""), (text or "").lower()) if w]


def least(pairs, items):
    root = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def near_brute(rows):
    """Groups by the exact Jaccard similarity of all pairs."""
    sets = []
    for i, t in rows:
        w = plain_words(t)
        sets.append((i, {tuple(w[j : j + near_dedup.SHINGLE]) for j in range(len(w) - near_dedup.SHINGLE + 1)} or ({tuple(w)} if w else set())))
    pairs = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and len(a & b) >= near_dedup.THRESHOLD * len(a | b)]
    return least(pairs, [i for i, _ in rows])


def test_near_query_as_all_pairs(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: r for i, r in near_brute(rows).items() if i != r}
    found = {r.doc_id: r.duplicate_of for r in queries.op2_minhash_near_dedup(spark, tiny).collect()}
    assert found.items() <= want.items()
    assert len(found) >= 0.97 * len(want)


def test_pipeline_as_by_brute_force(spark, tiny):
    docs, labels, bench = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    x, y = quality.labelled_features(docs, labels, "doc_id", "text", "quality", 12_000)
    forest = quality.fit(x, y > 0)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    good = quality.features(pa.array([t for _, t in rows]))
    rows = [r for r, p in zip(rows, forest.probability(good)) if p >= quality.THRESHOLD]
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    rows = [(i, t) for i, t in rows if t is None or first[t] == i]
    root = near_brute(rows)
    rows = [(i, t) for i, t in rows if root[i] == i]
    items = [b.text for b in bench.collect()]
    tests = {tuple(w[i : i + decontaminate.LEAST]) for w in map(plain_words, items) for i in range(len(w) - decontaminate.LEAST + 1)}
    rows = [(i, t) for i, t in rows if not any(tuple((w := plain_words(t))[j : j + decontaminate.LEAST]) in tests for j in range(len(plain_words(t)) - decontaminate.LEAST + 1))]
    with open(bpe.VOCABULARY, "rb") as f:
        coder = bpe.encoding(f.read())
    found = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, tiny).collect()}
    assert found == {i: coder.encode_ordinary(t) for i, t in rows}


def test_stages_keep_columns_and_take_awkward_rows(spark, tiny, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "null id"), (3, "a b c"), (3, "a b c"), (4, "w " * 100_000)])
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, tiny)
        assert out.columns == docs.columns
        assert f(spark, docs.where("false"), tiny).count() == 0
        out.count()
    assert len(corpus_pipeline.STAGES) == 5
