"""Winnowing against a search of all shared spans."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from corvane.llm import decontaminate as d
from corvane.llm.words import words


def brute(docs, items):
    """Every maximal shared span of LEAST words or more."""
    out = []
    for i, t in docs:
        a = (t or "").lower().split()
        for j, u in items:
            b = (u or "").lower().split()
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= d.LEAST:
                            out.append((i, j, x, y, n))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh")
    items = [(j, " ".join(word() for _ in range(rng.choice([5, 20, 60])))) for j in range(8)] + [(98, None), (99, ""), (0, "repeated " * 15)]
    docs = []
    for i in range(30):
        w = [word() for _ in range(rng.choice([3, 60]))]
        for _ in range(rng.choice([0, 1, 2])):
            src = (rng.choice(items)[1] or "").split()
            at, n = rng.randrange(max(1, len(src) // 2)), rng.choice([8, 12, 13, 14, 30])
            here = rng.randrange(len(w))
            w[here:here] = src[at : at + n]
        docs.append((i, " ".join(w)))
    docs += [(40, None), (41, ""), (None, docs[3][1]), (3, docs[3][1]), (42, "Repeated, " * 20)]
    return docs, items


@pytest.mark.parametrize("sieve", [29, 8])
def test_spans_as_by_brute_force(spark, docs_of, case, sieve, monkeypatch):
    monkeypatch.setattr(d, "SIEVE", sieve)
    docs, items = case
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    found = sorted((tuple(r) for r in d.contaminated_spans(docs_of(docs), bench).collect()), key=repr)
    want = brute([(i, t and t.replace(",", "")) for i, t in docs], items)
    assert len(want) > 10
    assert found == want


def test_dropping_keeps_clean_rows_and_columns(spark, docs_of, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs_of(docs)
    out = d.drop_contaminated(rows, bench)
    assert out.columns == rows.columns
    bad = {t for t in {t for _, t in docs} if t and brute([(0, t.replace(",", ""))], items)}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(((i, t) for i, t in docs if t not in bad), key=repr)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "item_id long, text string")
    assert d.contaminated_spans(docs_of([]), some).count() == 0
    assert d.contaminated_spans(docs_of([(1, "a b c " * 10)]), none).count() == 0
    assert d.drop_contaminated(docs_of([(1, "a b c " * 10)]), none).count() == 1


def test_every_shared_span_has_a_common_fingerprint():
    rng = random.Random(9)
    for _ in range(50):
        shared = [str(rng.randrange(1000)) for _ in range(d.LEAST)]
        pad = lambda: [str(rng.randrange(1000, 2000)) for _ in range(rng.randrange(30))]
        prints = []
        for _ in range(2):
            w = words(pa.array([" ".join(pad() + shared + pad())]))
            prints.append(set(d.fingerprints(w.hash, w.offsets)[1].tolist()))
        assert prints[0] & prints[1]


def test_long_text(spark, docs_of):
    bench = spark.createDataFrame([(1, " ".join(map(str, range(30))))], "item_id long, text string")
    text = "filler words " * 300_000 + " ".join(map(str, range(10, 30)))
    assert [tuple(r) for r in d.contaminated_spans(docs_of([(1, text)]), bench).collect()] == [(1, 1, 600_000, 10, 20)]


def test_every_shared_span_has_one_at_the_same_place():
    rng = random.Random(10)
    for _ in range(200):
        shared = [rng.choice("ab") for _ in range(d.LEAST)]  # many ties
        pads, found = [], []
        for _ in range(2):
            pad = [rng.choice("abc") for _ in range(rng.randrange(20))]
            w = words(pa.array([" ".join(pad + shared + ["z"])]))
            at, h = d.fingerprints(w.hash, w.offsets)
            found.append({(int(a) - len(pad), int(x)) for a, x in zip(at, h) if 0 <= a - len(pad) <= d.LEAST - d.K})
        assert found[0] & found[1]


def test_repetitive_texts_cost_the_sum_of_their_lengths(spark, docs_of):
    import time

    for period in (1, 2, 7):
        phrase = [f"w{i}" for i in range(period)]
        text = lambda n: " ".join((phrase * n)[:n])  # noqa: E731, B023
        a, b = words(pa.array([text(12_000)])), words(pa.array([text(1_500)]))
        began = time.perf_counter()
        found = d.spans(a.hash, a.offsets, d.test_set(b.hash, b.offsets))
        assert time.perf_counter() - began < 5
        assert len(found) == len({(x[2], x[3]) for x in found})
        small = brute([(0, text(60))], [(0, text(40))])
        a, b = words(pa.array([text(60)])), words(pa.array([text(40)]))
        assert sorted(d.spans(a.hash, a.offsets, d.test_set(b.hash, b.offsets))) == sorted(small)
