"""Exact and near duplicates against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import exact_dedup, near_dedup
from corvane.llm.components import components

AWKWARD = [(1, None), (2, None), (3, ""), (4, ""), (None, ""), (5, "same text"), (5, "same text"), (6, "same text"), (7, "other"), (None, "only null id"), (8, "x" * 300_000), (9, "x" * 300_000)]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        if t is not None:
            groups[t].append(i)
    out = []
    for i, t in rows:
        g = groups[t] if t is not None else [i]
        known = [x for x in g if x is not None]
        out.append((i, min(known) if known else None, len(g)))
    return sorted(out, key=repr)


@pytest.fixture(params=["filter", "shuffle"])
def way(request, monkeypatch):
    if request.param == "shuffle":
        f = exact_dedup.maybe_repeated
        monkeypatch.setattr(exact_dedup, "maybe_repeated", lambda docs, text="text": f(docs, text, most=-1))


def test_exact_copies(docs_of, way):
    found = exact_dedup.exact_copies(docs_of(AWKWARD)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == exact_brute(AWKWARD)


def test_drop_exact(docs_of, way):
    docs = docs_of(AWKWARD)
    out = exact_dedup.drop_exact(docs)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text and r.text[:9]) for r in out.collect()), key=repr)
    assert kept == sorted([(1, None), (2, None), (3, ""), (5, "same text"), (7, "other"), (None, "only null"), (8, "x" * 9)], key=repr)


def test_exact_empty(docs_of):
    assert exact_dedup.exact_copies(docs_of([])).count() == 0
    assert exact_dedup.drop_exact(docs_of([])).count() == 0


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    filled = np.zeros(exact_dedup._bits(len(h)) // 8, np.uint8)
    exact_dedup._add(filled, h)
    assert exact_dedup._has(filled, h).all()
    assert exact_dedup._has(filled, rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.02


def words_of(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def changed(rng, words, share):
    return [w if rng.random() > share else words_of(rng, 1)[0] for w in words]


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a or b else 0.0


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    rows, groups = [], {}
    for g in range(30):
        base = words_of(rng, rng.choice([100, 150, 600]))
        for _ in range(rng.choice([1, 2, 5, 40])):
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(changed(rng, base, rng.choice([0.0, 0.01, 0.03])))))
    return rows, groups


def test_near_groups_as_planted(docs_of, planted):
    rows, groups = planted
    found = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    least = {}
    for i, g in groups.items():
        least.setdefault(g, i)
    assert found == {i: least[g] for i, g in groups.items() if i != least[g]}


def test_near_recall_against_all_pairs(docs_of):
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        base = words_of(rng, 200)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed(rng, base, rng.uniform(0, 0.12))))]
    found = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    root = lambda i: found.get(i, i)
    close = [(a, b) for a, _ in rows for b, _ in rows if a < b and jaccard(rows[a][1], rows[b][1]) >= 0.55]
    assert len(close) > 30
    assert np.mean([root(a) == root(b) for a, b in close]) >= 0.9
    far = [(a, b) for a, _ in rows for b, _ in rows if a < b and jaccard(rows[a][1], rows[b][1]) < 0.3]
    assert not any(root(a) == root(b) for a, b in far)


def test_near_pairs_at_the_threshold_by_exact_jaccard(docs_of):
    rng = random.Random(13)
    rows, pairs = [], []
    for _ in range(500):
        base = words_of(rng, 200)
        other = changed(rng, base, rng.uniform(0.08, 0.15))
        if 0.43 <= (j := jaccard(" ".join(base), " ".join(other))) <= 0.56:
            pairs.append((len(rows), j))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    found = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(docs_of(rows, False)).collect()}
    near = [found.get(a + 1) == a for a, j in pairs if j >= 0.5]
    assert len(near) > 100 and np.mean(near) >= 0.93
    under = [a + 1 in found for a, j in pairs if j < 0.5]
    assert len(under) > 50 and not any(under)


def test_near_awkward(docs_of):
    rows = [(1, None), (2, ""), (3, ""), (4, "... !"), (5, "one two three four five"), (6, "One, two; three four FIVE!"), (6, "One, two; three four FIVE!"), (None, "one two three four five"), (7, "word"), (8, "word"), (9, "w " * 200_000)]
    docs = docs_of(rows)
    found = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {6: 5, 8: 7}
    out = near_dedup.drop_near(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 7, 9, None], key=repr)
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    for target in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(30):
            n = 3000
            shared = rng.integers(0, 1 << 63, int(2 * n * target / (1 + target)), dtype=np.uint64)
            sides = [np.r_[shared, rng.integers(0, 1 << 63, n - len(shared), dtype=np.uint64)] for _ in range(2)]
            s = near_dedup.odd_sketch(near_dedup.minhash(np.concatenate(sides), np.array([n, n])))
            errors.append(float(near_dedup.similarity(int(np.bitwise_count(s[0] ^ s[1]).sum()))) - target)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_link_is_single_linkage():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    rows = []
    for b in base:
        x = b.copy()
        for _ in range(5):  # a chain, each a few bits from the one before
            rows.append(x.copy())
            x = x ^ (np.uint64(0x15) << np.uint64(rng.integers(0, 50)))
    s = np.array(rows)[rng.permutation(len(rows))]
    near = np.bitwise_count(s[:, None] ^ s[None]).sum(2) <= 3

    def groups(edges):
        root = list(range(len(s)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            root[find(a)] = find(b)
        return [find(i) for i in range(len(s))]

    def sets(g):
        return {frozenset(i for i, x in enumerate(g) if x == y) for y in g}

    assert sets(groups(near_dedup.link(s, 3))) == sets(groups(zip(*np.nonzero(near))))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {x: r for x, r in root.items() if x != r}


def test_shingles_of_short_texts():
    _, counts = near_dedup.shingles(pa.array(["a b c d", "a b", "a", "", None]))
    assert counts.tolist() == [2, 1, 1, 0, 0]


def test_buckets_in_chunks_give_the_same_groups(spark, planted, monkeypatch):
    rows, _ = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = []
    for chunk in (near_dedup.CHUNK, 3):
        signed = near_dedup.stage(near_dedup.signatures(docs, "doc_id", "text"), "signed").withColumnRenamed("doc_id", "rep")
        found = near_dedup.near_edges(signed, near_dedup.THRESHOLD, chunk).where("sure").select("a", "b")
        groups.append({r.node: r.root for r in components(found).collect()})
    assert groups[0] == groups[1] and len(groups[0]) > 100


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_crowded_whatever_the_batches(size):
    rng = random.Random(size)
    buckets = sorted(rng.choice([1, 1, 1, 2, *range(10, 60)]) for _ in range(90))
    rows = [pa.RecordBatch.from_arrays([pa.array(buckets[i : i + size]), pa.array(list(range(i, min(90, i + size))))], ["bucket", "rep"]) for i in range(0, 90, size)]
    found = [x for b in near_dedup._crowded(iter(rows), 4) for x in zip(*(c.to_pylist() for c in b.columns))]
    want, seen = [], defaultdict(int)
    for i, b in enumerate(buckets):
        if buckets.count(b) > 1:
            want.append((b, i, seen[b] // 4))
        seen[b] += 1
    assert found == want


def test_unclear_crowds_are_settled_without_passing_on_their_pairs(spark, monkeypatch):
    """A crowd whose pairs are all about 0.55 alike, and one about 0.4: groups as by all pairs, and few edges."""
    rng = random.Random(21)
    rows = []
    for share in (0.095, 0.15):
        base = words_of(rng, 240)
        rows += [(len(rows) + i, " ".join(changed(rng, base, share / 2 + 0.01))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {i: i for i, _ in rows}
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.5]
    for _ in range(8):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert len(pairs) > 300
    for chunk in (near_dedup.SETTLED, 7):
        monkeypatch.setattr(near_dedup.settled, "__defaults__", (chunk,))
        found = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(docs).collect()}
        same = [found.get(i, i) == root[i] for i, _ in rows]
        assert np.mean(same) >= 0.97
    signed = near_dedup.stage(near_dedup.signatures(docs, "doc_id", "text"), "signed").withColumnRenamed("doc_id", "rep")
    edges = near_dedup.near_edges(signed, near_dedup.THRESHOLD)
    assert edges.count() <= 2 * near_dedup.BANDS * len(rows)


def test_joined_as_by_all_pairs():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(60)]
    root = rng.integers(0, 50, 60)
    sketches = np.zeros((60, 8), np.uint64)
    for side in (np.zeros(60, int), rng.integers(0, 2, 60)):
        want = {(u, v) for u in range(60) for v in range(60) if root[u] != root[v] and (side[u] != side[v] or not side.any()) and len(np.intersect1d(sets[u], sets[v])) >= 0.5 * len(np.union1d(sets[u], sets[v]))}
        groups = []
        for pairs in (want, near_dedup.joined(sketches, root, side, sets, 512, 0.5)):
            g = root.copy()
            for u, v in pairs:
                g[g == g[v]] = g[u]
            groups.append({frozenset(np.flatnonzero(g == x)) for x in g})
        assert groups[0] == groups[1]
