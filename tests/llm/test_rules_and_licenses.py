"""URL rules against counting all item sets; license notices against planted ones."""

from __future__ import annotations

import itertools
import math
import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from corvane.llm import license_scan, url_rules


def test_items(spark):
    rows = [("https://User@Shop.Example.com:80/Buy-now/42?ref=x&q#top",), ("",), (None,), ("mailto",)]
    got = [r[0] for r in spark.createDataFrame(rows, "url string").select(url_rules.items(F.col("url"))).collect()]
    assert got[0] == sorted(["s:https", "d:shop.example.com", "h:shop", "h:example", "h:com", "p:buy", "p:now", "p:42", "q:ref", "q:q"])
    assert got[1] == [] and got[2] == []


def plain_items(url):
    """Items of the simple URLs of these tests."""
    u = urlsplit(url)
    return frozenset([f"s:{u.scheme}", f"d:{u.netloc}", *(f"h:{x}" for x in u.netloc.split(".")), *(f"p:{x}" for x in u.path.split("/") if x)])


def brute_rules(baskets):
    """Every rule by counting every item set."""
    total, wrong = len(baskets), sum(b for _, b in baskets)
    counts = {}
    for s, b in baskets:
        for n in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), n):
                x = counts.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += b
    least, z = max(url_rules.SUPPORT * total, url_rules.LEAST), 1.64
    passing = {}
    for s, (n, b) in counts.items():
        p = b / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if b >= least and n < total and p >= url_rules.CONFIDENCE and low > wrong / total:
            passing[s] = p
    parts = lambda s: (c for n in range(1, len(s)) for c in itertools.combinations(s, n))
    everywhere = {s[0] for s, (n, _) in counts.items() if len(s) == 1 and n == total}
    return sorted((s, counts[s][1], p) for s, p in passing.items() if not everywhere & set(s) and not any(passing.get(c, -1) >= p for c in parts(s)))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        host, words = rng.choice(["a", "b", "c"]), rng.sample(["win", "cash", "news", "blog", "cat", "dog", "7"], 3)
        bad = host == "a" and "cash" in words or "win" in words and rng.random() < 0.9 or {"7", "news", "dog"} <= set(words) and host == "b" and rng.random() < 0.8 or rng.random() < 0.02
        if rng.random() < 0.08:
            words, bad = ["only", "together", *words], rng.random() < 0.7
        rows.append((i, f"http://{host}.org/{'/'.join(words)}"))
        labels.append((i, int(not bad), 0))
    labels += [(None, 0, 0), (5, None, None), (10_000, 0, 1)]
    extra = [(1000, None), (1001, ""), (None, "http://a.org/cash/dog"), (0, rows[0][1]), (1002, "http://b.org/" + "/".join(f"x{i}" for i in range(20_000)) + "/win")]
    return spark.createDataFrame([(*r, "z") for r in rows + extra], "page_id long, url string, hit string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows + extra, labels


@pytest.mark.parametrize(("most", "width"), [(100_000, 16), (0, 5), (100_000, 2)])
def test_rules_as_by_counting_all_sets(spark, labelled, most, width, monkeypatch):
    monkeypatch.setattr(url_rules, "WIDTH", width)
    pages, labels, rows, marks = labelled
    found = url_rules.mine(pages, labels)
    bad = {}
    for i, q, t in marks:
        if i is not None and not (q is None and t is None):
            bad[i] = max(bad.get(i, 0), int(q == 0 or t == 1))
    rules = sorted(url_rules.listed(found))
    want = brute_rules([(plain_items(u), bad[i]) for i, u in rows if i in bad and u])
    assert rules == want and max(len(r[0]) for r in rules) >= 3
    out = {(r.page_id, r.url): r for r in url_rules.judge(pages, found, most=most).collect()}
    assert len(out) == len({x for x in rows})
    for (_, u), r in out.items():
        fitting = sorted((-c, -b, len(s), s) for s, b, c in rules if u and set(s) <= plain_items(u))
        assert r.rejected == bool(fitting)
        assert (r.confidence, r.rule) == ((-fitting[0][0], " ".join(fitting[0][3])) if fitting else (None, None))
    assert not out[1000, None].rejected and not out[1001, ""].rejected and out[None, "http://a.org/cash/dog"].rejected and out[rows[-1]].rejected


def test_long_urls_of_many_copies_are_mined_in_time(spark):
    url = "http://long.example/" + "/".join(f"w{i}" for i in range(200))
    rows = [(i, url) for i in range(40)] + [(i, f"http://other.example/w{i}/x") for i in range(40, 120)]
    labels = [(i, int(i % 4 == 0), 0) for i in range(40)] + [(i, 1, 0) for i in range(40, 120)]
    rules = url_rules.mine(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r[2] for r in url_rules.listed(rules)} == {30 / 40, 30 / 41}  # of all its items, and of each that another page has


def test_no_labels_no_rules(spark, labelled):
    pages, labels, *_ = labelled
    none = spark.createDataFrame([], url_rules._RULES)
    assert url_rules.mine(pages, labels.where("false")).count() == 0
    assert url_rules.mine(pages.where("false"), labels).count() == 0
    assert url_rules.judge(pages, none).where("rejected").count() == 0
    assert url_rules.judge(pages.where("false"), none).count() == 0


def test_notices(docs_of):
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(n))
    mit = license_scan.TEMPLATES[2][1]
    words = mit.split()
    edited = " ".join(words[:20] + ["really"] + words[20:60] + words[61:])
    rows = [
        (1, f"{filler(30)} {mit} {filler(10)}"), (2, f"{filler(5)} {edited}"), (3, filler(200)), (4, f"x {license_scan.TEMPLATES[3][1]} {filler(9)} released under the MIT license"), (5, "Licensed under CC BY-NC 4.0."),
        (6, None), (7, ""), (None, "Licensed under CC BY 4.0."), (8, "licensed under the"), (5, "Licensed under CC BY-NC 4.0."), (9, filler(60_000) + " Licensed under CC BY 4.0."),
    ]
    found = sorted(((r.doc_id, r.license, r.start) for r in license_scan.scan(docs_of(rows)).collect()), key=repr)
    assert found == sorted([(1, "MIT", 30), (2, "MIT", 5), (4, "Apache-2.0", 1), (4, "MIT", 18), (5, "CC-BY-NC-4.0", 0), (5, "CC-BY-NC-4.0", 0), (None, "CC-BY-4.0", 0), (9, "CC-BY-4.0", 60_000)], key=repr)
    assert license_scan.scan(docs_of([])).count() == 0


def test_exact_notices_over_the_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    found = {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    for name, text in license_scan.TEMPLATES:
        for r in docs.where(F.contains(F.lower("text"), F.lit(text.lower().rstrip(".")))).select("doc_id").collect():
            assert any(i == r.doc_id and x.startswith(name.split("-")[0]) for i, x in found), (r.doc_id, name)


def test_short_templates_are_refused():
    with pytest.raises(ValueError, match="words"):
        license_scan._template_words([("X", "two words")])


def common(a, b):
    """The longest common subsequence of two lists of words."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + (x == y))
    return row[-1]


def test_spans_by_brute_force(spark, docs_of):
    """Every verbatim template is found where it stands, and every span has the words that it is said to have."""
    rng = random.Random(12)
    split = lambda t: [w for w in re.split(r"[^0-9a-z\u0080-\uffff]+", t.lower()) if w]
    filler = lambda n: ["".join(rng.choices("abcdefg", k=6)) for _ in range(n)]
    rows = []
    for i, (_, text) in enumerate(license_scan.TEMPLATES):
        rows.append((i, " ".join([*filler(rng.randrange(20)), text, *filler(5)])))
        words = text.split()
        rows.append((100 + i, " ".join([*filler(3), *(w for w in words if rng.random() > 0.05), *filler(3)])))
        rows.append((200 + i, " ".join([*filler(3), *words[: len(words) // 3], *filler(3)])))
    found = license_scan.scan(docs_of(rows, False)).collect()
    texts = dict(rows)
    for r in found:
        span = split(texts[r.doc_id])[r.start : r.start + r.n_words]
        assert max(common(span, split(t)) / len(split(t)) for n, t in license_scan.TEMPLATES if n == r.license) >= r.share - 1e-9
        assert r.share >= license_scan.LEAST_SHARE or common(span, max((split(t) for n, t in license_scan.TEMPLATES if n == r.license), key=len)) >= license_scan.LEAST_WORDS
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        start = next(p for p in range(20) if split(texts[i])[p : p + len(split(text))] == split(text))
        mine = [r for r in found if r.doc_id == i]
        assert any(r.start <= start and r.start + r.n_words >= start + len(split(text)) and (r.license.split("-")[0] == name.split("-")[0]) for r in mine), (name, text[:40], mine)
