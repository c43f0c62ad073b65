"""Tokenizers, segments and Markdown against literal results."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from corvane.functions import markdown, segment, tokenize
from corvane.operators import scoring
from corvane.plans import catalogue_text
from corvane.sources.content import uuid5


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "f", "want"), [
    ("Y this is a test!", tokenize.alphanum, ["test"]),
    ("abc123 ABC 123", tokenize.alphanum, ["abc123", "abc"]),
    ("A 1 a-b, (x.y) the", lambda t: tokenize.alphanum(t, False), ["a-b", "x.y", "the"]),
    ("Ünder x-ray", tokenize.alphanum, ["x-ray"]),
    ("abc123 ABC 123", tokenize.unicode_words, ["abc123", "abc", "123"]),
    ("don't 3.14 über", tokenize.unicode_words, ["don't", "3.14", "über"]),
    ("  Hello  World ", tokenize.whitespace, ["hello", "world"]),
    ("Hello World", lambda t: tokenize.whitespace(t, lowercase=False), ["Hello", "World"]),
    ("a1 b22", lambda t: tokenize.pattern(t, r"\d+"), ["1", "22"]),
    ("abcd", lambda t: tokenize.ngrams(t, 3), ["abc", "bcd"]),
    ("abcd ab", lambda t: tokenize.ngrams(t, 2, 3, edge=True), ["ab", "abc", "ab"]),
    ("abcd ab", lambda t: tokenize.ngrams(t, 2, 3, edge=True, unique=True), ["ab", "abc"]),
    ("ab", lambda t: tokenize.ngrams(t, 3, lpad=" ", rpad=" "), [" ab", "ab "]),
    ("", tokenize.alphanum, []),
    (None, tokenize.alphanum, None),
    (None, tokenize.unicode_words, None),
])
def test_tokens(spark, text, f, want):
    assert one(spark, text, f) == want


@pytest.mark.parametrize(("text", "by", "want"), [
    ("one\ntwo\n\n three  four ", "lines", ["one", "two", "three four"]),
    ("one\r\ntwo\r\nthree", "lines", ["one", "two", "three"]),
    ("one\ntwo\n\nthree", "paragraphs", ["one two", "three"]),
    ("one\r\n\r\ntwo", "paragraphs", ["one", "two"]),
    ("one\n\n\ntwo\fthree", "sections", ["one", "two", "three"]),
    ("This is one. And two! Three?", "sentences", ["This is one.", "And two!", "Three?"]),
    ("", "lines", []),
])
def test_segments(spark, text, by, want):
    assert one(spark, text, lambda t: segment.segments(t, by)) == want


def test_segment_options(spark):
    assert one(spark, "a\nlong one", lambda t: segment.segments(t, "lines", minlength=3)) == ["long one"]
    assert one(spark, "a\nb", lambda t: segment.segments(t, "lines", join=True)) == "a b"


def test_markdown(spark):
    page = """<html><head><title>T</title><style>x</style></head><body><h2>Head</h2><p>Some <b>bold</b> and <a href="/u">link</a>.</p>
    <ul><li>one</li><li>two</li></ul><blockquote>said</blockquote><pre><code>x = 1</code></pre>
    <table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><script>bad()</script></body></html>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    out = {r["page_id"]: r["m"] for r in rows.select("page_id", markdown.markdown(F.col("html")).alias("m")).collect()}
    for part in ("**T**", "## Head", "**bold**", "[link](/u)", "- one", "> said", "```", "|---"):
        assert part in out[1], part
    assert "bad" not in out[1] and not re.search("x</style", out[1])
    assert out[2] is None


def test_ids_by_name_as_the_standard_library_makes_them(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/part.parquet").collect()
    found = {r.p_partkey: r.id for r in catalogue_text.auto_uuid5(spark, tiny).collect()}
    assert found == {r.p_partkey: str(uuid.uuid5(uuid.NAMESPACE_DNS, r.p_name)) for r in rows}
    odd = ["", "é漢", "x" * 1000]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(uuid5(F.col("t"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for t in odd]


def test_windows_of_words(spark):
    cut = lambda t, n, o: one(spark, t, lambda c: segment.chunks(c, n, o))
    assert cut("a b c d e", 2, 0) == ["a b", "c d", "e"] and cut("a b c d e", 3, 1) == ["a b c", "c d e"] and cut(" a ", 3, 2) == ["a"]
    assert cut("", 3, 0) == [] and cut(None, 3, 0) is None
    with pytest.raises(ValueError, match="overlap"):
        segment.chunks(F.col("t"), 3, 3)


def test_terms_index(spark, tmp_path):
    rows = spark.createDataFrame([(0, "red apple apple"), (1, "red pear"), (2, "red red plum"), (3, None), (4, "")], "id long, text string")
    plain = scoring.Terms.of(rows, "id", "text")
    ask = lambda t, **k: [(r.qid, r.indexid, round(r.score, 9)) for r in t.search(["red pear", "ap*", "none"], 5, **k).orderBy("qid", F.desc("score"), "indexid").collect()]
    want = ask(plain)
    assert [x[:2] for x in want] == [(0, 1), (0, 2), (0, 0), (1, 0)]
    assert ask(plain.build()) == want
    plain.build(str(tmp_path / "t"))
    assert ask(scoring.Terms.load(spark, str(tmp_path / "t"))) == want
    assert [x[:2] for x in ask(plain, cutoff=0.5)] == [(0, 1), (1, 0)]  # red is in most documents
    assert plain.build().corpus().first() == plain.corpus().first()
    assert scoring.Terms.of(rows.where("false"), "id", "text").search(["red"], 5).count() == 0


def test_unicode_words_are_python_objects_for_a_part_of_a_batch_only():
    import tracemalloc

    import pyarrow as pa

    texts = ["ab cd ef " * 3000, None, "", *(["ghi jk " * 3000] * 200)]
    tracemalloc.start()
    found = tokenize._found(pa.array(texts), str.split)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [None if t is None else t.split() for t in texts]
    assert most < 40 << 20  # all words of the batch at once are more than 60 MB
    assert tokenize._found(pa.array([], pa.string()), str.split).to_pylist() == []


def test_ngrams_of_characters_beyond_the_basic_plane(spark):
    rows = spark.createDataFrame([("\U00020000\U00020001bc d ef", None), (None, None)], "t string, x string")
    got = [r.g for r in rows.select(tokenize.ngrams(F.col("t"), 2, 3).alias("g")).collect()]
    assert got == [["\U00020000\U00020001", "\U00020001b", "bc", "\U00020000\U00020001b", "\U00020001bc", "ef"], None]


def test_only_terms_of_topics_leave_the_pass_over_texts(spark):
    from corvane.operators import topics

    rows = [("a", 1, "red blue red"), ("a", 2, "red green"), ("b", 3, "green blue"), ("b", 4, None), ("b", 4, "green"), (None, 5, "red")]
    groups = spark.createDataFrame(rows, "grp string, indexid long, text string")
    named = spark.createDataFrame([("a", ["red"]), ("b", ["green", "blue"])], "grp string, terms array<string>")
    found = {(r.grp, r.indexid, r.term): (r.dl, r.tf, r.df, r.n, r.avgdl) for r in topics.term_statistics(groups, named).collect()}
    assert found == {("a", 1, "red"): (3, 2, 2, 2, 2.5), ("a", 2, "red"): (2, 1, 2, 2, 2.5), ("b", 3, "green"): (2, 1, 2, 2, 1.5), ("b", 3, "blue"): (2, 1, 1, 2, 1.5), ("b", 4, "green"): (1, 1, 2, 2, 1.5)}


def test_summary_of_ngrams_as_of_the_grams(spark):
    texts = ["The cat, the catalogue; the CAT.", "ab", "", None, "\U00020000\U00020001bc d efg é́x \uffffzz", "x1_y2 x1_y2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokenize.ngrams(F.col("t"), 3, 4).alias("g"), tokenize.ngram_summary(F.col("t"), 3, 4).alias("s"))
    for r in rows.collect():
        assert (r.s is None) == (r.g is None) and (r.s is None or tuple(r.s) == (len(r.g), len(set(r.g)), min(r.g, default=None), max(r.g, default=None)))


def test_query_of_ngrams_makes_no_array_of_grams(spark, tiny):
    assert "substring" not in catalogue_text.tokenize_ngrams(spark, tiny)._jdf.queryExecution().analyzed().toString()
