"""The SQL dialect: how names are resolved, and queries over dynamic columns."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import Row

from corvane.plans.dialect import Rewriter, SqlError, issql
from corvane.plans.engine import Index, IndexNotFoundError, ReadOnlyError, Settings

NOW = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([
        Row(id=0, text="US tops 5 million confirmed virus cases", a=1, flag=True, nested=Row(b=[Row(c="x")]), odd="p"),
        Row(id=1, text="Maine man wins one million from a lottery ticket", a=2, flag=False, nested=Row(b=[Row(c="y")]), odd="q"),
        Row(id=2, text="Park bear attack makes huge news", a=None, flag=True, nested=None, odd=None),
        Row(id=3, text=None, a=7, flag=None, nested=None, odd="r"),
    ], "id long, text string, a long, flag boolean, nested struct<b: array<struct<c: string>>>, odd string").withColumnRenamed("odd", "odd name")
    return Index.of(docs, "id", Settings(types={"a": "double"}), now=NOW)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_issql():
    assert issql("select a from x") and not issql("feel good story") and not issql("selected works")


@pytest.mark.parametrize(("query", "want"), [
    ("select id, a from docs where a > 1", [("1", 2.0)]),
    ("select id from docs where a is null", [("2",)]),
    ("select id from docs where flag = 1 order by id", [("0",), ("2",)]),
    ("select id, nested.b[0].c as c from docs where nested.b[0].c = 'y'", [("1", "y")]),
    ("select [odd name] as o from docs where [odd name] = 'p'", [("p",)]),
    ("select id from docs where a in (1, 2) and not (a = 2)", [("0",)]),
    ("select id from docs where a between 2 and 3 or text like '%bear%' order by id", [("1",), ("2",)]),
    ("select count(*) as n, sum(a) as s from docs", [(3, 3.0)]),
    ("select flag as f, count(*) as n from docs group by flag having count(*) > 1", [(True, 2)]),
    ("select id as x from docs where x = '2'", [("2",)]),
    ("select a * 2 + 1 as twice, 'n' || id as name from docs where id = 1", [(5.0, "n1")]),
    ("select id from docs order by id desc limit 1 offset 1", [("1",)]),
    ("select nothing from docs where id = 0", [(None,)]),
])
def test_queries(index, query, want):
    assert rows(index.sql(query)) == want


def test_unaliased_items_keep_their_text(index):
    assert index.sql("select count(*), a + 1 from docs group by a + 1").columns == ["count(*)", "a + 1"]


def test_text_without_section_is_stored_not_searched(index):
    assert index.count() == 3
    assert index.content.documents.count() == 4


def test_similar_finds_scores_and_sorts(index):
    found = rows(index.sql("select id, score from docs where similar('million lottery')"))
    assert found[0][0] == "1" and found[0][1] > found[1][1] > 0
    assert rows(index.sql("select id from docs where similar('million') and a = 1")) == [("0",)]
    assert rows(index.sql("select id from docs where similar(:q)", parameters={"q": "bear"})) == [("2",)]


def test_plain_text_search(index):
    assert [r[0] for r in rows(index.search("bear attack", 1))] == ["2"]


def test_limit_argument_holds_only_without_limit(index):
    assert len(rows(index.search("select id from docs", 2))) == 2
    assert len(rows(index.search("select id from docs limit 3", 2))) == 3


@pytest.mark.parametrize("query", ["select from docs", "select a as from docs", "select [a from docs", "select count( from docs"])
def test_bad_sql(index, query):
    with pytest.raises(SqlError):
        index.sql(query).collect()


def test_missing_index(index):
    with pytest.raises(IndexNotFoundError):
        index.sql("select id from docs where similar('x', nope)")


def test_read_only(spark, index):
    locked = Index(index.content, Settings(writable=False))
    with pytest.raises(ReadOnlyError):
        locked.delete(["0"])


def test_rewriter_numbers_clauses():
    q = Rewriter()("select id from x where similar('a b', 20, 0.3) and similar(:z)")
    assert [(c.query, c.candidates, c.weights) for c in q.similar] == [("a b", 20, 0.3), (":z", None, None)]
