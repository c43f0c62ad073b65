"""Queries of the SQL dialect, of changes to an index, and of shards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.registry import register
from corvane.plans.engine import Index, Settings
from corvane.plans.registered import BM25_SQL, bm25_sql, postings_sql, query, r6, table
from corvane.plans.shards import merge_shards
from corvane.sources.content import Columns, Content

NOW = datetime(2024, 1, 1)


def events(spark: SparkSession, sf_dir: str, **settings: object) -> Index:
    """Events as documents: the type is the text, the rest dynamic columns."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("text"), "user_id", "value", F.from_json("props", "struct<k:bigint>").alias("props"), F.array(F.struct(F.col("user_id").alias("ab c"))).alias("nest"),
    )
    return Index.of(rows, "event_id", Settings(keyword=False, **settings), now=NOW)


def documents(spark: SparkSession, sf_dir: str, **settings: object) -> Index:
    return Index.of(table(spark, sf_dir, "documents"), "doc_id", Settings(**{"normalize": False, **settings}), now=NOW)


def run(index: Index, text: str, **parameters: object) -> DataFrame:
    return index.sql(text, None, parameters or None)


_K = "CAST(json_extract_string(props, '$.k') AS double)"


@query(f"SELECT event_id::varchar AS id, event_type AS text, value::varchar AS v FROM (SELECT *, round(value, 6) AS value FROM events) WHERE {_K} > 50 AND user_id::double = 7".replace("value::varchar AS v", f"{_K} AS v"))
def sql_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select id, text, props.k + 0 as v from events where props.k > 50 and user_id = 7")


@query(f"SELECT event_type AS kind, count(*) AS n, round(sum(value), 6) AS total, round(avg({_K}), 6) AS k FROM events GROUP BY event_type")
def sql_json_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select text as kind, count(*) as n, round(total(value), 6) as total, round(avg(props.k), 6) as k from events group by text")


@query("SELECT event_id::varchar AS id, user_id AS \"nest[0].ab c\" FROM events WHERE user_id = 3")
def sql_bracket_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select id, [nest[0].ab c] from events where [nest[0].ab c] = 3")


@query("SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60")
def sql_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select user_id as u, count(*) as n from events group by user_id having count(*) > 60")


@query("SELECT DISTINCT event_type AS text FROM events")
def sql_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select distinct text from events")


@query("SELECT count(DISTINCT user_id) AS n, count(DISTINCT event_type) AS types, min(event_type) AS a, max(event_type) AS z FROM events")
def sql_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select count(distinct user_id) as n, count(distinct text) as types, min(text) as a, max(text) as z from events")


@query("SELECT event_id::varchar AS id, round(value, 6) AS v FROM events ORDER BY value DESC, event_id::varchar LIMIT 10 OFFSET 5")
def sql_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select id, round(value, 6) as v from events order by value desc, id limit 10 offset 5")


@query(f"SELECT event_id::varchar AS id FROM events WHERE {_K} = 10 AND event_type = 'click'")
def sql_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select id from events where props.k = :k and text = :t", k=10, t="click")


@query("SELECT event_type AS text, count(*) AS n FROM events WHERE event_type LIKE '%i%' AND event_type NOT LIKE 'v%' GROUP BY event_type")
def sql_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select text, count(*) as n from events where text like '%i%' and text not like 'v%' group by text")


@query("SELECT event_id::varchar AS id FROM events WHERE user_id IN (1, 2, 3)")
def sql_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select id from events where user_id in (1, 2, 3)")


@query(f"SELECT event_id::varchar AS id FROM events WHERE {_K} BETWEEN 10 AND 20 AND NOT (user_id < 100)")
def sql_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(events(spark, sf_dir), "select id from events where props.k between 10 and 20 and not (user_id < 100)")


@query(f"SELECT event_id::varchar AS id, round({_K} * 2 + 1, 6) AS twice, 'e-' || event_id AS name FROM events WHERE {_K} / 2 >= 30 AND {_K} IS NOT NULL")
def sql_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named expression, arithmetic, concatenation."""
    index = events(spark, sf_dir, expressions={"twice": "round(props.k * 2 + 1, 6)"})
    return run(index, "select id, twice, 'e-' || id as name from events where props.k / 2 >= 30 and props.k is not null")


@query("SELECT event_id::varchar AS id, reverse(event_type) AS r FROM events WHERE length(reverse(event_type)) > 5")
def sql_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, [{"name": "backwards", "function": lambda s: s.str[::-1], "vectorised": True, "returns": T.StringType()}])
    return run(events(spark, sf_dir), "select id, backwards(text) as r from events where length(backwards(text)) > 5")


@query("SELECT count(*) AS n, sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END)::bigint AS missing FROM events")
def sql_unknown_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that no document has is NULL."""
    return run(events(spark, sf_dir), "select count(*) as n, count(nothing.here) as missing from events")


@query(f"SELECT min(user_id) AS a, max(user_id) AS z, min({_K}::bigint) AS least, max({_K}::bigint) AS most, max(value) AS top, min(event_type) AS kind FROM events")
def sql_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of paths, by the types that they have in the documents: 100 is more than 9."""
    return run(events(spark, sf_dir), "select min(user_id) as a, max(user_id) as z, min(props.k) as least, max(props.k) as most, max(value) as top, min(text) as kind from events")


@query("SELECT event_id::varchar AS id, user_id AS u FROM events WHERE user_id > event_id OR value < user_id ORDER BY user_id DESC, event_id LIMIT 200")
def sql_compare_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths compared with each other and with a text column as numbers, and ordered as numbers."""
    return run(events(spark, sf_dir), "select id, user_id as u from events where user_id > id or value < user_id order by user_id desc, indexid limit 200")


@query("SELECT event_type AS kind, row_number() OVER (ORDER BY event_id) - 1 AS indexid, event_id::varchar AS id, event_type AS text, NULL::varchar AS tags, NULL::double AS score FROM events")
def sql_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns beside an item; what changes from run to run or has no SQL type is left out here."""
    return run(events(spark, sf_dir), "select text as kind, * from events").drop("entry", "data", "object")


@query("SELECT event_id::varchar AS id, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS day, strftime(date_trunc('month', ts) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS month, strftime(ts, '%H:%M') AS clock FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-15'")
def sql_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))
    index = Index.of(rows, "event_id", Settings(keyword=False), now=NOW)
    return run(index, "select id, date(at, '-1 day') as day, datetime(at, 'start of month', '+90 minutes') as month, strftime('%H:%M', at) as clock from events where date(at) >= '2024-01-15' and date(at) < date('now', '+1 day')")


_ONE = ["thtion ering"]
_TWO = ["ouan eaon"]


@query(f"""WITH {bm25_sql(_ONE, 100)}
    SELECT doc_id::varchar AS id, text, round(score, 6) AS score FROM hits JOIN documents ON doc_id = indexid WHERE lang = 'en' ORDER BY round(score, 9) DESC, doc_id LIMIT 10""")
def similar_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are ten times the limit when there are other conditions."""
    return run(documents(spark, sf_dir), "select id, text, round(score, 6) as score from docs where similar('thtion ering') and lang = 'en' order by round(score, 9) desc, indexid limit 10")


def _mean_sql(condition: str) -> str:
    h = lambda name, words: f"{name} AS (WITH {bm25_sql(words, 50)} SELECT indexid, score FROM hits)"
    return f"""WITH {h("a", _ONE)}, {h("b", _TWO)},
    j AS (SELECT coalesce(a.indexid, b.indexid) AS doc_id, a.score AS x, b.score AS y FROM a FULL JOIN b ON a.indexid = b.indexid)
    SELECT doc_id::varchar AS id, round((coalesce(x, 0) + coalesce(y, 0)) / ((x IS NOT NULL)::int + (y IS NOT NULL)::int), 6) AS score FROM j WHERE {condition}"""


@query(_mean_sql("x IS NOT NULL OR y IS NOT NULL"))
def similar_multi_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is the mean over the clauses that found a row."""
    return run(documents(spark, sf_dir), "select id, round(score, 6) as score from docs where similar('thtion ering', 50) or similar('ouan eaon', 50)")


@query(_mean_sql("x IS NOT NULL AND y IS NOT NULL"))
def similar_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(documents(spark, sf_dir), "select id, round(score, 6) as score from docs where similar('thtion ering', 50) and similar('ouan eaon', 50)")


@query(_mean_sql("x IS NOT NULL"))
def similar_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clause that isn't null: conditions never are, so the first decides."""
    return run(documents(spark, sf_dir), "select id, round(score, 6) as score from docs where coalesce(similar('thtion ering', 50), similar('ouan eaon', 50))")


@query(f"""WITH {bm25_sql(_ONE, 5)} SELECT doc_id::varchar AS id, text, round(score, 6) AS score FROM hits JOIN documents ON doc_id = indexid""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that isn't SQL gives id, text and score."""
    return documents(spark, sf_dir).search("thtion ering", 5).select("id", "text", r6("score").alias("score"))


@query(f"""WITH {postings_sql("part", "p_partkey", "p_name")},
    h AS (SELECT indexid, sum({BM25_SQL}) AS score FROM post JOIN df USING (term), stats WHERE term LIKE 'wid%' OR term = 'gear' GROUP BY indexid)
    SELECT indexid::varchar AS id, round(score, 6) AS score FROM h QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, indexid) <= 50""")
def subindex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named index over another column, searched by similar(query, candidates, index)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("text"), "p_name")
    index = Index.of(rows, "p_partkey", Settings(keyword=False, columns=Columns()), now=NOW, indexes={"names": ("p_name", Settings(normalize=False))})
    return index.sql("select id, round(score, 6) as score from parts where similar('wid* gear', 50, names)")


# Changes


def content(spark: SparkSession, sf_dir: str) -> Content:
    return Content.of(table(spark, sf_dir, "documents"), "doc_id", now=NOW)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS indexid, doc_id::varchar AS id, text FROM documents WHERE text IS NOT NULL")
def content_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content(spark, sf_dir).sections.select("indexid", "id", "text")


@query("""WITH n AS (SELECT count(*) AS n, max(doc_id) AS m FROM documents),
    old AS (SELECT doc_id::varchar AS id, row_number() OVER (ORDER BY doc_id) - 1 AS indexid, text FROM documents),
    new AS (SELECT doc_id AS k, 'new ' || lang AS text FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT m + 1, 'added' FROM n)
    SELECT indexid, id, text FROM old WHERE id NOT IN (SELECT k::varchar FROM new)
    UNION ALL SELECT n + row_number() OVER (ORDER BY k) - 1, k::varchar, new.text FROM new, n""")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten per cent of the rows and one new row replace what was there."""
    docs = table(spark, sf_dir, "documents")
    added = docs.agg((F.max("doc_id") + 1).alias("doc_id"), F.lit("added").alias("text"))
    new = docs.where("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("new "), "lang").alias("text")).unionByName(added)
    return content(spark, sf_dir).upsert(Content.of(new, "doc_id", now=NOW)).sections.select("indexid", "id", "text")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS indexid, doc_id::varchar AS id FROM documents QUALIFY lang <> 'fr'")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    return content(spark, sf_dir).delete(gone).sections.select("indexid", "id")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS indexid, doc_id::varchar AS id FROM documents WHERE lang <> 'fr'")
def reindex_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    return content(spark, sf_dir).delete(gone).reindex().sections.select("indexid", "id")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS "count(*)", round(sum(l_quantity), 2) AS total, min(l_extendedprice) AS "min(p)", max(l_extendedprice) AS "max(p)"
    FROM lineitem GROUP BY ALL""")
def shard_merge_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results of four shards put together."""
    rows = table(spark, sf_dir, "lineitem").withColumn("shard", F.pmod(F.xxhash64("l_orderkey"), F.lit(4)))
    parts = [rows.where(F.col("shard") == i).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("count(*)"), F.sum("l_quantity").alias("sum(q)"), F.min("l_extendedprice").alias("min(p)"), F.max("l_extendedprice").alias("max(p)")) for i in range(4)]
    out = merge_shards(parts)
    return out.select("l_returnflag", "l_linestatus", "`count(*)`", F.round("`sum(q)`", 2).alias("total"), "`min(p)`", "`max(p)`")
