"""How queries are registered, and SQL that several of them share."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.tokenize import ALPHANUM, SPACE, STOP_WORDS, STRIP

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def r6(c: str | Column) -> Column:
    """Rounded to six digits; what is rounded to zero keeps its sign, as in SQL."""
    c = F.col(c) if isinstance(c, str) else c
    rounded = F.round(c, 6)
    return F.when(rounded == 0, F.signum(c) * F.lit(0.0)).otherwise(rounded)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(column: str) -> str:
    """The alphanumeric tokens of a column."""
    return f"""list_filter(list_transform(regexp_split_to_array(lower({column}), '{SPACE}'), lambda x: regexp_replace(x, '{STRIP}', '', 'g')),
                lambda x: regexp_matches(x, '{ALPHANUM}') AND NOT list_contains([{_STOPS}], x))"""


def postings_sql(table: str = "documents", id: str = "doc_id", text: str = "text") -> str:
    """CTEs tok, post, stats, df."""
    return f"""tok AS (SELECT {id} AS indexid, {tokens_sql(text)} AS w FROM {table} WHERE {text} IS NOT NULL),
        post AS (SELECT indexid, dl, term, count(*) AS tf FROM (SELECT indexid, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
        stats AS (SELECT count(*) AS n, sum(len(w)) AS tokens, sum(len(w)) / count(*) AS avgdl FROM tok),
        df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term)"""


BM25_SQL = "ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))"


def bm25_sql(queries: list[str], k: int | None, extra: str = "true") -> str:
    """CTEs up to hits (qid, indexid, score): BM25 of queries of plain words."""
    rows = ", ".join(f"({q}, '{w}')" for q, text in enumerate(queries) for w in text.split())
    cut = f"QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, indexid) <= {k}" if k else ""
    return f"""{postings_sql()},
        q AS (SELECT qid, term, count(*) AS m FROM (VALUES {rows}) AS v(qid, term) GROUP BY qid, term),
        hits AS (SELECT qid, indexid, score FROM (SELECT qid, indexid, sum(m * {BM25_SQL}) AS score
                 FROM post JOIN df USING (term) JOIN q USING (term), stats WHERE {extra} GROUP BY qid, indexid) {cut})"""
