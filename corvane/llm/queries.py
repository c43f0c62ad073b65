"""The operators' queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, decontaminate, exact_dedup, html_extract, license_scan, near_dedup, pii, quality, reply_trees, url_rules
from corvane.llm.shared import table
from corvane.llm.words import WORD_SEPARATOR


#: A fixed key, so that runs agree. Real data need a secret one.
DEMO_KEY = b"corvane demonstration key"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text, kept, nodes) for every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of) for every document that repeats another nearly."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_id, copies) for every document."""
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for every document."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best branch of every conversation, as one text."""
    return reply_trees.conversations(table(spark, sf_dir, "conversations"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, entities) for every document."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal span of 13 words or more that a document shares with a benchmark item."""
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, rejected, rule, confidence) for every page."""
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.mine(pages, table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, keep) for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_minhash_near_dedup, op3_exact_dedup, op4_bpe, op5_chat_formatting, op6_pii_surrogates, op7_benchmark_decontamination, op8_url_rules, op9_license_scan, op10_quality_classifier)
    return {f.__name__: f for f in found}


_WORDS = """
    SELECT {id} AS id, w[i] AS word, i - 1 AS p, len(w) AS n, w[i:i + {span} - 1] AS span
    FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '@separator@'), lambda x: x <> '') AS w FROM {table}) t,
         unnest(range(1, len(w) - {span} + 2)) AS u(i)
"""


def oracle_sql() -> dict[str, str]:
    span = decontaminate.LEAST
    docs = _WORDS.format(id="doc_id", table="documents", span=span).replace("@separator@", WORD_SEPARATOR)
    items = _WORDS.format(id="item_id", table="benchmark", span=span).replace("@separator@", WORD_SEPARATOR)
    return {
        "op3_exact_dedup": """
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, count(*) OVER (PARTITION BY text) AS copies
            FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT doc_id, doc_id, 1 FROM documents WHERE text IS NULL""",
        # Without a parent column a message answers the first one of the latest earlier turn.
        "op5_chat_formatting": """
            WITH RECURSIVE m AS (
              SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) AS node
              FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
                    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
            f AS (SELECT *, min(node) OVER (PARTITION BY conv_id, turn) AS head FROM m),
            t AS (SELECT conv_id, node, turn, role, text,
                         max(head) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent
                  FROM f),
            p AS (SELECT conv_id, node, 1::bigint AS n, length(text)::bigint AS chars, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS body
                  FROM t WHERE parent IS NULL
                  UNION ALL
                  SELECT t.conv_id, t.node, p.n + 1, p.chars + length(t.text), p.body || '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)
                  FROM p JOIN t ON t.conv_id = p.conv_id AND t.parent = p.node),
            leaf AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = p.conv_id AND t.parent = p.node)),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, chars DESC, body) AS branch FROM leaf)
            SELECT conv_id, branch, n AS n_messages, n::double AS score, body AS text FROM ranked WHERE branch = 1""",
        "op7_benchmark_decontamination": f"""
            WITH d AS ({docs}), b AS ({items}),
            hit AS (SELECT d.id AS doc_id, b.id AS item_id, d.p AS dp, b.p AS bp,
                           d.p - row_number() OVER (PARTITION BY d.id, b.id, d.p - b.p ORDER BY d.p) AS island
                    FROM d JOIN b ON d.span = b.span)
            SELECT doc_id, item_id, min(dp)::bigint AS doc_start, min(bp)::bigint AS item_start, (count(*) + {span - 1})::bigint AS n_words
            FROM hit GROUP BY doc_id, item_id, dp - bp, island""",
    }
