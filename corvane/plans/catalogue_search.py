"""Queries over words and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import dense, fusion, retrieval, scoring
from corvane.plans.registered import BM25_SQL, bm25_sql, postings_sql, query, r6, table
from corvane.sources.scratch import balanced, stage

WORDS = ["thtion ering ander", "ouan eaon", "lichung schen verein", "ment elle dans"]


def terms(spark: SparkSession, sf_dir: str, method: scoring.Method | None = None) -> scoring.Terms:
    return scoring.Terms.of(table(spark, sf_dir, "documents"), "doc_id", "text", method)


def named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("qid").cast("long").alias("qid"), F.col("indexid").alias("doc_id"), r6("score").alias("score"))


def topk(spark: SparkSession, sf_dir: str, method: scoring.Method) -> DataFrame:
    return named(terms(spark, sf_dir, method).search(WORDS, 10))


def _topk_sql(score: str) -> str:
    return f"WITH {bm25_sql(WORDS, 10)} SELECT qid::bigint AS qid, indexid AS doc_id, round(score, 6) AS score FROM hits".replace(BM25_SQL, score)


@query(_topk_sql(BM25_SQL))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark, sf_dir, scoring.bm25())


@query(_topk_sql("(ln((n + 1)::double / (df + 1)) + 1) * sqrt(tf) / sqrt(dl)"))
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark, sf_dir, scoring.tfidf())


@query(_topk_sql("0.001::double / (0.001::double + cf::double / tokens)"))
def sif_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark, sf_dir, scoring.sif())


@query(f"WITH {postings_sql()} SELECT term, round(0.001::double / (0.001::double + cf::double / tokens), 6) AS weight FROM df, stats")
def sif_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir, scoring.sif()).terms().select("term", r6("idf").alias("weight"))


@query(f"""WITH {postings_sql()}
    SELECT any_value(n)::bigint AS total, any_value(tokens)::bigint AS tokens, round(any_value(avgdl), 6) AS avgdl, count(*)::bigint AS words,
           round(any_value(tokens) / count(*), 6) AS avgfreq, round(avg(ln(1 + (n - df + 0.5::double) / (df + 0.5::double))), 6) AS avgidf
    FROM df, stats""")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).corpus().select("total", "tokens", r6("avgdl").alias("avgdl"), "words", r6("avgfreq").alias("avgfreq"), r6("avgidf").alias("avgidf"))


_LIKE = "(term = 'ering' OR term LIKE 'lichu%' OR term LIKE 'tho%in')"


@query(f"""WITH {postings_sql()} SELECT 0::bigint AS qid, indexid AS doc_id, round(score, 6) AS score
    FROM (SELECT indexid, sum({BM25_SQL}) AS score FROM post JOIN df USING (term), stats WHERE {_LIKE} GROUP BY indexid)
    QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, indexid) <= 10""")
def bm25_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(terms(spark, sf_dir).search(["ering lichu* tho*in"], 10))


@query(f"""WITH {bm25_sql(WORDS, 10)},
    a AS (SELECT avg(ln(1 + (n - df + 0.5::double) / (df + 0.5::double))) AS idf, any_value(tokens) / count(*) AS tf FROM df, stats),
    avgs AS (SELECT idf * tf * 2.2::double / (tf + 1.2::double) AS avgscore FROM a)
    SELECT qid::bigint AS qid, indexid AS doc_id, round(least(score / least(max(score) OVER (PARTITION BY qid) + avgscore, 6 * avgscore), 1.0::double), 6) AS score FROM hits, avgs""")
def bm25_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terms(spark, sf_dir)
    return named(scoring.normalise(t.search(WORDS, 10), t.corpus().select("avgscore")))


@query(f"""WITH {bm25_sql(WORDS, 10)},
    m AS (SELECT qid, median(score) AS mid, stddev_pop(score) AS sd FROM hits GROUP BY qid)
    SELECT qid::bigint AS qid, indexid AS doc_id, round(1 / (1 + exp(-greatest(-500.0::double, least(500.0::double, (CASE WHEN sd > 0 THEN 1 / sd ELSE 1 END) * (score - mid))))), 6) AS score
    FROM hits JOIN m USING (qid)""")
def bm25_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(scoring.bayes(terms(spark, sf_dir).search(WORDS, 10)))


@query(f"""WITH {bm25_sql(WORDS, 10, "indexid NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")}
    SELECT qid::bigint AS qid, indexid AS doc_id, round(score, 6) AS score FROM hits""")
def bm25_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted rows drop out before the cut; statistics stay."""
    t = terms(spark, sf_dir)
    t.deleted = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("indexid"))
    return named(t.search(WORDS, 10))


@query(f"""WITH {postings_sql("part", "p_partkey", "p_name")},
    w AS (SELECT indexid, dl, pos - 1 AS pos, w[pos] AS token FROM (SELECT indexid, w, len(w) AS dl, unnest(range(1, len(w) + 1)) AS pos FROM tok)),
    x AS (SELECT w.indexid, w.pos, w.token, {BM25_SQL} AS weight FROM w JOIN post ON post.indexid = w.indexid AND post.term = w.token JOIN df ON df.term = w.token, stats)
    SELECT indexid, pos, token, round(weight, 6) AS weight FROM x""".replace("* dl /", "* w.dl /"))
def token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.Terms.of(table(spark, sf_dir, "part"), "p_partkey", "p_name").weights()
    return rows.select("indexid", F.col("pos").cast("long").alias("pos"), "token", r6("weight").alias("weight"))


@query(f"""WITH {postings_sql("part", "p_partkey", "p_name")},
    w AS (SELECT indexid, dl, pos - 1 AS pos, w[pos] AS token FROM (SELECT indexid, w, len(w) AS dl, unnest(range(1, len(w) + 1)) AS pos FROM tok)),
    x AS (SELECT w.indexid, w.pos, w.token, {BM25_SQL} AS weight FROM w JOIN post ON post.indexid = w.indexid AND post.term = w.token JOIN df ON df.term = w.token, stats),
    g AS (SELECT tag, count(*) AS n FROM (SELECT unnest(string_split_regex(p_name, '\\s+')) AS tag FROM part), (SELECT count(*) AS total FROM part) WHERE tag <> '' GROUP BY tag, total HAVING count(*) >= total * 0.005::double),
    y AS (SELECT indexid, pos, token, weight, n, max(weight) OVER (PARTITION BY indexid) AS most, max(n) OVER (PARTITION BY indexid) AS most_n FROM x LEFT JOIN g ON tag = token)
    SELECT indexid, pos, token, round(CASE WHEN n IS NOT NULL THEN greatest(weight, most * n / most_n) ELSE weight END, 6) AS weight FROM y""".replace("* dl /", "* w.dl /"))
def token_weights_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are frequent tags are lifted towards their row's greatest weight."""
    part = table(spark, sf_dir, "part")
    rows = scoring.Terms.of(part, "p_partkey", "p_name").weights(scoring.tag_counts(part, "p_name"))
    return rows.select("indexid", F.col("pos").cast("long").alias("pos"), "token", r6("weight").alias("weight"))


@query("""WITH t AS (SELECT unnest(string_split_regex(p_type, '\\s+')) AS tag FROM part), n AS (SELECT count(*) AS total FROM part)
    SELECT tag, count(*) AS n FROM t, n WHERE tag <> '' GROUP BY tag, total HAVING count(*) >= total * 0.005::double""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tag_counts(table(spark, sf_dir, "part"), "p_type")


# Vectors


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("indexid"), F.col("embedding").alias("vector"))


AXES = [[1.0 if i == j else 0.1 for i in range(64)] for j in range(3)]
_Q = "(VALUES " + ", ".join(f"({i}, {v}::double[])" for i, v in enumerate(AXES)) + ") AS q(qid, v)"
_COS = "list_cosine_similarity(embedding::double[], v)"


def _dense_sql(k: int | None) -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) <= {k}" if k else ""
    return f"SELECT qid::bigint AS qid, vec_id, round(score, 6) AS score FROM (SELECT qid, vec_id, {_COS} AS score FROM embeddings, {_Q}) {cut}"


def _vec(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.col("indexid").alias("vec_id"), r6("score").alias("score"))


@query(_dense_sql(5).replace(_Q, f"(SELECT * FROM {_Q} WHERE qid = 0)"))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(dense.search(corpus(spark, sf_dir), dense.vectors(spark, AXES[:1]), 5))


@query("""WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS score
                     FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
    SELECT qid, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) <= 5""")
def dense_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other rows of every row."""
    rows = corpus(spark, sf_dir)
    return _vec(dense.search(rows, rows.withColumnRenamed("indexid", "qid"), 5, loops=False))


@query(_dense_sql(None))
def similarity_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(dense.search(corpus(spark, sf_dir), dense.vectors(spark, AXES), None))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
    w AS (SELECT vec_id, list_sum([b[i + 1]::bigint << i FOR i IN range(0, 32)]) AS lo, list_sum([b[i + 33]::bigint << i FOR i IN range(0, 32)]) AS hi FROM b),
    s AS (SELECT q.vec_id AS qid, w.vec_id, 1 - (bit_count(xor(q.lo::bigint, w.lo::bigint)) + bit_count(xor(q.hi::bigint, w.hi::bigint)))::double / 64 AS score FROM w, w AS q WHERE q.vec_id <> w.vec_id)
    SELECT qid, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) <= 5""")
def hamming_1bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows whose sign bits are nearest to those of every row."""
    rows = corpus(spark, sf_dir).select("indexid", V.sign_words(F.col("vector"), 64).alias("vector"))
    return _vec(dense.search(rows, rows.withColumnRenamed("indexid", "qid"), 5, loops=False, measure=dense.hamming(64)))


@query("""
    SELECT vec_id, string_agg(printf('%02X', floor(greatest(-128.0::double, least(127.0::double, embedding[i]::double * 128)) + 128)::integer), '' ORDER BY i) AS code
    FROM embeddings, range(1, 65) AS r(i) GROUP BY vec_id""")
def quantize_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(F.col("indexid").alias("vec_id"), F.hex(V.quantise(F.col("vector"), 8)).alias("code"))


@query("""WITH n AS (SELECT vec_id, embedding[1:32]::double[] AS v FROM embeddings)
    SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS vector FROM n""")
def truncate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.normalise(V.truncate(F.col("vector"), 32))
    return corpus(spark, sf_dir).select(F.col("indexid").alias("vec_id"), v.alias("v")).select("vec_id", F.transform("v", r6).alias("vector"))


@query()
def pca_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without their main axis; tests/test_vectors.py holds it against numpy."""
    rows = corpus(spark, sf_dir)
    _, axes = V.principal_axes(rows, "vector", 1)
    return rows.select(F.col("indexid").alias("vec_id"), V.remove_axes(F.col("vector"), axes).alias("vector"))


@query("""WITH f AS (SELECT vec_id, i AS dim, embedding[i]::double AS x FROM embeddings, range(1, 65) AS r(i)),
    c AS (SELECT vec_id, dim, x FROM f WHERE x > 0), q AS (SELECT vec_id AS qid, dim, x AS q FROM c)
    SELECT qid, vec_id, round(score, 6) AS score FROM (SELECT qid, vec_id, sum(x * q) AS score FROM c JOIN q USING (dim) GROUP BY qid, vec_id)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) <= 3""")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive parts of all vectors as sparse ones, each a query too."""
    rows = corpus(spark, sf_dir).select("indexid", dense.positive_part().alias("vector"))
    return _vec(dense.search(rows, rows.withColumnRenamed("indexid", "qid"), 3, measure=dense.SPARSE))


@query("""WITH f AS (SELECT vec_id, i AS dim, embedding[i]::double AS x FROM embeddings, range(1, 65) AS r(i) WHERE embedding[i] > 0),
    s AS (SELECT q.vec_id AS qid, f.vec_id, sum(f.x * q.x) AS score FROM f JOIN f AS q USING (dim) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) <= 3),
    o AS (SELECT vec_id AS qid, sum(x * x) / 0.5::double AS own FROM f GROUP BY vec_id)
    SELECT qid, vec_id, round(score / greatest(own, 0.5::double, max(score) OVER (PARTITION BY qid)), 6) AS score FROM t JOIN o USING (qid)""")
def sparse_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth row asks all rows by their positive parts; scores are brought to 0..1."""
    rows = balanced(corpus(spark, sf_dir)).select("indexid", dense.positive_part().alias("vector"))
    fiftieth = corpus(spark, sf_dir).where("indexid % 50 = 0")
    asked = fiftieth.select(F.col("indexid").alias("qid"), dense.positive_part().alias("vector"))
    values = fiftieth.select(F.col("indexid").alias("qid"), F.explode("vector").alias("value")).withColumn("value", F.col("value").cast("double")).where("value > 0")
    return _vec(dense.normalise_sparse(dense.search(rows, asked, 3, measure=dense.SPARSE), values, 0.5))


@query("""WITH m AS (SELECT vec_id, embedding[1:16]::double[] AS a, embedding[17:32]::double[] AS b, embedding[33:48]::double[] AS c, embedding[49:64]::double[] AS d FROM embeddings),
    t AS (SELECT vec_id, unnest([a, b, c, d]) AS v FROM m),
    x AS (SELECT m.vec_id, t.vec_id AS qid, greatest(list_inner_product(t.v, m.a), list_inner_product(t.v, m.b), list_inner_product(t.v, m.c), list_inner_product(t.v, m.d)) AS best FROM t, m WHERE t.vec_id <> m.vec_id),
    s AS (SELECT qid, vec_id, sum(best) / 4 AS score FROM x GROUP BY qid, vec_id)
    SELECT qid, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) <= 3""")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four quarters of a vector as token vectors; the three best rows for every row."""
    parts = F.array(*(F.slice("vector", i, 16) for i in (1, 17, 33, 49)))
    rows = corpus(spark, sf_dir).select("indexid", parts.alias("vector"))
    return _vec(dense.search(rows, rows.withColumnRenamed("indexid", "qid"), 3, loops=False, measure=dense.MAX_SIM))


_QUARTERS = "[embedding[1:16]::double[], embedding[17:32]::double[], embedding[33:48]::double[], embedding[49:64]::double[]]"


@query(f"""WITH m AS (SELECT vec_id, {_QUARTERS} AS m, i FROM embeddings, range(1, 17) AS r(i)),
    x AS (SELECT vec_id, i, m[1][i] AS a, m[2][i] AS b, m[3][i] AS c, m[4][i] AS d FROM m)
    SELECT vec_id, i - 1 AS i, round((a + b + c + d) / 4, 6) AS mean, round((a + 2 * b + 3 * c + 4 * d) / 10, 6) AS weighted, round(greatest(a, b, c, d), 6) AS greatest, round(a, 6) AS first, round(d, 6) AS last FROM x""")
def pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four quarters of a vector as token vectors, made one by every kind of pooling."""
    m = F.transform(F.array(*(F.slice("vector", i, 16) for i in (1, 17, 33, 49))), lambda v: F.transform(v, lambda x: x.cast("double")))
    weights = F.array(*(F.lit(float(i)) for i in (1, 2, 3, 4)))
    rows = corpus(spark, sf_dir).select("indexid", m.alias("m"))
    pools = {"mean": "mean", "weighted": "weighted", "greatest": "max", "first": "cls", "last": "last"}
    rows = rows.select(F.col("indexid").alias("vec_id"), *(V.pool(F.col("m"), how, weights).alias(name) for name, how in pools.items()))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip(*pools)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), *(r6(F.col("x")[name]).alias(name) for name in pools))


@query()
def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every fiftieth row, by cells: every row is in one. These vectors hardly cluster, so a search reads two thirds of the cells; tests/test_vectors.py measures recall."""
    rows = corpus(spark, sf_dir)
    n = dense.cell_count(rows.count())
    celled, centres = dense.clusters(rows, n)
    return _vec(dense.probe(stage(celled, "cells"), centres, rows.where("indexid % 50 = 0").withColumnRenamed("indexid", "qid"), 10, -(-2 * n // 3)))


# Fusion: documents and vectors meet in doc_id = vec_id

_SIDES = f"""WITH {bm25_sql(["thtion ering ander"], 200)},
    sp AS (SELECT indexid, least(score / 20, 0.99::double) AS score FROM hits),
    de AS (SELECT vec_id AS indexid, score FROM (SELECT vec_id, {_COS} AS score FROM embeddings, (SELECT * FROM {_Q} WHERE qid = 0))
           QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) <= 200)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = terms(spark, sf_dir).search(["thtion ering ander"], 200).select(F.col("qid").cast("long").alias("qid"), "indexid", F.least(F.col("score") / 20, F.lit(0.99)).alias("score"))
    return dense.search(corpus(spark, sf_dir), dense.vectors(spark, AXES[:1]), 200), s


def fused(rows: DataFrame) -> DataFrame:
    return rows.select("indexid", r6("score").alias("score"))


@query(_SIDES + """ SELECT indexid, round(sum(s), 6) AS score FROM (SELECT indexid, 0.7::double * score AS s FROM de UNION ALL SELECT indexid, (1 - 0.7::double) * score FROM sp) GROUP BY indexid""")
def hybrid_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(fusion.convex(*sides(spark, sf_dir), 0.7))


@query(_SIDES + """, r AS (SELECT indexid, 0.5::double / row_number() OVER (ORDER BY round(score, 9) DESC, indexid) AS s FROM de
        UNION ALL SELECT indexid, 0.5::double / row_number() OVER (ORDER BY round(score, 9) DESC, indexid) FROM sp)
    SELECT indexid, round(sum(s), 6) AS score FROM r GROUP BY indexid""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(fusion.reciprocal(*sides(spark, sf_dir), 0.5))


@query(_SIDES + """, l AS (SELECT list_sort(list(score) FILTER (score > 0)) AS l, stddev_pop(score) FILTER (score > 0) AS sd FROM de),
    d AS (SELECT indexid, greatest(-500.0::double, least(500.0::double, (score - l[len(l) // 2 + 1]) / (CASE WHEN sd > 0 THEN sd ELSE 1 END))) AS d FROM de, l),
    s AS (SELECT indexid, ln(score / (1 - score)) AS s FROM sp)
    SELECT indexid, round(1 / (1 + exp(-(coalesce(d * 0.5::double, 0) + coalesce(s * 0.5::double, 0)) * (CASE WHEN d IS NOT NULL AND s IS NOT NULL THEN sqrt(2.0::double) ELSE 1 END))), 6) AS score
    FROM d FULL JOIN s USING (indexid)""")
def hybrid_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(fusion.log_odds(*sides(spark, sf_dir), 0.5))


# What follows a search


@query("""SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion') AND NOT contains(lower(text), 'qu')""")
def rag_must_mustnot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(retrieval.lexical_filter("what +Tion -qu", F.col("text"))).select("conv_id", "turn")


@query(f"""WITH {bm25_sql(WORDS, 3)},
    c AS (SELECT qid, string_agg(text, ' ' ORDER BY score DESC, doc_id) AS context FROM hits JOIN documents ON doc_id = indexid GROUP BY qid),
    a AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS))}) AS v(qid, question))
    SELECT qid::bigint AS qid, 'Question: ' || question || chr(10) || 'Context: ' || coalesce(context, '') AS prompt FROM a LEFT JOIN c USING (qid)""")
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terms(spark, sf_dir).search(WORDS, 3)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("indexid"), "text").join(F.broadcast(found), "indexid")
    questions = spark.createDataFrame(list(enumerate(WORDS)), "qid int, question string")
    best = retrieval.context(rows, " ".join(WORDS[:1]), 3)
    return retrieval.prompts(best, questions, "Question: {question}\nContext: {context}").select(F.col("qid").cast("long").alias("qid"), "prompt")


@query(f"""WITH {bm25_sql(WORDS, 100)}
    SELECT qid::bigint AS qid, doc_id, round(n, 6) AS score FROM (SELECT qid, doc_id, 1000.0::double / (1 + n_chars) AS n FROM hits JOIN documents ON doc_id = indexid)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(n, 9) DESC, doc_id) <= 10""")
def rerank_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten times the wanted rows by words, then the best by another score (short texts first)."""
    rows = terms(spark, sf_dir).search(WORDS, 100).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("indexid"), "n_chars"), "indexid")
    return named(retrieval.rerank(rows, 1000.0 / (1 + F.col("n_chars")), 10))


@query(f"""WITH {bm25_sql(WORDS, 10)},
    rel AS (SELECT qid, doc_id AS indexid, 1.0::double AS r FROM labels, (SELECT DISTINCT qid FROM q) WHERE quality = 1),
    h AS (SELECT qid, indexid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, indexid) AS rank FROM hits),
    x AS (SELECT h.qid, rank, coalesce(r, 0) AS r, sum(coalesce(r, 0)) OVER (PARTITION BY h.qid ORDER BY rank) AS seen FROM h LEFT JOIN rel USING (qid, indexid)),
    g AS (SELECT qid, sum(r / log2(rank + 1)) AS dcg, sum(r) AS hit, sum(r * seen / rank) AS ap FROM x GROUP BY qid),
    i AS (SELECT qid, count(*) AS n, sum(CASE WHEN k <= 10 THEN 1 / log2(k + 1) END) AS idcg FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY indexid) AS k FROM rel) GROUP BY qid)
    SELECT qid::bigint AS qid, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(ap / least(n, 10), 0), 6) AS "map", round(coalesce(hit / n, 0), 6) AS recall, round(coalesce(hit / 10, 0), 6) AS "precision"
    FROM i LEFT JOIN g USING (qid)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terms(spark, sf_dir).search(WORDS, 10)
    qids = spark.createDataFrame([(i,) for i in range(len(WORDS))], "qid int")
    rel = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("indexid"), F.lit(1).alias("relevance")).crossJoin(F.broadcast(qids))
    rows = retrieval.metrics(found, rel, 10)
    return rows.select(F.col("qid").cast("long").alias("qid"), *(r6(c).alias(c) for c in ("ndcg", "map", "recall", "precision")))


@query("""WITH s AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
    x AS (SELECT vec_id, i - 1 AS label, exp(e[i]) / list_sum(list_transform(e, lambda y: exp(y))) AS p FROM s, range(1, 65) AS r(i))
    SELECT vec_id, label, round(p, 6) AS score FROM x WHERE p >= 0.018::double""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as class scores: softmax, flattened at a limit."""
    rows = corpus(spark, sf_dir).select(F.col("indexid").alias("vec_id"), F.explode(retrieval.labels(F.col("vector"), False, 0.018)).alias("x"))
    return rows.select("vec_id", "x.label", r6("x.score").alias("score"))


@query()
def explain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of short texts, what each token adds; tests/test_vectors.py holds it against leaving out each token."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("indexid"), "text")
    return retrieval.explain(rows, "the of and", V.hashing_encoder()).select("indexid", "pos", "token", r6("score").alias("score"))
