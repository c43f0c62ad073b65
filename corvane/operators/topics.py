"""Topics: communities named by their commonest words. Null texts have no words; groups without any have no terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.tokenize import alphanum
from corvane.operators import dense
from corvane.sources.scratch import balanced, stage


def term_statistics(groups: DataFrame, named: DataFrame, text: str = "text") -> DataFrame:
    """(grp, indexid, dl, term, tf, df, n, avgdl) of documents (grp, indexid, text), each group its own corpus, for the terms of ``named`` (grp, terms).

    Texts are split once; only tokens that are terms of their group leave that pass.
    """
    tokens = balanced(groups.select("grp", "indexid", text)).select("grp", "indexid", alphanum(F.col(text)).alias("tokens")).where("tokens is not null")
    kept = F.filter("tokens", lambda x: F.array_contains("terms", x))
    found = tokens.join(named, "grp", "left").select("grp", "indexid", F.size("tokens").cast("long").alias("dl"), kept.alias("kept"))
    found = stage(found, "terms")
    rows = found.select("grp", "indexid", "dl", F.explode("kept").alias("term"))
    tf = rows.groupBy("grp", "indexid", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    per_group = found.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, ["grp", "term"]).join(per_group, "grp")


def topic_terms(groups: DataFrame, text: str = "text", terms: int = 4, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(grp, rank, term, df): the ``terms`` words of least idf (in most documents) of each group, ties by the word."""
    tokens = groups.select("grp", F.explode(F.array_distinct(alphanum(F.col(text)))).alias("term"))
    df = tokens.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    if stopwords:
        df = df.where(~F.col("term").isin(list(stopwords)))
    order = Window.partitionBy("grp").orderBy(F.desc("df"), "term")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= terms).select("grp", "rank", "term", "df")


def topic_labels(groups: DataFrame, text: str = "text", terms: int = 4, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(grp, topic): the terms joined by underscores."""
    rows = topic_terms(groups, text, terms, stopwords)
    return rows.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "_").alias("topic"))


def ranked(groups: DataFrame, text: str = "text", terms: int = 4, k1: float = 1.2, b: float = 0.75, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(topic, indexid, score, topicrank): documents of each topic by BM25 of its terms; groups with the same terms are one topic."""
    best = F.array_sort(F.collect_list(F.struct("rank", "term")))
    named = topic_terms(groups, text, terms, stopwords).groupBy("grp").agg(F.transform(best, lambda x: x["term"]).alias("terms"))
    named = stage(named, "topics")
    stats = term_statistics(groups, named, text)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = stats.groupBy("grp", "indexid").agg(F.sum(score).alias("score")).join(named.select("grp", F.array_join("terms", "_").alias("topic")), "grp")
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), "indexid")
    return rows.select("topic", "indexid", "score", (F.row_number().over(order) - 1).cast("long").alias("topicrank"))


def named(groups: DataFrame, degree: DataFrame, terms: int = 4, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(indexid, topic, topicrank) of members (grp, indexid, text) of communities.

    Members without any of the topic's words rank last, by degree; so do all of
    a community without words, which is named by its place by size.
    """
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    labels = topic_labels(groups, "text", terms, stopwords)
    nameless = size.join(labels, "grp", "left_anti")
    places = size.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "grp")) - 1)  # a row for each community
    labels = labels.unionByName(nameless.join(places.select("grp", "place"), "grp").select("grp", F.concat(F.lit("topic_"), "place").alias("topic")))
    scores = ranked(groups, "text", terms, stopwords=stopwords).select("indexid", "score")
    rows = groups.select("grp", "indexid").join(labels, "grp").join(scores, "indexid", "left").join(degree.select("indexid", "degree"), "indexid")
    order = Window.partitionBy("topic").orderBy(F.desc_nulls_last(F.round("score", 9)), F.desc("degree"), "indexid")
    return rows.select("indexid", "topic", (F.row_number().over(order) - 1).cast("long").alias("topicrank"))


def sizes(topics: DataFrame) -> DataFrame:
    """(topic, n, place): topics from the largest on."""
    n = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "topic")).cast("long"))


def categories(topics: DataFrame, names: DataFrame) -> DataFrame:
    """(topic, category): for each topic (topic, vector) the nearest of ``names`` (category, vector)."""
    t = topics.withColumn("qid", F.xxhash64("topic"))
    c = names.withColumn("indexid", F.xxhash64("category"))
    best = dense.search(c.select("indexid", "vector"), t.select("qid", "vector"), 1)
    return best.join(t.select("qid", "topic"), "qid").join(c.select("indexid", "category"), "indexid").select("topic", "category")
