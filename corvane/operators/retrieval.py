"""What follows a search: filters, reranking, prompts, explanations, metrics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.template import fill
from corvane.functions.vectors import Encoder, dot, encode
from corvane.operators.scoring import top


def lexical_filter(query: str, text: Column) -> Column:
    """Terms after ``+`` must be in the text, terms after ``-`` must not, in any case."""
    out = F.lit(True)
    for term in query.split():
        if term[0] in "+-" and len(term) > 1:
            has = F.contains(F.lower(text), F.lit(term[1:].lower()))
            out = out & (has if term[0] == "+" else ~has)
    return out


def context(rows: DataFrame, query: str, k: int = 3, minscore: float = 0.0, mintokens: int = 0) -> DataFrame:
    """The best ``k`` of (qid, indexid, text, score) that pass the filters, least id first among equals."""
    good = rows.where(lexical_filter(query, F.col("text")) & (F.col("score") >= minscore) & (F.size(F.split(F.trim("text"), r"\s+")) >= mintokens))
    return top(good, k)


def prompts(found: DataFrame, questions: DataFrame, template: str = "{question} {context}", separator: str = " ") -> DataFrame:
    """(qid, prompt): the texts of each question's context, best first, in a template."""
    order = F.struct(-F.col("score"), F.col("indexid"), F.col("text").alias("text"))
    joined = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), separator).alias("context"))
    rows = questions.join(joined, "qid", "left")
    return rows.select("qid", fill(template, {"question": F.col("question"), "context": F.col("context")}).alias("prompt"))


def answers(asked: DataFrame, model: Callable[[pd.Series], pd.Series], output: str = "default", found: DataFrame | None = None, encoder: Encoder | None = None) -> DataFrame:
    """What a model says to (qid, prompt[, name]), in Arrow batches.

    ``output``: ``default`` gives (qid, name, answer), ``flatten`` (qid, answer),
    ``reference`` (qid, name, answer, reference): the row of the context
    ``found`` (qid, indexid, text) that is most like the answer, by ``encoder``.
    A null prompt has a null answer; questions without context no reference.
    """

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        some = s.dropna()
        return pd.Series(model(some), index=some.index).reindex(s.index) if len(some) else s

    name = F.col("name") if "name" in asked.columns else F.col("qid").cast("string")
    said = asked.select("qid", name.alias("name"), run(F.col("prompt")).alias("answer"))
    if output == "flatten":
        return said.select("qid", "answer")
    if output == "default":
        return said
    if output != "reference":
        raise ValueError(f"unknown output: {output}")
    vector = lambda c: encode(F.col(c), encoder)
    near = said.where("answer is not null").select("qid", vector("answer").alias("a")).join(found.select("qid", "indexid", vector("text").alias("t")), "qid")
    best = near.groupBy("qid").agg(F.min_by("indexid", F.struct(-F.round(dot(F.col("a"), F.col("t")), 9), F.col("indexid"))).alias("reference"))
    return said.join(best, "qid", "left").select("qid", "name", "answer", "reference")


def rerank(candidates: DataFrame, score: Column, k: int = 3) -> DataFrame:
    """The best ``k`` of the candidates of a wider search by another score."""
    return top(candidates.withColumn("score", score), k)


def explain(rows: DataFrame, query: str, encoder: Encoder) -> DataFrame:
    """(indexid, pos, token, score): how much the similarity of (indexid, text) to the query owes to each token."""
    words = rows.select("indexid", F.split(F.trim("text"), r"\s+").alias("w"), "text")
    parts = words.select("indexid", "text", "w", F.posexplode("w").alias("pos", "token"))
    rest = F.array_join(F.filter("w", lambda _, i: i != F.col("pos")), " ")

    @F.pandas_udf(T.DoubleType())
    def similar(s: pd.Series) -> pd.Series:
        q = encoder(pd.Series([query]))[0]
        return pd.Series(encoder(s) @ q)

    return parts.select("indexid", F.col("pos").cast("long").alias("pos"), "token", (similar(F.col("text")) - F.abs(similar(rest))).alias("score"))


def apply_model(rows: DataFrame, column: str, model: Callable[[pd.Series], pd.Series], returns: T.DataType, out: str = "out") -> DataFrame:
    """Any model as an Arrow-batched function of a column: the place where inference plugs in."""

    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return model(s)

    return rows.withColumn(out, run(F.col(column)))


def labels(scores: Column, multilabel: bool | None = False, flatten: float | None = None) -> Column:
    """Scores of classes as (label, score), best first: softmax, sigmoid (``multilabel``) or as they are (None); ``flatten`` drops those under a limit."""
    pairs = F.transform(scores, lambda x, i: F.struct(i.cast("long").alias("label"), x.cast("double").alias("score")))
    if multilabel:
        pairs = F.transform(pairs, lambda x: F.struct(x["label"].alias("label"), (1 / (1 + F.exp(-x["score"]))).alias("score")))
    elif multilabel is False:
        most = F.array_max(scores).cast("double")
        total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - most))
        pairs = F.transform(pairs, lambda x: F.struct(x["label"].alias("label"), (F.exp(x["score"] - most) / total).alias("score")))
    ordered = F.array_sort(F.transform(pairs, lambda x: F.struct((-x["score"]).alias("minus"), x["label"].alias("label"))))
    out = F.transform(ordered, lambda x: F.struct(x["label"].alias("label"), (-x["minus"]).alias("score")))
    return F.filter(out, lambda x: x["score"] >= flatten) if flatten is not None else out


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, map, recall, precision) at ``k`` of (qid, indexid, score) against (qid, indexid, relevance)."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "indexid")
    rel = relevant.where("relevance > 0").select("qid", "indexid", "relevance")
    hits = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(rel, ["qid", "indexid"], "left").withColumn("rel", F.coalesce(F.col("relevance").cast("double"), F.lit(0.0)))
    good = (F.col("rel") > 0).cast("int")
    hits = hits.withColumn("seen", F.sum(good).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    gain = lambda r, at: r / F.log2(at + 1)
    got = hits.groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.sum(good).alias("hits"), F.sum(F.when(good == 1, F.col("seen") / F.col("rank")).otherwise(F.lit(0.0))).alias("ap"))
    ideal = rel.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "indexid")))
    best = ideal.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("relevance").cast("double"), F.col("rank")))).alias("idcg"), F.count(F.lit(1)).alias("n"))
    rows = best.join(got, "qid", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("qid", z(F.col("dcg") / F.col("idcg")).alias("ndcg"), z(F.col("ap") / F.least(F.col("n"), F.lit(k))).alias("map"), z(F.col("hits") / F.col("n")).alias("recall"), z(F.col("hits") / F.lit(float(k))).alias("precision"))
