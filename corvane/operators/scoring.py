"""Keyword scoring: BM25, TF-IDF and SIF over a terms index of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.tokenize import alphanum
from corvane.sources.scratch import balanced, stage

Tokenizer = Callable[[Column], Column]


@dataclass
class Method:
    """A scoring method: ``idf`` of (documents, document frequency, corpus frequency, tokens); ``weight`` of (tf, idf, length, average length)."""

    idf: Callable[[Column, Column, Column, Column], Column]
    weight: Callable[[Column, Column, Column, Column], Column]


def bm25(k1: float = 1.2, b: float = 0.75) -> Method:
    return Method(lambda n, df, cf, t: F.log(1 + (n - df + 0.5) / (df + 0.5)), lambda tf, idf, dl, avg: idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avg)))


def tfidf() -> Method:
    return Method(lambda n, df, cf, t: F.log((n + 1) / (df + 1)) + 1, lambda tf, idf, dl, avg: idf * F.sqrt(tf) / F.sqrt(dl))


def sif(a: float = 1e-3) -> Method:
    return Method(lambda n, df, cf, t: F.lit(a) / (F.lit(a) + cf / t), lambda tf, idf, dl, avg: idf)


METHODS: dict[str, Callable[..., Method]] = {"bm25": bm25, "tfidf": tfidf, "sif": sif}


def _pattern(term: str) -> str:
    """A term with ``*`` as a pattern of LIKE."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


@dataclass
class Terms:
    """A terms index over ``tokens`` (indexid, tokens).

    ``stored`` holds it once it is built: postings (term, indexid, dl, tf) in
    order of term, term counts (term, df, cf) and totals. Without it every
    search splits the texts anew, once. Defined results: rows of null text
    aren't part of the index, empty texts count as documents without words; of
    an empty table all sums are 0 and no query finds anything.
    """

    tokens: DataFrame | None
    method: Method = field(default_factory=bm25)
    deleted: DataFrame | None = None
    stored: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, docs: DataFrame, indexid: str, text: str, method: Method | None = None, tokenizer: Tokenizer = alphanum) -> Terms:
        """The index of a table; rows with a null text aren't part of it."""
        rows = balanced(docs.where(F.col(text).isNotNull()).select(F.col(indexid).alias("indexid"), F.col(text).alias("text")))
        return cls(rows.select("indexid", tokenizer(F.col("text")).alias("tokens")), method or bm25())

    def build(self, path: str | None = None) -> Terms:
        """The index with its tables written, under ``path`` or as scratch tables; postings are sorted by term, so a search reads little of them."""
        if self.stored and path is None:
            return self
        spark = self.spark

        def write(df: DataFrame, name: str) -> DataFrame:
            if path is None:
                return stage(df, name)
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        posted = self.postings()
        posted = write(posted.repartitionByRange("term").sortWithinPartitions("term", "indexid"), "postings")
        counts = write(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "terms")
        return replace(self, stored={"postings": posted, "terms": counts, "stats": write(self.stats(), "stats")})

    @classmethod
    def load(cls, spark: SparkSession, path: str, method: Method | None = None) -> Terms:
        return cls(None, method or bm25(), stored={n: spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "stats")})

    @property
    def spark(self) -> SparkSession:
        return (self.tokens if self.tokens is not None else self.stored["postings"]).sparkSession

    def stats(self) -> DataFrame:
        """One row: total, tokens, avgdl (over all that was indexed; deleting doesn't change it)."""
        if self.stored:
            return self.stored["stats"]
        n = F.size("tokens").cast("long")
        return self.tokens.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("tokens")).withColumn("avgdl", F.col("tokens") / F.nullif(F.col("total"), F.lit(0)))

    def postings(self) -> DataFrame:
        """(term, indexid, dl, tf)."""
        if self.stored:
            return self.stored["postings"]
        rows = self.tokens.select("indexid", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        return rows.groupBy("term", "indexid", "dl").agg(F.count(F.lit(1)).alias("tf"))

    def _scored(self, counts: DataFrame, stats: DataFrame) -> DataFrame:
        idf = self.method.idf(F.col("total"), F.col("df"), F.col("cf"), F.col("tokens")).alias("idf")
        return counts.crossJoin(F.broadcast(stats)).select("term", "df", "cf", idf, "total", "avgdl")

    def terms(self) -> DataFrame:
        """(term, df, cf, idf)."""
        if self.stored:
            counts = self.stored["terms"]
        else:
            counts = self.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        return self._scored(counts, self.stats())

    def corpus(self) -> DataFrame:
        """One row with all corpus statistics, ``avgfreq``, ``avgidf`` and the average score among them."""
        one = self.terms().agg(F.count(F.lit(1)).alias("words"), F.avg("idf").alias("avgidf")).crossJoin(self.stats())
        freq = F.col("tokens") / F.col("words")
        return one.withColumn("avgfreq", freq).withColumn("avgscore", self.method.weight(freq, F.col("avgidf"), F.col("avgdl"), F.col("avgdl")))

    def _matched(self, exact: list[str], likes: list[str]) -> tuple[DataFrame, DataFrame]:
        """(postings, term counts with idf) of the terms that queries ask for."""

        def keep(x: Column) -> Column:
            out = x.isin(exact)
            for p in likes:
                out = out | x.like(p)
            return out

        if self.stored:
            return self.stored["postings"].where(keep(F.col("term"))), self._scored(self.stored["terms"].where(keep(F.col("term"))), self.stats())
        # One pass over the texts leaves the length of each document and the words that some query has.
        rows = stage(self.tokens.select("indexid", F.size("tokens").alias("dl"), F.filter("tokens", keep).alias("kept")), "matched_words")
        stats = rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens")).withColumn("avgdl", F.col("tokens") / F.nullif(F.col("total"), F.lit(0)))
        postings = rows.select("indexid", "dl", F.explode("kept").alias("term")).groupBy("term", "indexid", "dl").agg(F.count(F.lit(1)).alias("tf"))
        return postings, self._scored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), stats)

    def search(self, queries: list[str], k: int | None, tokenizer: Tokenizer = alphanum, cutoff: float | None = None) -> DataFrame:
        """(qid, indexid, score): the best ``k`` documents for each query, greatest score first, then least indexid.

        A term with ``*`` stands for all terms of that pattern. Terms are
        dropped before they are counted unless a query has them, so only those
        reach a shuffle. With ``cutoff``, terms in more than that share of the
        documents don't find documents by themselves unless no other term does.
        """
        spark = self.spark
        rows = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
        star = lambda q: F.filter(F.split(F.lower(q), r"\s+"), lambda x: x.contains("*"))
        plain = lambda q: tokenizer(F.regexp_replace(q, r"\S*\*\S*", " "))
        words = rows.select("qid", plain(F.col("query")).alias("plain"), star(F.col("query")).alias("star")).collect()
        asked = [(r["qid"], t) for r in words for t in r["plain"] or []]
        wild = [(r["qid"], _pattern(t)) for r in words for t in r["star"] or []]
        likes = sorted({p for _, p in wild})
        postings, found = self._matched(sorted({t for _, t in asked}), likes)
        # As many rows as the queries have words: exact terms by an equi-join, patterns against the distinct terms only.
        names = found.join(F.broadcast(spark.createDataFrame(asked, "qid int, term string")), "term").select("qid", *found.columns)
        if likes:
            patterns = F.broadcast(spark.createDataFrame(wild, "qid int, pattern string"))
            names = names.unionByName(found.join(patterns, F.expr("term like pattern")).select("qid", *found.columns))
        weights = names.groupBy("qid", "term", "df", "cf", "idf", "total", "avgdl").agg(F.count(F.lit(1)).alias("n"))
        # Without wildcards there are as many as the queries have words; a wildcard may stand for any number.
        hits = postings.join(weights if likes else F.broadcast(weights), "term")
        if self.deleted is not None:
            hits = hits.join(self.deleted.select("indexid"), "indexid", "left_anti")
        score = self.method.weight(F.col("tf"), F.col("idf"), F.col("dl"), F.col("avgdl")) * F.col("n")
        rare = F.col("df") <= F.lit(cutoff) * F.col("total") if cutoff is not None else F.lit(True)
        sums = hits.groupBy("qid", "indexid").agg(F.sum(score).alias("score"), F.max(rare.cast("int")).alias("rare"))
        if cutoff is not None:
            any_rare = sums.groupBy("qid").agg(F.max("rare").alias("any"))
            sums = sums.join(F.broadcast(any_rare), "qid").where("rare = any")  # a row for each query
        return top(sums.select("qid", "indexid", "score"), k)

    def weights(self, tag_counts: DataFrame | None = None) -> DataFrame:
        """(indexid, pos, token, weight) of every token; tokens that are tags are lifted towards the document's greatest weight."""
        rows = self.tokens.select("indexid", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "token"))
        same = Window.partitionBy("indexid", "token")
        rows = rows.withColumn("tf", F.count(F.lit(1)).over(same))
        rows = rows.join(self.terms().withColumnRenamed("term", "token"), "token")
        rows = rows.withColumn("weight", self.method.weight(F.col("tf"), F.col("idf"), F.col("dl"), F.col("avgdl")))
        if tag_counts is not None:
            doc = Window.partitionBy("indexid")
            rows = rows.join(F.broadcast(tag_counts.select(F.col("tag").alias("token"), F.col("n").alias("tag_n"))), "token", "left")
            rows = rows.withColumn("weight", F.when(F.col("tag_n").isNotNull(), F.greatest("weight", F.max("weight").over(doc) * F.col("tag_n") / F.max("tag_n").over(doc))).otherwise(F.col("weight")))
        return rows.select("indexid", "pos", "token", "weight")


def tag_counts(docs: DataFrame, tags: str, floor: float = 0.005) -> DataFrame:
    """(tag, n) of space-separated tags that at least ``floor`` of the documents have."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    counts = docs.select(F.explode(F.split(F.col(tags), r"\s+")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * floor).select("tag", "n")


def top(scores: DataFrame, k: int | None, by: str = "qid", row: str = "indexid") -> DataFrame:
    """The best ``k`` rows for each query; scores equal to 9 digits are ties, which the row's id decides. None keeps all."""
    if k is None:
        return scores
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), row)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def normalise(scores: DataFrame, average: DataFrame) -> DataFrame:
    """Scores over the lesser of (greatest + average) and six times the average, at most 1. ``average``: one row ``avgscore``."""
    most = F.max("score").over(Window.partitionBy("qid"))
    limit = F.least(most + F.col("avgscore"), 6 * F.col("avgscore"))
    return scores.withColumn("most", most).crossJoin(F.broadcast(average)).withColumn("score", F.least(F.col("score") / limit, F.lit(1.0))).drop("most", "avgscore")


def bayes(scores: DataFrame, alpha: float = 1.0, beta: float | None = None) -> DataFrame:
    """Sigmoid of scores about their median, steeper the closer they lie; over positive scores."""
    w = Window.partitionBy("qid")
    rows = scores.where("score > 0").withColumn("sd", F.stddev_pop("score").over(w))
    rows = rows.withColumn("mid", F.lit(float(beta)) if beta is not None else F.median("score").over(w))
    slope = F.when(F.col("sd") > 0, F.lit(alpha) / F.col("sd")).otherwise(F.lit(alpha))
    x = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), slope * (F.col("score") - F.col("mid"))))
    return rows.withColumn("score", 1 / (1 + F.exp(-x))).drop("sd", "mid")
