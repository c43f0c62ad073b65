"""URL filtering by association rules.

A URL becomes a set of items: its host, the labels of the host, the words of
its path, the names of its query, its scheme. Spark's FP-growth mines the item
sets that occur often in the URLs of bad pages; they are then counted over all
labelled pages. A rule ``items -> bad`` is kept if its support and its confidence
(the lower end of a Wilson interval too, against luck in small counts) are high
enough and no rule over a part of its items is as confident.

What can't end in a rule doesn't reach FP-growth, so that few sets are mined and
none that matters is lost, however long: items too rare among bad pages or on
every page; items that only bad pages have (they are rules, and no longer set
with them can be more confident); and all but one of items that always occur
together (a set with two of them has a part that is as confident; rules are
written out for each of them afterwards). FP-growth lists all subsets that recur,
so URLs that still have more than ``WIDTH`` items are mined level by level
instead: a set grows only while each item cuts down the pages that have it, and
while it isn't certain. That finds the same rules.

Rules are tables. They are matched by inverted index: a rule stands under its
items and fires when all of them have been seen in a URL. Up to ``most`` rules
are broadcast, and nothing shuffles when pages are judged; more are joined.

The labels of this corpus are given by document number. A page is taken to be
the document of its own number, as no table names labels of pages (``label_id``
says which column of the labels matches ``page_id``).

Defined results: null and empty URLs have no items and are never rejected.
Labels with a null id or both classes null are not used; a page is bad if any of
its labels says so; labels without a page are ignored. Without labels no rule
is found. Null ids and repeated rows give a row each. Empty tables give empty
results. Further columns don't matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import stage

SUPPORT, CONFIDENCE, LEAST = 0.0002, 0.5, 5
#: Most uncertain items of a URL that FP-growth gets.
WIDTH = 16
_RULES = "items array<string>, bad long, confidence double"


def items(url: Column) -> Column:
    """The sorted set of items of a URL: ``d:`` host, ``h:`` label of the host, ``p:`` word of the path, ``q:`` name in the query, ``s:`` scheme."""
    low = F.lower(F.coalesce(url, F.lit("")))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag + ":"), x))

    found = F.concat(
        tagged("s", F.array(scheme)), tagged("d", F.array(host)), tagged("h", F.split(host, r"[^\p{L}\p{N}]+")), tagged("p", F.split(path, r"[^\p{L}\p{N}]+")),
        tagged("q", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))),
    )
    return F.array_sort(F.array_distinct(found))


def _wilson(hits: Column, n: Column, z: float = 1.64) -> Column:
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _containing(sets: DataFrame, baskets: DataFrame, items: str) -> DataFrame:
    """Pairs of ``sets`` (set, head) and rows of ``baskets`` whose array ``items`` holds all of a set; each set is sought under one item, its ``head``."""
    at = baskets.withColumn("head", F.explode(items))
    return at.join(sets, "head").where(F.size(F.array_except("set", items)) == 0).drop("head")


def _counted(sets: DataFrame, classed: DataFrame, single: DataFrame) -> DataFrame:
    """``sets`` (set, ...) with the pages ``n`` and the bad pages ``bad`` that have them; sought under their rarest item."""
    rare = single.select("class", F.col("n").alias("of"))
    heads = sets.withColumn("class", F.explode("set")).join(rare, "class").groupBy(*sets.columns).agg(F.min_by("class", F.struct("of", "class")).alias("head"))
    return _containing(heads, classed, "items").groupBy(*sets.columns).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _grown(wide: DataFrame, classed: DataFrame, single: DataFrame, need: float) -> DataFrame:
    """(set, n, bad) of the sets of two items or more that URLs of ``wide`` (url, items) have and that can make a rule."""
    level = single.where("bad < n").select(F.array("class").alias("set"), "n", "bad")
    out = level.where("false")
    while True:
        held = _containing(level.select("set", F.col("n").alias("of"), F.element_at("set", 1).alias("head")), wide, "items").select("url", F.slice("set", 1, F.size("set") - 1).alias("start"), F.element_at("set", -1).alias("last"), "of")
        other = held.select("url", "start", F.col("last").alias("next"), F.col("of").alias("of_next"))
        longer = held.join(other, ["url", "start"]).where("last < next").groupBy(F.concat("start", F.array("last", "next")).alias("set")).agg(F.min(F.least("of", "of_next")).alias("under"))
        level = stage(_counted(longer, classed, single).where((F.col("bad") >= need) & (F.col("n") < F.col("under"))).select("set", "n", "bad"), "item_sets")
        if level.isEmpty():
            return out
        out, level = out.unionByName(level), level.where("bad < n")


def mine(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", bad: Column | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """The pruned rules (items, bad, confidence), staged; ``bad``: how many bad pages a rule has.

    ``bad`` is the condition on ``labels`` for a bad page; without it, low
    quality or toxic. A rule needs ``support`` of the labelled pages and
    ``least`` bad pages.
    """
    spark = pages.sparkSession
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    marks = labels.select(F.col(label_id).alias("page_id"), bad.cast("int").alias("bad")).where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select(F.col(page_id).alias("page_id"), items(F.col(url)).alias("items")).where(F.size("items") > 0).join(marks, "page_id")
    baskets = stage(rows.select("items", "bad", F.expr("uuid()").alias("row")), "baskets")
    total, wrong = baskets.agg(F.count(F.lit(1)), F.sum("bad")).first()
    if not wrong:
        return spark.createDataFrame([], _RULES)
    need = max(support * total, least)
    every = baskets.select(F.explode("items").alias("item"), "bad", F.xxhash64("row").alias("h")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("y"))
    useful = every.where((F.col("bad") >= need) & (F.col("n") < total))
    # Items of exactly the same pages are one class, which has the least of them as its name.
    single = stage(useful.groupBy("n", "bad", "x", "y").agg(F.min("item").alias("class"), F.collect_list("item").alias("members")).select("class", "members", "n", "bad"), "item_classes")
    unsure = single.where("bad < n").select(F.col("class").alias("item"))
    classed = baskets.select("row", "bad", F.explode("items").alias("item")).join(unsure, "item").groupBy("row", "bad").agg(F.array_sort(F.collect_list("item")).alias("items"))
    classed = stage(classed.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "classed")
    several = classed.where("bad > 0 and size(items) > 1")
    left = several.where(F.size("items") <= WIDTH).agg(F.sum("bad")).first()[0] or 0
    rules = single.select(F.array("class").alias("set"), "n", "bad")
    if left >= need:
        # A row for each bad page; sets that wide URLs have too are counted anew below.
        narrow = several.where(F.size("items") <= WIDTH).select(F.explode(F.array_repeat("items", F.col("bad").cast("int"))).alias("items"))
        mined = FPGrowth(itemsCol="items", minSupport=need / left).fit(narrow).freqItemsets.where(F.size("items") > 1)
        rules = rules.unionByName(_counted(stage(mined.select(F.array_sort("items").alias("set")), "item_sets"), classed, single).select("set", "n", "bad"))
    wide = several.where(F.size("items") > WIDTH)
    if not wide.isEmpty():
        rules = rules.unionByName(_grown(stage(wide.select("items", F.expr("uuid()").alias("url")), "wide"), classed, single, need)).distinct()
    sure = F.col("bad") / F.col("n")
    passing = stage(rules.where((sure >= confidence) & (_wilson(F.col("bad"), F.col("n")) > wrong / total)).select("set", "bad", sure.alias("confidence")), "passing_rules")
    parts = passing.select("set", F.element_at("set", 1).alias("head"), F.col("confidence").alias("of_part"))
    whole = passing.where(F.size("set") > 1).select(F.col("set").alias("whole"), "confidence")
    weak = _containing(parts, whole, "whole").where((F.size("set") < F.size("whole")) & (F.col("of_part") >= F.col("confidence"))).select(F.col("whole").alias("set")).distinct()
    kept = passing.join(weak, "set", "left_anti").select("set", "bad", "confidence", F.posexplode("set").alias("at", "class")).join(single.select("class", "members"), "class")
    choices = kept.groupBy("set", "bad", "confidence").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "members"))), lambda x: x["members"]).alias("choices"))
    product = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda out, more: F.flatten(F.transform(out, lambda x: F.transform(more, lambda m: F.concat(x, F.array(m))))))
    return stage(choices.select(F.explode(product).alias("x"), "bad", "confidence").select(F.array_sort("x").alias("items"), "bad", "confidence"), "rules")


Rules = list[tuple[tuple[str, ...], int, float]]


def listed(rules: DataFrame) -> Rules:
    """Rules on the driver: the most confident first, then those of most bad pages, the shortest, the first by items."""
    found = [(tuple(r["items"]), r["bad"], r["confidence"]) for r in rules.collect()]
    return sorted(found, key=lambda r: (-r[2], -r[1], len(r[0]), r[0]))


def index(rules: Rules) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, (found, *_) in enumerate(rules):
        for x in found:
            out.setdefault(x, []).append(i)
    return out


def fires(found: list[str], rules: Rules, under: dict[str, list[int]]) -> int | None:
    """The first rule all of whose items are in ``found``."""
    seen: dict[int, int] = {}
    for x in found:
        for i in under.get(x, ()):
            seen[i] = seen.get(i, 0) + 1
    return min((i for i, n in seen.items() if n == len(rules[i][0])), default=None)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", most: int = 100_000) -> DataFrame:
    """(page_id, url, rejected, rule, confidence) for each row; ``rule``: the items of the first rule (see ``listed``) that fires."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    if rules.count() <= most:
        found = listed(rules)
        sent = pages.sparkSession.sparkContext.broadcast((found, index(found)))
        kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("confidence", T.DoubleType())])

        @F.arrow_udf(kind)
        def match(column: pa.Array) -> pa.Array:
            rules, under = sent.value
            hits = [fires(x, rules, under) for x in column.to_pylist()]
            names = pa.array([None if i is None else " ".join(rules[i][0]) for i in hits], pa.string())
            return pa.StructArray.from_arrays([names, pa.array([None if i is None else rules[i][2] for i in hits], pa.float64())], ["rule", "confidence"])

        rows = rows.select("page_id", "url", match(items(F.col("url"))).alias("hit")).select("page_id", "url", "hit.rule", "hit.confidence")
    else:
        # Rules stand under their rarest item; equal URLs are judged once, by those of their items that rules have.
        of = rules.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("of"))
        heads = rules.select(F.col("items").alias("set"), "bad", "confidence", F.explode("items").alias("item")).join(of, "item").groupBy("set", "bad", "confidence").agg(F.min_by("item", F.struct("of", "item")).alias("head"))
        urls = stage(rows.where("url is not null").select("url").distinct().withColumn("key", F.expr("uuid()")), "urls")
        known = urls.select("key", F.explode(items(F.col("url"))).alias("item")).join(of, "item", "left_semi").groupBy("key").agg(F.collect_list("item").alias("found"))
        order = F.struct(-F.col("confidence"), -F.col("bad"), F.size("set"), F.col("set"))
        hits = _containing(heads, known, "found").groupBy("key").agg(F.min_by(F.struct(F.array_join("set", " ").alias("rule"), "confidence"), order).alias("hit"))
        rows = rows.join(hits.join(urls, "key").select("url", "hit"), "url", "left").select("page_id", "url", "hit.rule", "hit.confidence")
    return rows.select("page_id", "url", F.col("rule").isNotNull().alias("rejected"), "rule", "confidence")
