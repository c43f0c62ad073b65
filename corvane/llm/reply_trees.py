"""Chat formatting from reply trees.

Messages of a conversation form a tree: a message answers its parent. Iterative
self-joins give every message a stretch of ancestors, twice as long in each
round (up to 64), then climb from every leaf to its root by stretches; that
gives all root-to-leaf paths. Each path (branch) has a score; the best
``branches`` of a conversation are formatted, each as one conversation.

With a column of message ids, a parent is the id of a message of the same
conversation, else the number of a turn, whose first message (by text, then
role) is meant. Without a parent column, a message answers the first message of
the latest earlier turn, so a plain list of turns is one path, and rows that
share a turn are siblings.

The score of a branch is the sum of the score column over its messages; without
one, the number of its messages, then its characters. Ties go to the branch
whose turns, roles and texts come first.

Defined results: rows with a null conversation or turn are left out. A null role
counts as ``user`` and a null text as empty. Rows equal in conversation, turn,
role, text (and id, parent and score) count once; of messages that share an id
the first is the one that others answer. A message can only answer one that
comes before it by turn, then text, then role: a link to a later one, to itself
or to one that is missing is cut, so cycles end, and it starts a tree of its
own. Empty tables give empty results. Further columns don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import release, shared_dir, stage


def messages(turns: DataFrame, parent: str | None = None, score: str | None = None, message: str | None = None) -> DataFrame:
    """(conv_id, node, parent, turn, role, text, score): nodes are numbered in a conversation by turn, text and role."""
    given = lambda c, kind: (F.col(c).cast(kind) if c else F.lit(None).cast(kind))
    rows = turns.where("conv_id is not null and turn is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        given(parent, "string" if message else "long").alias("answers"), given(score, "double").alias("score"), given(message, "string").alias("message"),
    ).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "text", "role", "answers", "score", "message")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    if parent:
        heads = rows.groupBy("conv_id", F.col("message" if message else "turn").alias("answers")).agg(F.min("node").alias("parent")).where("answers is not null")
        rows = rows.join(heads, ["conv_id", "answers"], "left").withColumn("parent", F.expr("if(parent >= node, null, parent)"))
    else:
        rows = rows.withColumn("first", F.min("node").over(Window.partitionBy("conv_id", "turn")))
        earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("parent", F.max("first").over(earlier))
    return rows.select("conv_id", "node", "parent", "turn", "role", "text", "score")


def paths(nodes: DataFrame, doublings: int = 6) -> DataFrame:
    """(conv_id, leaf, path): for each leaf the nodes from its root to it.

    ``nodes`` must be staged. First every node learns its nearest ancestors, by
    joining the nodes' stretches with those above them; each round makes them
    twice as long, until all have reached a root or after ``doublings``, so
    their size stays bounded. Then the leaves climb, a stretch in each round.
    Rounds write to the shared folder, and the one before is deleted; finished
    paths are appended to one table, which is read once.
    """
    spark, schema = nodes.sparkSession, nodes.schema
    up = nodes.select("conv_id", "node", F.array("node").alias("path"), F.col("parent").alias("next"))
    for _ in range(doublings):
        above = up.select("conv_id", F.col("node").alias("next"), F.col("path").alias("higher"), F.col("next").alias("after"))
        longer = F.when(F.col("higher").isNull(), F.col("path")).otherwise(F.concat("higher", "path"))
        before, up = up, stage(up.join(above, ["conv_id", "next"], "left").select("conv_id", "node", longer.alias("path"), F.col("after").alias("next")), "stretches")
        release(before)
        if up.where("next is not null").isEmpty():
            break
    inner = nodes.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    open_ = up.join(inner, ["conv_id", "node"], "left_anti").withColumnRenamed("node", "leaf")
    above = up.select("conv_id", F.col("node").alias("next"), F.col("path").alias("higher"), F.col("next").alias("after"))
    done = f"{shared_dir(spark)}/ended-{uuid.uuid4().hex}"
    while True:
        before, open_ = open_, stage(open_, "paths")
        release(before)
        open_.where("next is null").select("conv_id", "leaf", "path").write.mode("append").parquet(done)
        if open_.where("next is not null").isEmpty():
            kind = T.StructType([schema["conv_id"], T.StructField("leaf", T.LongType()), T.StructField("path", T.ArrayType(T.LongType()))])
            return spark.read.schema(kind).parquet(done)
        held, open_ = open_, open_.where("next is not null").join(above, ["conv_id", "next"]).select("conv_id", "leaf", F.concat("higher", "path").alias("path"), F.col("after").alias("next"))
        open_._scratch = held._scratch  # goes when its successor has been written


def conversations(turns: DataFrame, branches: int = 1, parent: str | None = None, score: str | None = None, message: str | None = None) -> DataFrame:
    """(conv_id, branch, n_messages, score, text): the best branches of each conversation, as one text each."""
    nodes = stage(messages(turns, parent, score, message), "messages")
    steps = paths(nodes).select("conv_id", "leaf", F.posexplode("path").alias("step", "node"))
    said = F.struct("step", "turn", "role", "text").alias("message")
    rows = steps.join(nodes, ["conv_id", "node"]).select("conv_id", "leaf", "score", said)
    branch = rows.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list("message")).alias("m"), F.sum("score").alias("given"))
    size = F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    branch = branch.withColumn("n_messages", F.size("m").cast("long")).withColumn("chars", size)
    total = F.coalesce("given", F.col("n_messages").cast("double")).alias("score")
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("chars"), "m")
    text = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n<|end|>\n"))), "")
    ranked = branch.select("conv_id", "n_messages", "chars", "m", total).withColumn("branch", F.row_number().over(best).cast("long"))
    return ranked.where(F.col("branch") <= branches).select("conv_id", "branch", "n_messages", "score", text.alias("text"))
