"""Token sequences cut or packed to the length of a model's window.

Defined results: rows with null or no tokens add nothing; ties of the order keep
rows apart only by their tokens; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.content import numbered
from corvane.sources.scratch import stage


def concat(rows: DataFrame, order: str, length: int, tokens: str = "tokens") -> DataFrame:
    """(chunk, tokens): all tokens in the order of a column as one stream, cut every ``length``; a last chunk that is short is dropped unless it is the only one.

    Each row learns its place in the stream from running sums: one number for a
    partition, then inside of it. Rows are cut where they lie, and only pieces
    of a chunk meet.
    """
    part = "__part"
    rows = rows.where(F.size(tokens) > 0).select(F.col(order).alias("o"), F.col(tokens).alias("t"))
    rows = stage(rows.repartitionByRange("o").sortWithinPartitions("o", "t").withColumn(part, F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "stream")
    sizes = rows.groupBy(part).agg(F.sum(F.size("t")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    inside = F.sum(F.size("t")).over(Window.partitionBy(part).orderBy("row")) - F.size("t")
    placed = rows.join(F.broadcast(sizes.select(part, before.alias("before"))), part).select("t", (F.col("before") + inside).cast("long").alias("at"))
    last = F.floor((F.col("at") + F.size("t") - 1) / length)
    pieces = placed.select("t", "at", F.explode(F.sequence(F.floor(F.col("at") / length), last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * length - F.col("at"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk") + 1) * length - F.col("at"), F.size("t").cast("long")).cast("int")
    pieces = pieces.select("chunk", "at", F.slice("t", lo + 1, hi - lo).alias("t"))
    chunks = pieces.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"])).alias("tokens"))
    return chunks.where((F.size("tokens") == length) | (F.col("chunk") == 0))


def pack(rows: DataFrame, order: str, length: int, tokens: str = "tokens", batch: int = 1000) -> DataFrame:
    """(batch, chunk, tokens): whole rows put together, longest first, into chunks of less than ``length`` where rows allow; none is split.

    As trainers do it, rows are packed in batches of ``batch`` in the order of a column, so batches run apart.
    """
    kept = rows.where(F.size(tokens) > 0).select(F.col(order).alias("o"), F.col(tokens).alias("t"))
    kept = numbered(kept, "o", name="n", ties=("t",)).select(F.floor(F.col("n") / batch).alias("batch"), "n", "t")
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("tokens", kept.schema["t"].dataType)])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [list(t) for t in rows.sort_values("n", kind="stable").t]
        return pd.DataFrame([(key[0], i, chunk) for i, chunk in enumerate(packed(found, length))], columns=schema.names)

    return kept.groupBy("batch").applyInPandas(run, schema)


def packed(rows: list[list], length: int) -> Iterator[list]:
    """Rows, longest first, put together until the next one would reach ``length``."""
    rows, held = sorted(rows, key=len, reverse=True), []
    for i, row in enumerate(rows):
        held += row
        if len(held) + (len(rows[i + 1]) if i + 1 < len(rows) else 0) >= length:
            yield held
            held = []
    if held:
        yield held
