"""Exact deduplication by two-pass Bloom filtering.

Pass one reads the text column only and sends one 64-bit hash per document to
the task that owns it. That task streams its hashes through a Bloom filter
sized for its share; a hash that is already in the filter may be a repeat and
is kept. Pass two tests every row, where it lies, against a second filter over
the kept hashes: rows that miss it are unique and never shuffle. The few rows
that hit it are compared exactly, by SHA-256.

Defined results: a null text equals no other text, and such rows all stay; an
empty text equals other empty texts. Of equal texts the row with the least
doc_id stays (a null doc_id counts as greater than any), and one row where even
doc_ids repeat. Empty tables give empty results. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import fresh, partitions, stage
from corvane.llm.words import U, mix

_PROBES = 4


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's bits for each hash; ``bits`` is a power of two."""
    a, b = mix(h), mix(h ^ U(0xA5A5A5A5A5A5A5A5)) | U(1)
    for i in range(_PROBES):
        yield ((a + U(i) * b) & U(bits - 1)).astype(np.int64)


def _bits(keys: float) -> int:
    """A filter size of 12 to 24 bits for each key."""
    return 1 << max(10, int(np.ceil(np.log2(12 * max(1.0, keys)))))


def _has(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _places(h, 8 * len(filled)):
        out &= (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _add(filled: np.ndarray, h: np.ndarray) -> None:
    for at in _places(h, 8 * len(filled)):
        np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))


def repeated_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pass one: a staged table of the hashes ``h`` of texts that may occur more than once."""
    hashes = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"))
    parts = partitions(docs.sparkSession)
    share = docs.count() / parts * 1.2 + 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_bits(share) // 8, np.uint8)
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(U), return_counts=True)
            again = h[(n > 1) | _has(seen, h)]
            _add(seen, h)
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64))], ["h"])

    kept = hashes.repartition(parts, "h").mapInArrow(run, T.StructType([T.StructField("h", T.LongType())]))
    return stage(kept.distinct(), "repeated")


def maybe_repeated(docs: DataFrame, text: str = "text", most: int = 16_000_000) -> tuple[DataFrame, str]:
    """Pass two: ``docs`` and a boolean column (whose name is returned) that is false only for unique texts.

    The filter is made on the driver and broadcast while there are at most
    ``most`` repeated hashes (two to four bytes each); beyond that the hashes
    are joined by a shuffle.
    """
    (flag,) = fresh(docs, "maybe_repeated")
    again = repeated_hashes(docs, text)
    if again.count() <= most:
        keys = again.toArrow().column(0).to_numpy().view(U)
        filled = np.zeros(_bits(len(keys)) // 8, np.uint8)
        _add(filled, keys)
        sent = docs.sparkSession.sparkContext.broadcast(filled)

        @F.pandas_udf(T.BooleanType())
        def test(h: pd.Series) -> pd.Series:
            return pd.Series(_has(sent.value, h.to_numpy().view(U)))

        return docs.withColumn(flag, F.col(text).isNotNull() & test(F.xxhash64(text))), flag
    h, one = fresh(docs, "text_hash", "repeated_one")
    again = again.select(F.col("h").alias(h), F.lit(True).alias(one))
    joined = docs.withColumn(h, F.xxhash64(text)).join(again, h, "left")
    return joined.select(*docs.columns, (F.col(text).isNotNull() & F.col(one).isNotNull()).alias(flag)), flag


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row (doc_id, kept_id, copies): the least doc_id with the same text and how many rows have that text."""
    rows, flag = maybe_repeated(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    alone = rows.where(~F.col(flag)).select("doc_id", F.col("doc_id").alias("kept_id"), F.lit(1).cast("long").alias("copies"))
    some = rows.where(flag).select("doc_id", _digest("text").alias("digest"))
    groups = some.groupBy("digest").agg(F.min("doc_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    return alone.unionByName(some.join(groups, "digest").select("doc_id", "kept_id", "copies"))


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each text; only rows that may have copies shuffle."""
    rows, flag = maybe_repeated(docs, text)
    first, digest, row = fresh(rows, "id_order", "digest", "row")
    some = rows.where(flag).select(_digest(text).alias(digest), F.struct(F.col(doc_id).isNull().alias(first), *(F.col(c) for c in docs.columns)).alias(row), F.col(doc_id).alias(first))
    kept = some.groupBy(digest).agg(F.min_by(row, F.struct(F.isnull(first), first)).alias(row))
    return rows.where(~F.col(flag)).select(*docs.columns).unionByName(kept.select(*(F.col(row)[c].alias(c) for c in docs.columns)))
