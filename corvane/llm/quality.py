"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document becomes ``FEATURES``: shares of kinds of bytes and figures about its
words, from one byte histogram and one pass over the hashed words of a batch.
The trees are fitted on the driver to at most ``most`` labelled documents (the
least by hash of their id, whatever the corpus holds) and flattened into arrays;
scoring moves all rows of a batch down a tree at once, in the scan.

Defined results: null and empty texts have all features 0 and are scored like
any other. Rows with a null doc_id are scored; labels with a null id or class
are not used; a document labelled twice counts for each label. Without labels
of both classes every score is the smoothed prior. Empty tables give empty
results. Further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.gbdt import Forest, fit
from corvane.llm.shared import id_type, map_text, slices, strings
from corvane.llm.words import doc_of, words

FEATURES = "log_bytes letters upper digits spaces newlines stops commas bangs symbols bars quotes other_punct high log_words word_length word_length_sd long_words distinct top_word echoes distinct_pairs entropy".split()
THRESHOLD = 0.5
_KINDS = np.zeros((256, 13))
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".?;:", ",", "!", "#$%&*+=^~@<>\\/_", "|", "\"'`()[]{}", "-")):
    _KINDS[[ord(c) for c in _chars], _i] = 1
_KINDS[128:, 12] = 1


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    raw = strings(texts)
    n = len(raw)
    out = np.zeros((n, len(FEATURES)))
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[: n + 1]
    size = np.diff(offsets)
    if not size.sum():
        return out
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    key = np.repeat((np.arange(n) * 256).astype(np.int32), size) + data
    counts = np.bincount(key, minlength=256 * n).reshape(n, 256)
    some = np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    out[:, 1:14] = counts @ _KINDS / some
    p = counts / some
    out[:, 22] = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    w = words(raw)
    k = np.diff(w.offsets)
    doc = doc_of(w.offsets)
    per = np.maximum(k, 1)
    length = w.length.astype(float)
    total = lambda x: np.bincount(doc, x, n)
    mean = total(length) / per
    out[:, 14] = np.log1p(k)
    out[:, 15] = mean
    out[:, 16] = np.sqrt(np.maximum(total(length**2) / per - mean**2, 0))
    out[:, 17] = total((length > 12).astype(float)) / per

    def groups(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the documents in ``of``: distinct hashes, and the share of the most frequent."""
        if not len(of):
            return np.zeros(n), np.zeros(n)
        short = (of.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
        short.sort()
        first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
        runs, owner = np.diff(np.r_[first, len(short)]), (short[first] >> np.uint64(44)).astype(np.int64)
        top = np.zeros(n)
        np.maximum.at(top, owner, runs)
        return np.bincount(owner, minlength=n), top

    distinct, top = groups(w.hash, doc)
    out[:, 18], out[:, 19] = distinct / per, top / per
    if len(doc) > 1:
        inside = doc[1:] == doc[:-1]
        out[:, 20] = np.bincount(doc[1:][inside & (w.hash[1:] == w.hash[:-1])], minlength=n) / per
        pair = (w.hash[:-1] * np.uint64(3) + w.hash[1:] * np.uint64(0x9E3779B97F4A7C15))[inside]
        out[:, 21] = groups(pair, doc[1:][inside])[0] / np.maximum(k - 1, 1)
    return out


def labelled_features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of at most ``most`` labelled documents."""
    some = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "label").limit(most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("doc_id", id_type(docs, doc_id))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(features(batch.column(2)))), batch.column(0)], schema.names)

    got = map_text(rows, "text", schema, run).toPandas().sort_values(["doc_id", "label"], kind="stable")
    return np.array(got.x.tolist(), float).reshape(len(got), len(FEATURES)), got.label.to_numpy()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 12_000) -> Forest:
    """A forest for P(label is 1), from at most ``most`` labelled documents."""
    x, y = labelled_features(docs, labels, doc_id, text, label, most)
    return fit(x, y > 0)


def _batched(column: pa.Array, forest: Forest) -> np.ndarray:
    parts = slices(pa.RecordBatch.from_arrays([column], ["text"]), "text")
    return np.concatenate([np.empty(0), *(forest.probability(features(p.column(0))) for p in parts)])


def score(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([T.StructField("doc_id", id_type(docs, doc_id)), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = sent.value.probability(features(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pc.greater_equal(pa.array(p), threshold)], schema.names)

    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", schema, run)


def keep_good(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf(T.BooleanType())
    def good(column: pa.Array) -> pa.Array:
        return pa.array(_batched(column, sent.value) >= threshold)

    return docs.where(good(F.col(text)))
