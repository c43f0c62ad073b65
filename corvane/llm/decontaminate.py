"""Benchmark decontamination by winnowing.

Texts become hashed words (see ``words``). Of every ``WINDOW`` consecutive
k-grams the last least hash is a fingerprint, so any span that a document shares
with a test item and that has at least ``K + WINDOW - 1`` words holds a common
fingerprint at the same place of both. Fingerprints of documents and test items
are joined; each hit is extended along its diagonal as far as both texts agree,
and spans of the guaranteed length are kept. The result is then exactly the set
of maximal shared spans of that length.

Documents first pass a sieve where they lie: a bitmap of the test fingerprints,
at most 2^``SIEVE`` bits whatever the test set's size. Only documents that hit it
(and their words) take part in the join; nothing else shuffles.

Where a text repeats itself within ``K`` words, its fingerprints form chains; of
two chains of one step only hits with the head of either are followed, since the
others lie on the same spans. So repetitive texts cost the sum of their lengths.

Defined results: null and empty texts on either side share nothing. A null
doc_id or item_id is carried along. Repeated rows on either side give repeated
spans. Empty tables give empty results. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import anti_by_id, fresh, id_type, map_text, stage
from corvane.llm.words import U, gram_starts, grams, mix, words

K, WINDOW = 8, 6
LEAST = K + WINDOW - 1
#: The sieve has up to 2^29 bits (64 MB), 64 for each fingerprint while that suffices.
SIEVE, PROBES = 29, 4
_GAP = U(15)  # low bits of a fingerprint's key say how far back the text has the same one


def fingerprints(hashes: np.ndarray, offsets: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the last least k-gram of each window. Windows over the border of two texts only add some."""
    g = grams(hashes, k)
    if not len(g):
        return np.empty(0, np.int64), np.empty(0, U)
    ok = gram_starts(offsets, k)[: len(g)]
    top = ~U(0)
    low = np.where(ok, g & ~_GAP, top)
    n = len(low)
    pad = np.full(window - 1, top)
    wide = np.concatenate([pad, low, pad])
    reach = np.zeros(n, np.int8)
    for step, fits in ((-1, np.greater_equal), (1, np.greater)):
        on = np.ones(n, bool)
        for j in range(1, window):
            at = window - 1 + step * j
            on &= fits(wide[at : at + n], low)
            reach += on
    at = np.flatnonzero(ok & (reach >= window - 1))
    return at, low[at]


def keyed(at: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Fingerprints with the distance to the one before of the same hash in the same text, if that is at most ``K``."""
    order = np.lexsort((at, hashes, text))
    step = np.diff(at[order])
    chained = (np.diff(text[order]) == 0) & (hashes[order][1:] == hashes[order][:-1]) & (step <= K)
    gap = np.zeros(len(at), U)
    gap[order[1:][chained]] = step[chained].astype(U)
    return hashes | gap


@dataclass
class TestSet:
    """Keys of fingerprints in order, each with its item and place, and all items' words."""

    key: np.ndarray
    item: np.ndarray
    at: np.ndarray
    words: np.ndarray
    offsets: np.ndarray


def test_set(hashes: np.ndarray, offsets: np.ndarray) -> TestSet:
    at, h = fingerprints(hashes, offsets)
    item = np.searchsorted(offsets, at, "right") - 1
    key = keyed(at, h, item)
    order = np.argsort(key, kind="stable")
    return TestSet(key[order], item[order], at[order], hashes, offsets)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two runs have in common at their start."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + size)] != b[at : min(n, at + size)])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, size * 4
    return n


def spans(hashes: np.ndarray, offsets: np.ndarray, tests: TestSet) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start in the row's words, start in the item's words, words) of each maximal shared span."""
    at, h = fingerprints(hashes, offsets)
    row = np.searchsorted(offsets, at, "right") - 1
    lo, hi = np.searchsorted(tests.key, h, "left"), np.searchsorted(tests.key, h | _GAP, "right")
    some = np.flatnonzero(hi > lo)
    at, h, row, lo, hi = at[some], h[some], row[some], lo[some], hi[some]
    key = keyed(at, h, row)
    chained = key != h
    skip, on = np.where(chained, np.searchsorted(tests.key, key, "left"), hi), np.where(chained, np.searchsorted(tests.key, key, "right"), hi)
    out: list[tuple[int, int, int, int, int]] = []
    reached: dict[tuple[int, int, int], int] = {}
    for i, place in enumerate(at.tolist()):
        first, last = int(offsets[row[i]]), int(offsets[row[i] + 1])
        for j in (*range(lo[i], skip[i]), *range(on[i], hi[i])):
            item, there = int(tests.item[j]), int(tests.at[j])
            diagonal = (int(row[i]), item, place - there)
            if reached.get(diagonal, -1) > place:
                continue
            a, b = int(tests.offsets[item]), int(tests.offsets[item + 1])
            back = _agree(hashes[max(first, place - (there - a)) : place][::-1], tests.words[a:there][::-1])
            ahead = _agree(hashes[place : min(last, place + b - there)], tests.words[there:b])
            reached[diagonal] = place + ahead
            if back + ahead >= LEAST:
                out.append((int(row[i]), item, place - back - first, there - back - a, back + ahead))
    return out


def _prints(rows: DataFrame, key: str, sieve: Broadcast | None = None) -> DataFrame:
    """(key, words, prints) of (key, text): the hashed words and the fingerprints, once each, of texts that have any (in the sieve)."""
    schema = T.StructType([T.StructField(key, id_type(rows, key)), T.StructField("words", T.BinaryType()), T.StructField("prints", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words(batch.column(1))
        at, h = fingerprints(w.hash, w.offsets)
        if sieve is not None:
            some = _passes(sieve.value, h)
            at, h = at[some], h[some]
        if not len(at):
            return None
        row = np.searchsorted(w.offsets, at, "right") - 1
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        once = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
        row, h = row[once], h[once]
        rows, first = np.unique(row, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)].astype(np.int32)), pa.array(h.view(np.int64)))
        texts = [w.hash[w.offsets[r] : w.offsets[r + 1]].tobytes() for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(texts, pa.binary()), lists], schema.names)

    return map_text(rows.where("text is not null").select(key, "text"), "text", schema, run)


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The sieve's bits for each fingerprint; the high bits are the first, the next are a hash."""
    yield (h >> U(64 - bits)).astype(np.int64)
    a = mix(h)
    for i in range(1, PROBES):
        yield ((a >> U(7 * i)) & U((1 << bits) - 1)).astype(np.int64)


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which fingerprints may be in the sieve; each probe looks only at what the ones before let through."""
    bits = len(sieve).bit_length() - 1 + 6
    left = np.arange(len(h))
    at = h >> U(64 - bits)
    for i in range(PROBES):
        if i:
            at = (mix(h[left]) >> U(7 * i)) & U((1 << bits) - 1)
        left = left[(sieve[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1]
    out = np.zeros(len(h), bool)
    out[left] = True
    return out


def _sieve(prints: DataFrame) -> Broadcast:
    """The broadcast bitmap of fingerprints ``h``; at most 2^23 words reach the driver, however many there are."""
    bits = min(SIEVE, max(20, (64 * prints.count()).bit_length()))
    long = T.LongType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(U)
            at = np.unique(np.concatenate(list(_places(h, bits))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(U)).view(np.int64))], ["word", "mask"])

    masks = prints.select("h").mapInArrow(run, T.StructType([T.StructField("word", long), T.StructField("mask", long)]))
    found = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(U)
    return prints.sparkSession.sparkContext.broadcast(out)


def _tests(bench: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Staged (item, item_id, words, prints) of the test items, and their fingerprints (item, h)."""
    rows = bench.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    items = stage(_prints(rows, "item_id").withColumn("item", F.expr("uuid()")), "test_items")
    return items, items.select("item", F.explode("prints").alias("h"))


def _hits(some: DataFrame, items: DataFrame, prints: DataFrame, key: str) -> DataFrame:
    """(key, item_id, doc_start, item_start, n_words) of the spans of staged ``some`` (row, key, words, prints)."""
    pairs = some.select("row", F.explode("prints").alias("h")).join(prints, "h").select("row", "item").distinct()
    sides = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").join(some.select("row", key, "words"), "row")
    long = T.LongType()
    schema = T.StructType([T.StructField(key, id_type(some, key)), T.StructField("item_id", id_type(items, "item_id")), *(T.StructField(c, long) for c in ("doc_start", "item_start", "n_words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: dict[bytes, TestSet] = {}
        for batch in batches:
            found = []
            for i, (doc, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if item not in tests:
                    if len(tests) >= 1000:
                        tests.clear()
                    w = np.frombuffer(item, U)
                    tests[item] = test_set(w, np.array([0, len(w)]))
                w = np.frombuffer(doc, U)
                found += [(i, *x[2:]) for x in spans(w, np.array([0, len(w)]), tests[item])]
            if found:
                row, *rest = (pa.array(x, pa.int64()) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *rest], schema.names)

    return sides.select(key, "item_id", "words", "item_words").mapInArrow(run, schema)


def contaminated_spans(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): each maximal span of at least ``LEAST`` words that a document shares with an item."""
    items, prints = _tests(bench, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Keys are written with the rows, so that a task run anew can't give other ones.
    some = stage(_prints(rows, "doc_id", _sieve(prints)).withColumn("row", F.expr("uuid()")), "suspects")
    return _hits(some, items, prints, "doc_id")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those that share a span with a test item.

    Texts are judged once, and rows go by the SHA-256 of theirs; the digests of
    contaminated texts are broadcast only up to a checked number.
    """
    items, prints = _tests(bench, item_id, item_text)
    (digest,) = fresh(docs, "text_digest")
    rows = docs.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("doc_id"), F.col(text).alias("text"))
    some = stage(_prints(rows, "doc_id", _sieve(prints)).dropDuplicates(["doc_id"]).withColumn("row", F.col("doc_id")), "suspects")
    bad = stage(_hits(some, items, prints, "doc_id").select(F.col("doc_id").alias(digest)).distinct(), "contaminated")
    return anti_by_id(docs.withColumn(digest, F.sha2(F.col(text), 256)), digest, bad, 500_000).select(*docs.columns)
