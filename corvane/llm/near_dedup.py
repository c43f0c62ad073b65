"""Near-duplicate detection: MinHash bands propose, odd sketches decide what is clear, shingle sets the rest.

A document is its set of word 3-grams (of all its words where it has fewer).
``SAMPLES`` MinHash values are cut into bands; documents that agree on a band
are candidates. The samples are also folded into a parity bitmap, the odd
sketch: each pair (sample number, value) flips one bit. With d bits set in the
XOR of two sketches, J = 1 + n / (4 k) * ln(1 - 2 d / n) for n bits and k
samples, so a population count judges a candidate. The count is noisy (its
standard deviation at J = 0.5 is about 10 bits, or 0.055 of J), so it only
accepts from ``SLACK`` over the threshold on and refuses from ``SLACK`` under it
on. Candidates between are unclear: a bucket gives away only as many of them as
hold its members together, and in what they hold together all documents are
settled by the exact Jaccard similarity of their shingle sets, one pair for each
two groups that meet. So no step passes on all pairs of a group.

Documents with equal samples are folded into the least doc_id among them
first, with map-side combining, so crowds of copies cost nothing later. In a
bucket, components are grown from a member: it absorbs all members within
reach, then each of those looks at what is left. That is single linkage, exact
for every pair of the bucket, and near linear when the members are alike;
unclear pairs are sought only between a bucket's components. Rows come in order
of bucket, so a task holds one bucket at a time, and a bucket of more than
``CHUNK`` members is cut into chunks whose pairs are compared block by block, in
tasks of their own. The groups are the connected components over all buckets.

Defined results: null texts, and texts without a word, match nothing and stay.
Rows with a null doc_id stay. Rows that share a doc_id share its fate: the
document counts as its least sketch. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.components import components
from corvane.llm.shared import anti_by_id, fixed_binary, id_type, long_list, map_text, stage
from corvane.llm.words import U, gram_starts, grams, mix, words

#: With 50 bands of 4 rows a pair of similarity 0.5 becomes a candidate with a chance of 0.96, one of 0.6 with 0.999.
SHINGLE, BANDS, ROWS, BITS = 3, 50, 4, 512
SAMPLES = BANDS * ROWS
THRESHOLD = 0.5
#: How far from the threshold a sketch decides alone, over three standard deviations.
SLACK = 0.2
#: Members of a bucket that are compared at a time.
CHUNK = 1 << 14
#: Members of an unclear group whose shingle sets are compared at a time.
SETTLED = 1 << 10

_rng = np.random.Generator(np.random.PCG64(20240607))
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_CHUNK = 1 << 15


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' shingles in order (repeats included), and how many each document has."""
    w = words(texts)
    long = grams(w.hash, SHINGLE)
    ok = gram_starts(w.offsets, SHINGLE)
    n = np.diff(w.offsets)
    values, has = np.zeros(len(w.hash), U), np.zeros(len(w.hash), bool)
    values[: len(long)] = long
    has[:] = ok
    for few in range(1, SHINGLE):
        at = w.offsets[:-1][n == few]
        if len(at):
            values[at] = mix(sum((w.hash[at + j] * U(2 * j + 3) for j in range(few)), U(few)))
            has[at] = True
    return values[has], np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)


def minhash(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima for each document with at least one shingle."""
    counts = counts[counts > 0]
    out = np.empty((len(counts), SAMPLES), np.uint32)
    h = (mix(values) >> U(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        lo = int(ends[a] - counts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        part = h[lo : int(ends[b - 1])]
        at = (ends[a:b] - counts[a:b]) - lo
        tmp, high = np.empty_like(part), np.empty_like(part)
        for i in range(SAMPLES):  # one multiplication alone orders small sets too much alike
            np.bitwise_xor(part, _XOR[i], out=tmp)
            np.multiply(tmp, _MUL[i], out=tmp)
            np.right_shift(tmp, 15, out=high)
            np.bitwise_xor(tmp, high, out=tmp)
            np.multiply(tmp, _MUL[i - 1], out=tmp)
            out[a:b, i] = np.minimum.reduceat(tmp, at)
        a = b
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of each row of samples, as 64-bit words."""
    at = (mix(samples.astype(U) + _SALT) & U(BITS - 1)).astype(np.int64)
    flips = np.bincount((np.arange(len(at))[:, None] * BITS + at).reshape(-1), minlength=len(at) * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(at), BITS), axis=1).view(U)


def similarity(differing: np.ndarray | int) -> np.ndarray:
    """Jaccard similarity for a number of differing bits."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9))


def farthest(threshold: float) -> int:
    """The most differing bits at which the similarity is still ``threshold``."""
    return int(np.floor(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - threshold) / BITS))))


def link(sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that joins sketches at most ``most`` bits apart."""
    if len(sketches) == 2:
        return [(0, 1)] if int(np.bitwise_count(sketches[0] ^ sketches[1]).sum()) <= most else []
    left, edges = np.arange(len(sketches)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            u = todo.pop()
            near = np.bitwise_count(sketches[left] ^ sketches[u]).sum(1) <= most
            if near.any():
                found = left[near]
                edges += [(u, int(v)) for v in found]
                todo += found.tolist()
                left = left[~near]
    return edges


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sig, bands, sketch) for each document that has words."""
    schema = T.StructType([T.StructField("doc_id", id_type(docs, doc_id)), T.StructField("sig", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts = shingles(batch.column(1))
        m = minhash(values, counts)
        rows = m.reshape(len(m), BANDS, ROWS).astype(U)
        bands = np.broadcast_to(np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15), (len(m), BANDS)).copy()
        for i in range(ROWS):
            bands = mix(bands ^ rows[:, :, i]) * U(3) + U(i)
        sig = mix((bands * (np.arange(BANDS, dtype=U) * U(2) + U(1))).sum(1, dtype=U)) if len(m) else np.empty(0, U)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(counts > 0)), pa.array(sig.view(np.int64)), long_list(bands.view(np.int64)), fixed_binary(odd_sketch(m))], ["doc_id", "sig", "bands", "sketch"])

    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, "text", schema, run)


def _crowded(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Of (bucket, rep) in order of bucket, those whose bucket has several, with the chunk of the bucket that they fall into.

    A batch's last row waits for the next one, so a task holds one batch.
    """
    held, place = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch], held.schema)])
        bucket = t.column(0).to_numpy()
        first = np.r_[True, bucket[1:] != bucket[:-1]]
        at = np.arange(len(bucket))
        inside = at - np.maximum.accumulate(np.where(first, at, 0))
        several = ~first | np.r_[~first[1:], False]
        several[0] |= place > 0
        inside[: len(bucket) if first.sum() == 1 else int(np.flatnonzero(first)[1])] += place
        place = int(inside[-1])
        held = t.slice(len(bucket) - 1)
        yield from _chunks(t.slice(0, len(bucket) - 1), several[:-1], inside[:-1], chunk)
    if held is not None and place:
        yield from _chunks(held, np.ones(1, bool), np.array([place]), chunk)


def _chunks(rows: pa.Table, keep: np.ndarray, inside: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    if keep.any():
        out = rows.filter(pa.array(keep)).append_column("chunk", pa.array(inside[keep] // chunk))
        yield from out.combine_chunks().to_batches()


def unclear(sketches: np.ndarray, edges: list[tuple[int, int]], most: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Of the pairs at most ``most`` bits apart between the trees of ``link`` (and between sides), those that span the groups which all of them make.

    Every member that such a pair has is in one of those given.
    """
    tree, group = np.arange(len(sketches)), np.arange(len(sketches))
    for u, v in edges:
        tree[v] = tree[u]
    if (tree == tree[0]).all():
        return
    for u in range(len(sketches) - 1):
        other = tree[u + 1 :] != tree[u]
        if side is not None:
            other &= side[u + 1 :] != side[u]
        others = u + 1 + np.flatnonzero(other)
        near = others[np.bitwise_count(sketches[others] ^ sketches[u]).sum(1) <= most]
        if len(near):
            found, first = np.unique(group[near], return_index=True)
            new = found != group[u]
            if new.any():
                group[np.isin(group, found[new])] = group[u]
                yield u, near[first[new]]


def block_edges(sketches: np.ndarray, side: np.ndarray, clear: int, most: int) -> tuple[list[tuple[int, int]], Iterator[tuple[int, np.ndarray]]]:
    """(sure edges, unclear pairs) of one chunk, or of what two chunks have across them.

    Of two chunks, one sure edge stands for all between the same two groups.
    """
    edges = link(sketches, clear)
    if (side == side[0]).all():
        return edges, unclear(sketches, edges, most)
    group = np.arange(len(sketches))
    for which in (side == side[0], side != side[0]):
        at = np.flatnonzero(which)
        for u, v in link(sketches[at], clear):
            group[at[v]] = group[at[u]]
    across = {tuple(sorted((int(group[u]), int(group[v])))): (u, v) for u, v in edges if side[u] != side[v]}
    return list(across.values()), unclear(sketches, edges, most, side)


def _pairs(batches: Iterator[pa.RecordBatch], clear: int, most: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, sure) of (bucket, block, chunk, rep, sketch) in order of bucket and block; a task holds a batch and one block."""

    def edges_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, block, chunk = (t.column(i).to_numpy() for i in range(3))
        sketch = np.frombuffer(b"".join(t.column(4).to_pylist()), U).reshape(-1, BITS // 64)
        rep = t.column(3).combine_chunks()

        def pairs(a: list[np.ndarray], b: list[np.ndarray], sure: list[np.ndarray]) -> pa.RecordBatch:
            ends = [rep.take(pa.array(np.concatenate(x))) for x in (a, b)]
            return pa.RecordBatch.from_arrays([*ends, pa.array(np.concatenate(sure))], ["a", "b", "sure"])

        edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0)) + 1
        firsts, lasts = np.r_[0, edge], np.r_[edge, len(bucket)]
        two = firsts[lasts - firsts == 2]
        apart = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(1)
        two, apart = two[apart <= most], apart[apart <= most]
        a, b, sure = [two], [two + 1], [apart <= clear]
        for lo, hi in zip(firsts, lasts):
            if hi - lo <= 2:
                continue
            found, others = block_edges(sketch[lo:hi], chunk[lo:hi], clear, most)
            if found:
                ends = np.array(found) + lo
                a.append(ends[:, 0])
                b.append(ends[:, 1])
                sure.append(np.ones(len(ends), bool))
            for u, near in others:
                a.append(np.full(len(near), lo + u))
                b.append(lo + near)
                sure.append(np.zeros(len(near), bool))
        yield pairs(a, b, sure)

    yield from _whole_blocks(batches, edges_of)


def blocks(rows: DataFrame, chunk: int) -> DataFrame:
    """(bucket, block, chunk, rep) of (bucket, rep), for buckets of several: a group to compare for each pair of a bucket's chunks.

    A bucket of at most ``chunk`` members is one block. A pair of a bucket lies in one block.
    """
    long = T.LongType()
    ordered = rows.select("bucket", "rep").repartition("bucket").sortWithinPartitions("bucket")
    crowded = stage(ordered.mapInArrow(partial(_crowded, chunk=chunk), T.StructType([T.StructField("bucket", long), T.StructField("rep", id_type(rows, "rep")), T.StructField("chunk", long)])), "crowded")
    hot = stage(crowded.where("chunk > 0").groupBy("bucket").agg(F.max("chunk").alias("last")), "hot_buckets")
    if hot.isEmpty():
        return crowded.select("bucket", F.lit(0).cast("long").alias("block"), "chunk", "rep")
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long"))), lambda i: F.shiftleft(F.least(i, F.col("chunk")), 31) + F.greatest(i, F.col("chunk")))
    return crowded.join(hot, "bucket", "left").select("bucket", F.explode(ends).alias("block"), "chunk", "rep")


def near_edges(reps: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b, sure) of the ids in ``reps`` (rep, bands, sketch): those that span the sure groups of each bucket, and those that span the unclear ones."""
    kind = id_type(reps, "rep")
    members = blocks(reps.select(F.explode("bands").alias("bucket"), "rep"), chunk).join(reps.select("rep", "sketch"), "rep")
    members = members.select("bucket", "block", "chunk", "rep", "sketch").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    clear, most = farthest(threshold + SLACK), farthest(threshold - SLACK)
    return members.mapInArrow(partial(_pairs, clear=clear, most=most), T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("sure", T.BooleanType())]))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) from (doc_id, text): the hashes of each document's shingles, once each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts = shingles(batch.column(1))
        ends = np.cumsum(counts)
        sets = [np.unique(values[e - n : e]) for e, n in zip(ends, counts)]
        offsets = np.cumsum([0, *(len(x) for x in sets)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["doc_id", "shingles"])

    return map_text(docs, "text", T.StructType([T.StructField("doc_id", id_type(docs, "doc_id")), T.StructField("shingles", T.ArrayType(T.LongType()))]), run)


def joined(sketches: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], most: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs of one block, by exact Jaccard similarity, that join different roots; one for each two groups that meet."""
    size = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(size)]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(codes), bool)
    group, out, two = root.copy(), [], not (side == side[0]).all()
    for u in range(len(sets) - 1):
        other = group[u + 1 :] != group[u]
        if two:
            other &= side[u + 1 :] != side[u]
        others = u + 1 + np.flatnonzero(other)
        near = others[np.bitwise_count(sketches[others] ^ sketches[u]).sum(1) <= most]
        if not len(near):
            continue
        mine = codes[starts[u] : starts[u + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[np.concatenate([codes[starts[v] : starts[v + 1]] for v in near])], np.r_[0, np.cumsum(size[near])[:-1]], dtype=np.int64)
        mark[mine] = False
        for v in near[shared >= threshold * (size[u] + size[near] - shared)]:
            if group[v] != group[u]:
                out.append((u, int(v)))
                group[group == group[v]] = group[u]
    return out


def _settled(batches: Iterator[pa.RecordBatch], most: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of (bucket, block, chunk, root, sketch, shingles) in order of bucket and block: roots that belong together."""

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, block, chunk = (t.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0)) + 1
        root = t.column(3).combine_chunks()
        code = root.dictionary_encode().indices.to_numpy()
        sketch = np.frombuffer(b"".join(t.column(4).to_pylist()), U).reshape(-1, BITS // 64)
        shingles = t.column(5).combine_chunks()
        found = []
        for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(bucket)]):
            if hi - lo > 1:
                sets = [shingles[int(i)].values.to_numpy() for i in range(lo, hi)]
                found += [(lo + u, lo + v) for u, v in joined(sketch[lo:hi], code[lo:hi], chunk[lo:hi], sets, most, threshold)]
        if found:
            a, b = (root.take(pa.array(x)) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    yield from _whole_blocks(batches, of)


def _whole_blocks(batches: Iterator[pa.RecordBatch], f: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``f`` over rows in order of bucket and block (the first two columns), cut only between blocks; a task holds a batch and one block."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        one = pa.Table.from_batches([batch])
        t = one if held is None else pa.concat_tables([held, one])
        bucket, block = t.column(0).to_numpy(), t.column(1).to_numpy()
        other = np.flatnonzero((bucket != bucket[-1]) | (block != block[-1]))
        whole = int(other[-1]) + 1 if len(other) else 0
        held = t.slice(whole)
        if whole:
            yield from f(t.slice(0, whole).combine_chunks())
    if held is not None:
        yield from f(held.combine_chunks())


def settled(members: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, chunk: int = SETTLED) -> DataFrame:
    """(a, b): roots of staged ``members`` (rep, root, within) that belong together, by comparing the shingle sets of all that share ``within``.

    The sets of a large group are compared in blocks of chunks. The ids are
    broadcast only up to 4,000,000 (32 MB); beyond, both sides shuffle.
    """
    kind = id_type(members, "root")
    ids = members.select(F.col("rep").alias("doc_id"))
    wanted = docs.join(F.broadcast(ids) if ids.count() <= 4_000_000 else ids, "doc_id", "left_semi")
    # Of rows that share an id the least text counts; the sketch is that of one of them.
    sets = stage(shingle_sets(wanted.groupBy("doc_id").agg(F.min("text").alias("text"))), "shingle_sets").withColumnRenamed("doc_id", "rep")
    rows = blocks(members.select(F.xxhash64("within").alias("bucket"), "rep"), chunk)
    rows = rows.join(members.select("rep", "root"), "rep").join(reps.select("rep", "sketch"), "rep").join(sets, "rep")
    rows = rows.select("bucket", "block", "chunk", "root", "sketch", "shingles").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return rows.mapInArrow(partial(_settled, most=farthest(threshold - SLACK), threshold=threshold), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of) for each document of a group other than its least doc_id, staged."""
    signed = stage(signatures(docs, doc_id, text), "signatures")
    reps = stage(signed.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "representatives")
    found = stage(near_edges(reps, threshold), "near_edges")
    roots = components(found.where("sure").select("a", "b").unionByName(signed.join(reps.select("sig", "rep"), "sig").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    ends = found.where("not sure").select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    ends = stage(ends, "unclear")
    # What unclear pairs hold together, over the roots; there all their members are settled.
    over = components(ends.where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("within"))
    over = over.unionByName(over.select(F.col("within").alias("root"), "within").distinct())
    sides = ends.select(F.explode(F.array(*(F.struct(F.col(x).alias("rep"), F.col(f"root_{x}").alias("root")) for x in ("a", "b")))).alias("x")).select("x.*").distinct()
    members = stage(sides.join(over, "root").select("rep", "root", "within"), "unclear_members")
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Each root that another one replaces is a group's least document so far, and has no row of its own yet.
    moved = components(settled(members, reps.dropDuplicates(["rep"]), rows, threshold)).select(F.col("node").alias("root"), F.col("root").alias("least"))
    every = roots.join(moved, "root", "left").select(F.col("node").alias("doc_id"), F.coalesce("least", "root").alias("duplicate_of"))
    return stage(every.unionByName(moved.select(F.col("root").alias("doc_id"), F.col("least").alias("duplicate_of"))), "near_duplicates")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates."""
    return anti_by_id(docs, doc_id, near_duplicates(docs, doc_id, text, threshold).select(F.col("doc_id").alias(doc_id)))
