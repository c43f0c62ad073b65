"""Vectors: norms, inner products, pooling, quantisation, the default encoder. Null vectors give null."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[pd.Series], np.ndarray]
_DOUBLES = T.ArrayType(T.DoubleType())


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """``v`` in doubles at length 1; a null vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def truncate(v: Column, dimensions: int) -> Column:
    """The first dimensions only, for encoders trained for that."""
    return F.slice(v, 1, dimensions)


def quantise(v: Column, bits: int) -> Column:
    """Scalar quantisation to 1-8 bits, packed into bytes from the high bit on."""

    def pack(x: np.ndarray) -> list[bytes]:
        half = 2 ** (bits - 1)
        level = (np.clip(x * half, -half, half - 1) + half).astype(np.uint8)
        planes = np.unpackbits(level[:, :, None], axis=2)[:, :, 8 - bits :]
        return [row.tobytes() for row in np.packbits(planes.reshape(len(x), -1), axis=1)]

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return _by_length(s, pack)

    return run(v)


def _by_length(s: pd.Series, f: Callable[[np.ndarray], list]) -> pd.Series:
    """``f`` over the vectors of each length, as one matrix; null for null."""
    out = pd.Series([None] * len(s), dtype=object)
    lengths = s.map(lambda v: -1 if v is None else len(v)).to_numpy() if len(s) else np.zeros(0)
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        for i, x in zip(at, f(np.stack(s.iloc[at].to_numpy()).astype(float))):
            out[i] = x
    return out


def pool(tokens: Column, how: str = "mean", weights: Column | None = None) -> Column:
    """One vector of a token matrix: ``mean``, ``weighted`` (mean by ``weights``), ``max``, ``cls`` (the first) or ``last``.

    Null for a null matrix, and for one without rows. All in built-in functions.
    """
    first = lambda: F.when(F.size(tokens) > 0, F.get(tokens, F.lit(0)))
    if how in ("cls", "last"):
        return first() if how == "cls" else F.when(F.size(tokens) > 0, F.element_at(tokens, -1))
    if how == "max":
        return F.when(F.size(tokens) > 0, F.aggregate(tokens, first(), lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b))))
    if how not in ("mean", "weighted"):
        raise ValueError(f"unknown pooling: {how}")
    w = weights if how == "weighted" else F.transform(tokens, lambda x: F.lit(1.0))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x.cast("double"))
    scaled = F.zip_with(tokens, w, lambda v, a: F.transform(v, lambda x: x.cast("double") * a))
    zero = F.transform(first(), lambda x: F.lit(0.0))
    return F.when(F.size(tokens) > 0, F.transform(F.aggregate(scaled, zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)), lambda x: x / total))


def sign_words(v: Column, size: int) -> Column:
    """One bit for each dimension (set where it isn't negative), as longs of 32 bits, all in built-ins."""
    words = []
    for start in range(0, size, 32):
        bits = [F.when(v[i] >= 0, F.lit(1 << (i - start)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(start, min(size, start + 32))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def hamming(a: Column, b: Column, bits: int) -> Column:
    """1 less the share of differing bits between arrays of words."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - differing / F.lit(float(bits))))


def hashing_encoder(dimensions: int = 256) -> Encoder:
    """Signed feature hashing of alphanumeric words at length 1: deterministic, without a model."""

    def encode(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def encode(text: Column, encoder: Encoder, instruction: str = "", dimensions: int | None = None) -> Column:
    """Vectors of texts at length 1 by any encoder, in Arrow batches.

    ``instruction`` is put before each text; ``dimensions`` keeps only the first ones.
    """

    @F.pandas_udf(_DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        x = np.asarray(encoder(instruction + s.fillna("") if instruction else s), float).reshape(len(s), -1)[:, :dimensions]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)))

    return run(text)


def principal_axes(rows: DataFrame, vector: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, the ``n`` main axes): the D x D second moments are summed in the cluster; only they reach the driver."""

    def run(batches):  # noqa: ANN001, ANN202
        total = None
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float) if len(b) else np.empty((0, 0))
            if len(x):
                one = np.concatenate([x, np.ones((len(x), 1))], 1)
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pd.DataFrame({"m": [total.reshape(-1).tolist()]})

    parts = rows.select(vector).where(F.col(vector).isNotNull()).mapInPandas(run, T.StructType([T.StructField("m", _DOUBLES)]))
    cells = parts.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas().x.to_numpy()
    if not len(cells):
        return np.empty(0), np.empty((0, 0))
    size = int(len(cells) ** 0.5)
    m = cells.reshape(size, size)
    count, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    _, axes = np.linalg.eigh(m[:-1, :-1] / count - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :n].T


def remove_axes(v: Column, axes: np.ndarray) -> Column:
    """``v`` less its parts along ``axes`` (which don't depend on their signs), at length 1."""

    def less(x: np.ndarray) -> list[np.ndarray]:
        x = x - x @ axes.T @ axes
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return list(np.divide(x, norm, out=x, where=norm > 0))

    @F.pandas_udf(_DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        return _by_length(s, less)

    return run(v)


def muvera(v: Column, dimensions: int, repetitions: int = 20, hashes: int = 5, projection: int = 16, query: bool = False, seed: int = 42) -> Column:
    """Fixed-size encoding of token matrices: tokens fall into SimHash cells; a query sums its cells, a document takes means; each cell is projected."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((repetitions, dimensions, hashes))
    signs = rng.choice([-1.0, 1.0], (repetitions, dimensions))
    slots = rng.integers(0, projection, (repetitions, dimensions))

    @F.pandas_udf(_DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for tokens in s:
            if tokens is None or not len(tokens):
                out.append(None)
                continue
            x = np.stack([np.asarray(t, float) for t in tokens])
            parts = []
            for r in range(repetitions):
                bits = (x @ planes[r] > 0).astype(int)
                cell = bits @ (1 << np.arange(hashes))
                cell ^= cell >> 1  # neighbouring cells differ in one bit
                sums = np.zeros((1 << hashes, dimensions))
                np.add.at(sums, cell, x)
                if not query:
                    sums /= np.maximum(np.bincount(cell, minlength=1 << hashes), 1)[:, None]
                small = np.zeros((1 << hashes, projection))
                np.add.at(small.T, slots[r], (sums * signs[r]).T)
                parts.append(small.reshape(-1))
            out.append(np.concatenate(parts))
        return pd.Series(out)

    return run(v)
