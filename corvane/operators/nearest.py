"""The best rows of a corpus for many queries, in numpy: blocks in single precision find candidates, doubles rank them.

A candidate's rough score is off by ``slack`` at most, so nothing that belongs
to the best is lost; ranks are those of exact scores, ties by the row's id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd

#: How many queries meet how many rows at a time; their scores stay in a core's cache.
QUERIES, ROWS = 256, 2048
#: How many candidates are scored exactly at a time.
_PAIRS = 1 << 16
#: How many candidates for each query of a block wait, on average, before they are ranked.
_WAIT = 4
_LEAST = np.finfo(np.float32).min


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _product(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.matmul(a, b.T, out=out)


def _single(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32)


@dataclass
class Measure:
    """How queries and rows are laid out as arrays, and the scores of some queries (rows of the result) with a batch of rows.

    ``kind`` of a value says which values it can be laid out and compared with
    (None: with none). ``left`` and ``right`` prepare blocks of queries and rows
    for ``rough`` scores, which miss the exact ones of ``pairs`` by ``slack`` at most.
    """

    lay: Callable[[list], Any]
    score: Callable[[Any, Any], np.ndarray]
    fits: Callable[[Any, Any], bool]
    kind: Callable[[Any], int | None]
    pairs: Callable[[Any, Any, np.ndarray, np.ndarray], np.ndarray]
    slack: Callable[[Any, Any], float]
    left: Callable[[Any], Any] = _single
    right: Callable[[Any], Any] = _single
    rough: Callable[[Any, Any, np.ndarray], np.ndarray] = _product


def _error(terms: int, q: float = 1.0, x: float = 1.0) -> float:
    """Bound of the error of sums of so many products in single precision, for vectors of lengths ``q`` and ``x``."""
    return (terms + 16) * 2.0**-23 * q * x + 1e-8


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0)))


COSINE = Measure(
    lambda vectors: unit(np.stack(vectors).astype(float)) if len(vectors) else np.zeros((0, 1)),
    lambda q, x: q @ x.T,
    lambda q, value: len(value) == q.shape[1],
    len,
    lambda q, x, i, j: np.einsum("ij,ij->i", q[i], x[j]),
    lambda q, x: _error(q.shape[1]),
)


def hamming(bits: int) -> Measure:
    """1 less the share of differing bits, of arrays of words (see ``vectors.sign_words``)."""

    def differing(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(q[..., i] ^ x[..., i]).astype(np.int64) for i in range(q.shape[-1]))

    def signs(words: np.ndarray, size: float) -> np.ndarray:
        one = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
        return one.astype(np.float32) * np.float32(2 * size) - np.float32(size)

    # Of w words, 1 - differing / bits is the product of signs over 2 bits, and 1 - 64 w / (2 bits).
    constant = lambda words: 1 - 64 * words.shape[1] / (2 * bits)
    return Measure(
        lambda words: np.stack(words).astype(np.int64) if len(words) else np.zeros((0, 1), np.int64),
        lambda q, x: 1 - differing(q[:, None], x[None, :]) / bits,
        lambda q, value: len(value) == q.shape[1],
        len,
        lambda q, x, i, j: 1 - differing(q[i], x[j]) / bits,
        lambda q, x: _error(64 * q.shape[1], 8 * q.shape[1] ** 0.5, 8 * q.shape[1] ** 0.5 / bits),
        lambda q: np.column_stack([signs(q, 1), np.full(len(q), constant(q), np.float32)]),
        lambda x: np.column_stack([signs(x, 0.5 / bits), np.ones(len(x), np.float32)]),
    )


@dataclass
class _Tokens:
    """Token matrices on top of each other; ``starts`` are their first rows."""

    rows: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, at: slice) -> _Tokens:
        lo, hi, _ = at.indices(len(self))
        ends = np.r_[self.starts, len(self.rows)]
        return _Tokens(self.rows[ends[lo] : ends[hi]], self.starts[lo:hi] - ends[lo])

    def even(self) -> np.ndarray | None:
        """As one array (matrix, token, value) where all matrices have as many tokens."""
        n = len(self.rows) // max(len(self), 1)
        return self.rows.reshape(len(self), n, -1) if len(self) and (self.starts == np.arange(len(self)) * n).all() else None


def _tokens(matrices: list) -> _Tokens:
    parts = [np.stack(m).astype(float) for m in matrices]
    return _Tokens(np.concatenate(parts) if parts else np.zeros((0, 1)), np.cumsum([0, *map(len, parts)])[:-1])


def _late(q: _Tokens, x: _Tokens) -> np.ndarray:
    best = np.maximum.reduceat(q.rows @ x.rows.T, x.starts, axis=1)
    return np.add.reduceat(best, q.starts, axis=0) / np.diff(np.r_[q.starts, len(q.rows)])[:, None]


def _token_major(t: _Tokens, last: int) -> tuple[_Tokens, np.ndarray | None]:
    """With the even array as (token, matrix, value), or (token, value, matrix)."""
    even = t.even()
    return t, None if even is None else np.ascontiguousarray(even.transpose(1, 2, 0) if last == 0 else even.transpose(1, 0, 2), np.float32)


def _late_rough(a: tuple[_Tokens, np.ndarray | None], b: tuple[_Tokens, np.ndarray | None], out: np.ndarray) -> np.ndarray:
    q, x = a[1], b[1]
    if q is None or x is None:
        out[:] = _late(a[0], b[0])
        return out
    for lo in range(0, out.shape[1], 512):  # three such parts stay in a core's cache
        part = x[:, :, lo : lo + 512]
        best, other, total = (_buffer(name, (len(out), part.shape[2])) for name in ("best", "other", "total"))
        for i in range(len(q)):
            to = best if i else total
            np.matmul(q[i], part[0], out=to)
            for j in range(1, len(part)):
                np.maximum(to, np.matmul(q[i], part[j], out=other), out=to)
            if i:
                np.add(total, best, out=total)
        np.multiply(total, np.float32(1 / len(q)), out=out[:, lo : lo + 512])
    return out


def _late_pairs(q: _Tokens, x: _Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = q.even(), x.even()
    if a is None or b is None:
        return _late(q, x)[i, j]
    return np.einsum("pad,pbd->pab", a[i], b[j]).max(2).sum(1) / a.shape[1]


#: For each query token its best document token, averaged; token matrices of at least one row.
MAX_SIM = Measure(
    _tokens,
    _late,
    lambda q, value: len(value) > 0,
    lambda value: len(value[0]) if len(value) else None,
    _late_pairs,
    lambda q, x: _error(q.rows.shape[1], _longest(q.rows), _longest(x.rows)),
    lambda q: _token_major(q, 1),
    lambda x: _token_major(x, 0),
    _late_rough,
)

_buffers: dict[str, np.ndarray] = {}


def _buffer(name: str, shape: tuple[int, int], kind: type = np.float32) -> np.ndarray:
    """Memory that blocks use one after the other; fresh pages cost more than the products."""
    size = shape[0] * shape[1]
    if name not in _buffers or len(_buffers[name]) < size:
        _buffers[name] = np.empty(size, kind)
    return _buffers[name][:size].reshape(shape)


class Best:
    """The best ``k`` rows of each query, over all rows that came by."""

    def __init__(self, q: Any, qids: np.ndarray, k: int, loops: bool, measure: Measure) -> None:
        self.qids, self.k, self.loops, self.measure = np.asarray(qids), k, loops, measure
        self.parts = [(at, part, measure.left(part)) for at in range(0, len(q), QUERIES) if len(part := q[at : at + QUERIES])]
        self.ids = np.zeros((len(qids), k), np.int64)
        self.scores = np.full((len(qids), k), -np.inf)
        self.least = np.full(len(qids), -np.inf)  # rounded score of the last of k, if there are so many
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def meet(self, x: Any, ids: np.ndarray, may: Callable[[int, int, slice], np.ndarray | None] | None = None) -> None:
        """Rows ``x`` with ascending ``ids``; ``may`` says which queries (from, to) see which rows, None where none does."""
        for lo in range(0, len(ids), ROWS):
            rows, block = ids[lo : lo + ROWS], x[lo : lo + ROWS]
            right = self.measure.right(block)
            for at, q, left in self.parts:
                seen = None if may is None else may(at, at + len(q), slice(lo, lo + len(rows)))
                if may is None or seen is not None:
                    self._block(at, q, left, block, right, rows, seen)

    def _block(self, at: int, q: Any, left: Any, x: Any, right: Any, rows: np.ndarray, seen: np.ndarray | None) -> None:
        k, m, here = self.k, self.measure, slice(at, at + len(q))
        rough, slack = m.rough(left, right, _buffer("rough", (len(q), len(rows)))), m.slack(q, x)
        if seen is not None:
            np.copyto(rough, -np.inf, where=~seen)
        if not self.loops:
            first, end = (np.searchsorted(rows, self.qids[here], side) for side in ("left", "right"))
            for i in np.flatnonzero(end > first):
                rough[i, first[i] : end[i]] = -np.inf
        bound = self.least[here] - slack
        if len(new := np.flatnonzero(np.isneginf(bound))) and len(rows) > k:
            some = rough[new]
            some[np.isnan(some)] = -np.inf
            bound[new] = np.partition(some, len(rows) - k, axis=1)[:, len(rows) - k] - 2 * slack
        bound = np.nextafter(np.maximum(bound, _LEAST).astype(np.float32), np.float32(-np.inf))
        bound = np.maximum(bound, _LEAST)
        # After some blocks few queries find anything in one; only their scores are looked through. NaN is no maximum to go by.
        who = np.flatnonzero(~(rough.max(axis=1) < bound))
        if not len(who):
            return
        if 2 * len(who) < len(rough):
            rough, bound = np.take(rough, who, axis=0, out=_buffer("some", (len(who), len(rows))), mode="clip"), bound[who]
        else:
            who = np.arange(len(rough))
        hits = np.flatnonzero(np.greater_equal(rough, bound[:, None], out=_buffer("hits", rough.shape, bool)))
        for s in range(0, len(hits), _PAIRS):
            i, j = np.divmod(hits[s : s + _PAIRS], len(rows))
            self._keep(at, len(q), i := who[i], rows[j], m.pairs(q, x, i, j))

    def _keep(self, at: int, n: int, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates wait until there are enough of them for the ``n`` queries from ``at`` on to be ranked at once."""
        good = np.isfinite(scores) & (np.round(scores, 9) >= self.least[at + i])
        if good.any():
            waiting = self.waiting.setdefault(at, [])
            waiting.append((at + i[good], ids[good], scores[good]))
            if sum(len(x[0]) for x in waiting) >= _WAIT * n:
                self._merge(at)

    def _merge(self, at: int) -> None:
        i, ids, scores = (np.concatenate(x) for x in zip(*self.waiting.pop(at)))
        touched = np.unique(i)
        who = np.concatenate([np.repeat(touched, self.k), i])
        ids = np.concatenate([self.ids[touched].reshape(-1), ids])
        scores = np.concatenate([self.scores[touched].reshape(-1), scores])
        order = np.lexsort((ids, -np.round(scores, 9), who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < self.k
        self.ids[who[kept], rank[kept]] = ids[order][kept]
        self.scores[who[kept], rank[kept]] = scores[order][kept]
        self.least[touched] = np.round(self.scores[touched, -1], 9)

    def frame(self) -> pd.DataFrame:
        for at in list(self.waiting):
            self._merge(at)
        good = np.isfinite(self.scores)
        return pd.DataFrame({"qid": np.repeat(self.qids, self.k)[good.reshape(-1)], "indexid": self.ids[good], "score": self.scores[good]})


#: Up to this many dimensions sparse blocks are multiplied as dense ones.
_DENSE = 1024


@dataclass
class _Sparse:
    """Sparse vectors one after the other; ``starts`` are their first entries, and the end."""

    dims: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, at: slice) -> _Sparse:
        lo, hi, _ = at.indices(len(self))
        ends = self.starts[lo : hi + 1]
        return _Sparse(self.dims[ends[0] : ends[-1]], self.values[ends[0] : ends[-1]], ends - ends[0])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def longest(self) -> float:
        return float(np.sqrt(np.bincount(self.owners(), self.values**2, len(self)).max(initial=0.0)))


def _sparse(vectors: list) -> _Sparse:
    """Of arrays whose first half are dimensions and whose second half are values; a dimension that comes twice counts as the sum."""
    sizes = np.array([len(v) // 2 for v in vectors], np.int64)
    cut = lambda f: np.concatenate([f(np.asarray(v, float), n) for v, n in zip(vectors, sizes)]) if len(vectors) else np.zeros(0)
    return _Sparse(cut(lambda v, n: v[:n]).astype(np.int64), cut(lambda v, n: v[n:]), np.r_[0, np.cumsum(sizes)])


def _matrix(x: _Sparse, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Dense, of ``dims`` (in order) only."""
    at = np.searchsorted(dims, x.dims)
    have = dims[np.minimum(at, len(dims) - 1)] == x.dims if len(dims) else np.zeros(len(at), bool)
    flat = x.owners()[have] * len(dims) + at[have]
    return np.bincount(flat, values[have], len(x) * len(dims)).reshape(len(x), len(dims))


def _sparse_score(q: _Sparse, x: _Sparse) -> np.ndarray:
    """Inner products; -inf where no dimension is in both."""
    sure = all(len(v.values) == 0 or v.values.min() > 1e-100 for v in (q, x))  # then 0 means that nothing is shared
    dims = np.intersect1d(q.dims, x.dims)
    shape = len(q), len(x)
    if len(dims) <= _DENSE:
        sums = _matrix(q, dims, q.values) @ _matrix(x, dims, x.values).T
        shared = sums if sure else _matrix(q, dims, np.ones(len(q.dims))) @ _matrix(x, dims, np.ones(len(x.dims))).T
        return np.where(shared > 0, sums, -np.inf)
    order = np.argsort(x.dims, kind="stable")
    have, owner, values = x.dims[order], x.owners()[order], x.values[order]
    first, end = np.searchsorted(have, q.dims, "left"), np.searchsorted(have, q.dims, "right")
    ends, rows = np.r_[0, np.cumsum(end - first)], q.owners()
    sums, shared = np.zeros(len(q) * len(x)), np.zeros(len(q) * len(x), np.int64)
    at = 0
    while at < len(rows):  # about a million shared entries at a time
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")) - 1)
        n = (end - first)[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(ends[at:to] - ends[at], n) + np.repeat(first[at:to], n)
        flat = rows[i] * len(x) + owner[j]
        sums += np.bincount(flat, q.values[i] * values[j], len(sums))
        shared += np.bincount(flat, minlength=len(sums))
        at = to
    return np.where(shared > 0, sums, -np.inf).reshape(shape)


def _sparse_right(x: _Sparse) -> tuple[_Sparse, np.ndarray, np.ndarray | None]:
    dims = np.unique(x.dims)
    small = len(dims) <= _DENSE and len(x.values) and x.values.min() > 1e-15
    return x, dims, _matrix(x, dims, x.values).astype(np.float32) if small else None


def _sparse_rough(a: _Sparse, b: tuple[_Sparse, np.ndarray, np.ndarray | None], out: np.ndarray) -> np.ndarray:
    x, dims, dense = b
    if dense is None or not len(a.values) or a.values.min() <= 1e-15:
        out[:] = _sparse_score(a, x)
        return out
    np.matmul(_matrix(a, dims, a.values).astype(np.float32), dense.T, out=out)
    np.copyto(out, -np.inf, where=np.less_equal(out, 0, out=_buffer("none", out.shape, bool)))
    return out


def _sparse_pairs(q: _Sparse, x: _Sparse, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    dims = np.intersect1d(q.dims, x.dims)
    if len(dims) > _DENSE or min(q.values.min(initial=1), x.values.min(initial=1)) <= 1e-15:
        return _sparse_score(q, x)[i, j]
    a, b = _matrix(q, dims, q.values), _matrix(x, dims, x.values)
    step = max(1, (1 << 22) // max(len(dims), 1))
    return np.concatenate([np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)])


#: Inner products of sparse vectors, as arrays of dimensions and then values; those without a common dimension match nothing.
SPARSE = Measure(
    _sparse,
    _sparse_score,
    lambda q, value: len(value) > 0,
    lambda value: 0 if len(value) else None,
    _sparse_pairs,
    lambda q, x: _error(int(np.diff(q.starts).max(initial=0)), q.longest(), x.longest()),
    lambda q: q,
    _sparse_right,
    _sparse_rough,
)
