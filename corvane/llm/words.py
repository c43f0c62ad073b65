"""Words of many texts at once, as 64-bit hashes, in numpy over Arrow buffers.

A word is a maximal run, in lower case, of ASCII letters and digits and of
characters from U+0080 on, save U+00A0-00BF, U+2000-207F and U+3000-303F
(spaces and punctuation). ``WORD_SEPARATOR`` says the same as a regex.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.shared import strings

WORD_SEPARATOR = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x{a0}-\x{bf}\x{2000}-\x{207f}\x{3000}-\x{303f}]+"

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _a, _b in (b"09", b"AZ", b"az"):
    _IS_WORD[_a : _b + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, n)
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size + 1, U(base))
            t[0] = U(1)
            tables.append(np.multiply.accumulate(t))
        if size > _BLOCK:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


@dataclass
class Words:
    """``hash``: of all words in order; document ``i`` has those from ``offsets[i]`` to ``offsets[i + 1]``; ``length``: bytes."""

    hash: np.ndarray
    offsets: np.ndarray
    length: np.ndarray


def word_mask(data: np.ndarray) -> np.ndarray:
    mask = _IS_WORD[data]
    n = len(data)
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[(data[at + 1] >= 0xA0)]
    mask[at] = mask[at + 1] = False
    for lead, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(data[: max(0, n - 2)] == lead)
        at = at[np.isin(data[at + 1], seconds)]
        mask[at] = mask[at + 1] = mask[at + 2] = False
    return mask


def words(texts: pa.Array) -> Words:
    """The words of each text; a null has none."""
    lower = strings(pc.utf8_lower(strings(texts)))
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[: len(lower) + 1]
    first, total = int(offsets[0]), int(offsets[-1])
    if total == first:
        return Words(np.empty(0, U), np.zeros(len(lower) + 1, np.int64), np.empty(0, np.int64))
    data = np.frombuffer(lower.buffers()[2], np.uint8)[first:total]
    offsets = offsets - first
    mask = word_mask(data)
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1]
    before[edge] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1], after[:-1] = False, mask[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = int(ends[j - 1])
        power, inverse = _power_tables(hi - lo)
        sums = np.empty(hi - lo + 1, U)
        sums[0] = 0
        np.cumsum((data[lo:hi].astype(U) + U(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    length = ends - starts
    return Words(mix(out + length.astype(U) * U(0xD1342543DE82EF95)), np.searchsorted(starts, offsets), length)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words in the whole sequence, ``len - k + 1`` of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(0x2545F4914F6CDD1D)
        out += hashes[j : j + n]
    return mix(out)


def gram_starts(offsets: np.ndarray, k: int) -> np.ndarray:
    """Whether each position of the whole sequence starts a run of ``k`` words that stays in its document."""
    n = int(offsets[-1])
    ok = np.zeros(n + 1, np.int32)
    stop = np.maximum(offsets[1:] - k + 1, offsets[:-1])
    np.add.at(ok, offsets[:-1], 1)
    np.add.at(ok, stop, -1)
    return np.cumsum(ok)[:n] > 0


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """The document of each position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
