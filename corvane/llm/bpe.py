"""BPE encoding and decoding, with tree concatenation of long unsplit text.

A change from a non-space to a space always ends a piece of the tokenizer's
pattern, so texts may be cut there and encoded part by part. Text that has no
such place for ``leaf`` characters is encoded by tree concatenation: it is
halved down to leaves, the leaves are encoded apart, and neighbours are joined
pairwise. At a join a window around the border is encoded again, from a token
border of the left side to one of the right; it grows until its first tokens
are the left side's own and its last tokens the right side's own, and then it
replaces what lay between. Every pair of neighbouring tokens then occurs in an
encoding of text around it, which makes the result the encoding of the whole.

Texts longer than ``spread`` characters are cut into rows first, so that their
parts are encoded by many tasks, and joined per text afterwards.

Defined results: a null text has null tokens; an empty text none. Text that
looks like special tokens is ordinary text. Unpaired surrogates can't occur in
Spark strings. Repeated rows and null ids give a row each. Empty tables give
empty results. Further columns don't matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import id_type, map_text, partitions, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, SPREAD = 1 << 14, 1 << 16
_AGREE = 3
_SAFE = re.compile(r"(?<=\S)(?=\s)")
_made: dict[bytes, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The tokenizer of a rank file's contents, made once in a process."""
    if vocabulary not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        _made[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[vocabulary]


def cuts(text: str, most: int) -> list[str]:
    """``text`` in parts that may be encoded apart; each is at most ``most`` long unless it has no place to cut."""
    parts, at = [], 0
    while len(text) - at > most:
        space = None
        for m in _SAFE.finditer(text, at + 1):
            if m.start() - at > most and space is not None:
                break
            space = m.start()
            if space - at > most:
                break
        if space is None:
            break
        parts.append(text[at:space])
        at = space
    return [*parts, text[at:]]


def _lengths(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(size[tokens])]


class Tree:
    """Tree concatenation over bytes, for one tokenizer."""

    def __init__(self, coder: tiktoken.Encoding) -> None:
        self.coder = coder
        self.encode: Callable[[bytes], np.ndarray] = lambda b: np.array(coder.encode_ordinary(b.decode()), np.int64)
        self.size = np.array([len(coder.decode_single_token_bytes(i)) if i in self._known() else 0 for i in range(coder.max_token_value + 1)])

    def _known(self) -> set[int]:
        if not hasattr(self, "_ids"):
            self._ids = set(self.coder._mergeable_ranks.values())
        return self._ids

    def join(self, left: np.ndarray, right: np.ndarray, text: bytes, middle: int) -> np.ndarray:
        """The encoding of ``text`` from those of its parts before and after byte ``middle``."""
        a, b = _lengths(left, self.size), middle + _lengths(right, self.size)
        reach = 8
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            while i > 0 and text[a[i]] & 0xC0 == 0x80:
                i -= 1
            while j < len(right) and text[b[j]] & 0xC0 == 0x80:
                j += 1
            window = self.encode(text[a[i] : b[j]])
            whole_left, whole_right = i == 0, j == len(right)
            edge = int(a[i]) + _lengths(window, self.size)
            head, tail = self._same(left[i:], window), self._same(right[:j][::-1], window[::-1])
            if whole_left and whole_right:
                return window
            enough = min(_AGREE, len(window))
            if (whole_left or head >= enough and edge[head] <= middle) and (whole_right or tail >= enough and edge[len(window) - tail] >= middle):
                return np.concatenate([left[:i], window, right[j:]])
            reach *= 2

    @staticmethod
    def _same(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def fold(self, parts: list[tuple[np.ndarray, bytes]]) -> np.ndarray:
        """Joins neighbouring parts pairwise until one is left."""
        while len(parts) > 1:
            pairs = [(self.join(x, y, s + t, len(s)), s + t) for (x, s), (y, t) in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0][0]

    def long(self, text: str, leaf: int) -> np.ndarray:
        """The encoding of any text through leaves of at most ``leaf`` characters."""
        out = []
        for part in cuts(text, leaf):
            if len(part) <= leaf:
                out.append(np.array(self.coder.encode_ordinary(part), np.int64))
            else:
                out.append(self.fold([(self.encode(s), s) for s in (x.encode() for x in halves(part, leaf))]))
        return np.concatenate(out) if out else np.empty(0, np.int64)


def halves(text: str, leaf: int) -> list[str]:
    """``text`` cut in half again and again, until no part is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf) + halves(text[middle:], leaf)


_trees: dict[bytes, Tree] = {}


def tree(vocabulary: bytes) -> Tree:
    if vocabulary not in _trees:
        _trees[vocabulary] = Tree(encoding(vocabulary))
    return _trees[vocabulary]


def _sent(docs: DataFrame, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


_TOKENS = T.ArrayType(T.IntegerType())


def _row(tokens: list[np.ndarray | list[int] | None]) -> pa.Array:
    return pa.array(tokens, pa.list_(pa.int32()))


def encode(docs: DataFrame, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for each row; ``exact``: the tokens decode to the very text.

    ``path`` is a rank file, read by the driver and broadcast (under 1 MB).
    """
    sent = _sent(docs, path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", id_type(docs, doc_id)), T.StructField("tokens", _TOKENS), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoding(sent.value)
        texts = batch.column(1).to_pylist()
        tokens = [None if t is None else coder.encode_ordinary(t) if len(t) <= leaf else tree(sent.value).long(t, leaf).tolist() for t in texts]
        exact = [None if t is None else coder.decode(x) == t for t, x in zip(texts, tokens)]
        return pa.RecordBatch.from_arrays([batch.column(0), _row(tokens), pa.array([None if x is None else len(x) for x in tokens], pa.int64()), pa.array(exact, pa.bool_())], schema.names)

    short = map_text(rows.where(F.col("text").isNull() | (F.length("text") <= spread)), "text", schema, run)
    return short.unionByName(_encode_spread(rows.where(F.length("text") > spread), sent, schema, leaf, spread))


def _encode_spread(rows: DataFrame, sent: Broadcast, schema: T.StructType, leaf: int, spread: int) -> DataFrame:
    """Like ``run`` in ``encode``, with each text cut into parts for many tasks."""
    kind = schema["doc_id"].dataType
    part_fields = [T.StructField("row", T.StringType()), T.StructField("doc_id", kind), T.StructField("part", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("text", T.StringType())]

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for i, part in enumerate(cuts(text, spread)):
                out += [(row, key, i, j, piece) for j, piece in enumerate(halves(part, spread))]
        row, key, part, piece, text = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(key, batch.column(1).type), pa.array(part, pa.int64()), pa.array(piece, pa.int64()), pa.array(text)], [f.name for f in part_fields])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [tree(sent.value).long(t, leaf).tolist() for t in batch.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, _row(tokens)], batch.schema.names + ["tokens"])

    def gather(table: pa.Table) -> pa.Table:
        t, parts = tree(sent.value), {}
        for part, piece, text, tokens in zip(*(table.column(c).to_pylist() for c in ("part", "piece", "text", "tokens"))):
            parts.setdefault(part, []).append((piece, np.array(tokens, np.int64), text.encode()))
        texts = [sorted(parts[i], key=lambda x: x[0]) for i in sorted(parts)]
        tokens = np.concatenate([t.fold([(x, s) for _, x, s in pieces]) for pieces in texts])
        exact = t.coder.decode(tokens.tolist()) == b"".join(s for pieces in texts for *_, s in pieces).decode()
        return pa.table([table.column("doc_id")[:1], _row([tokens]), pa.array([len(tokens)]), pa.array([exact])], schema.names)

    # The row's key is made once and written: a key made anew after a lost task would mix texts.
    keyed = stage(rows.select(F.expr("uuid()").alias("row"), "doc_id", "text"), "long_texts")
    cut = map_text(keyed, "text", T.StructType(part_fields), split).repartition(partitions(rows.sparkSession), "row", "part", "piece")
    coded = map_text(cut, "text", T.StructType([*part_fields, T.StructField("tokens", _TOKENS)]), run)
    return coded.groupBy("row").applyInArrow(gather, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """``encoded`` with a column ``text`` (replaced where there is one) of its decoded tokens."""
    sent = _sent(encoded, path)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        coder = encoding(sent.value)
        return pa.array([None if x is None else coder.decode(x) for x in column.to_pylist()], pa.string())

    return encoded.withColumn(text, run(F.col(tokens)))
