"""Tokenizers as Column expressions; only Unicode segmentation needs a UDF."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that English search engines leave out by default.
STOP_WORDS = sorted("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
STRIP = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
ALPHANUM = r"^[0-9]*[a-z][\-.0-9:_a-z]+$"
#: Splitting at ``SPACE``, ``STRIP`` and ``ALPHANUM`` in one match over the whole text.
_PUNCTUATION, _SPACES = r"[!-/:-@\[-`{-~]", SPACE[1:-2]
TOKEN = rf"(?<![^{_SPACES}]){_PUNCTUATION}*+([0-9]*+[a-z](?:[\-.0-9:_a-z]*[0-9a-z]))(?={_PUNCTUATION}*+(?:[{_SPACES}]|$))"


def _without(tokens: Column, stopwords: bool | list[str]) -> Column:
    words = STOP_WORDS if stopwords is True else stopwords
    return F.filter(tokens, lambda x: ~x.isin(words)) if words else tokens


def whitespace(text: Column, lowercase: bool = True, stopwords: bool | list[str] = False) -> Column:
    """Tokens between spaces."""
    tokens = F.split(F.lower(text) if lowercase else text, SPACE)
    return _without(F.filter(tokens, lambda x: x != ""), stopwords)


def alphanum(text: Column, stopwords: bool | list[str] = True) -> Column:
    """Lower-case Latin tokens of two characters or more with a letter before the last, without stop words.

    A null text gives null.
    """
    words = STOP_WORDS if stopwords is True else stopwords or []
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))
    return F.filter(tokens, lambda x: ~x.isin(words)) if words else tokens


def pattern(text: Column, regexp: str, lowercase: bool = True, stopwords: bool | list[str] = False) -> Column:
    """All matches of a regular expression."""
    return _without(F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(regexp), F.lit(0)), stopwords)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}\p{M}_]+"), lambda x: x != "")


def ngrams(text: Column, nmin: int = 3, nmax: int | None = None, lpad: str = "", rpad: str = "", unique: bool = False, edge: bool = False, lowercase: bool = True) -> Column:
    """Character n-grams of each (padded) word: all of ``nmin`` characters from left to right, then of one more, up to ``nmax``."""
    nmax = nmax or nmin
    words = F.transform(_words(F.lower(text) if lowercase else text), lambda x: F.concat(F.lit(lpad), x, F.lit(rpad)))

    def one(word: Column) -> Column:
        sizes = F.sequence(F.lit(nmin), F.least(F.lit(nmax), F.length(word)))
        starts = lambda n: F.sequence(F.lit(1), F.lit(1) if edge else F.length(word) - n + 1)
        grams = F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.substring(word, i, n))))
        return F.when(F.length(word) >= nmin, grams).otherwise(F.array().cast("array<string>"))

    out = F.flatten(F.transform(words, one))
    return F.array_distinct(out) if unique else out


def ngram_summary(text: Column, nmin: int, nmax: int, lowercase: bool = True) -> Column:
    """How many ``ngrams`` a text has, how many kinds, the least and the greatest; grams are never rows or arrays.

    Words are split by built-ins; a word that recurs in its text is cut once.
    """

    def one(words: list[str] | None) -> dict | None:
        if words is None:
            return None
        n = sum(max(0, len(w) - k + 1) for w in words for k in range(nmin, nmax + 1))
        kinds = {w[i : i + k] for w in set(words) for k in range(nmin, nmax + 1) for i in range(len(w) - k + 1)}
        return {"n": n, "kinds": len(kinds), "least": min(kinds, default=None), "greatest": max(kinds, default=None)}

    kind = pa.struct([("n", pa.int64()), ("kinds", pa.int64()), ("least", pa.string()), ("greatest", pa.string())])

    @F.arrow_udf("n long, kinds long, least string, greatest string")
    def run(s: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([one(w) for w in s.slice(at, 100).to_pylist()], kind) for at in range(0, len(s), 100)]) if len(s) else pa.array([], kind)

    return run.asNondeterministic()(_words(F.lower(text) if lowercase else text))  # else each use of a field runs it again


def unicode_words(text: Column, lowercase: bool = True, emoji: bool = True) -> Column:
    """Words by the Unicode segmentation rules; no built-in knows them, so it is a vectorised UDF."""
    source = rf"[{chr(92)}w{r'\p{Extended_Pictographic}\p{WB:RegionalIndicator}' if emoji else ''}](?:\B\S)*"

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(s: pa.Array) -> pa.Array:
        import regex

        return _found(s, regex.compile(source, flags=regex.WORD).findall)

    return run(F.lower(text) if lowercase else text)


def _found(texts: pa.Array, find: Callable[[str], list[str]], most: int = 1 << 20) -> pa.Array:
    """What ``find`` gives for each text, null for null, as an array of lists; about ``most`` bytes of text are words in Python at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    parts, at, kind = [], 0, pa.list_(pa.string())
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        parts.append(pa.array([None if x is None else find(x) for x in texts.slice(at, to - at).to_pylist()], kind))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


TOKENIZERS = {"alphanum": alphanum, "whitespace": whitespace, "unicode": unicode_words}
