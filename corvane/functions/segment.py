"""Lines, paragraphs, sections and sentences of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = {"lines": r"(?:\r?\n)+", "paragraphs": r"(?:\r?\n){2,}", "sections": r"\f|(?:\r?\n){3,}", "sentences": r"(?<=[.!?])\s+"}


def clean(text: Column) -> Column:
    """Spaces collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def segments(text: Column, by: str, minlength: int = 0, join: bool = False, cleantext: bool = True) -> Column:
    """The non-empty segments of ``text`` by ``lines``, ``paragraphs``, ``sections`` or ``sentences``.

    ``minlength`` drops shorter ones; ``join`` puts them into one string.
    """
    parts = F.split(text, BREAKS[by])
    if cleantext:
        parts = F.transform(parts, clean)
    parts = F.filter(parts, lambda x: (F.length(x) >= max(1, minlength)) & (x != ""))
    return F.array_join(parts, " ") if join else parts


def chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` words, each with the last ``overlap`` words of the one before; the last may be shorter. Null for null, none without words."""
    if not 0 <= overlap < size:
        raise ValueError("a window has to be longer than its overlap")
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - overlap), F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))).when(text.isNotNull(), F.array().cast("array<string>"))
