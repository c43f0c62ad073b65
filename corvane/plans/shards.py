"""Merging results of shards that ran one query each."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.dialect import Rewriter


def merge_shards(shards: list[DataFrame], naive_average: bool = False, order: list[tuple[str, bool]] | None = None, limit: int | None = None) -> DataFrame:
    """One result from the same query's results of several shards.

    Columns named like aggregates are merged: count, sum and total by sum, min,
    max; other columns are the groups. An average can't be merged from averages:
    keep sum and count instead, or accept their unweighted mean (``naive_average``).
    """
    rows = reduce(DataFrame.unionByName, shards)
    kinds = {c: m[1].lower() if (m := re.match(r"(?i)(count|sum|total|min|max|avg)\(", c)) else None for c in rows.columns}
    if any(kinds.values()):
        if not naive_average and "avg" in kinds.values():
            raise ValueError("averages of shards can't be merged; select sum and count")
        how = {"count": F.sum, "sum": F.sum, "total": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
        quoted = lambda c: F.col(f"`{c}`")
        rows = rows.groupBy(*(quoted(c) for c, k in kinds.items() if not k)).agg(*(how[k](quoted(c)).alias(c) for c, k in kinds.items() if k)).select(*(quoted(c) for c in kinds))
    elif "score" in rows.columns and not order:
        order = [("score", True)]
    if order:
        rows = rows.orderBy(*(F.desc(f"`{c}`") if down else F.asc(f"`{c}`") for c, down in order))
    return rows.limit(limit) if limit else rows


def order_of(query: str) -> list[tuple[str, bool]]:
    """The ORDER BY of a query as (column, descending)."""
    text = Rewriter()(query).orderby or ""
    found = [re.fullmatch(r"(?i)(?:[scod]\.)?(\w+)(?:\s+(asc|desc))?", x.strip()) for x in text.split(",") if x.strip()]
    return [(m[1], (m[2] or "").lower() == "desc") for m in found if m]


def shard_of(id: str, shards: int) -> int:
    """The shard that an id belongs to."""
    import zlib

    return zlib.adler32(id.encode()) % shards
