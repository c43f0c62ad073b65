"""Templates with named places, filled by columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, columns: dict[str, Column], strict: bool = True) -> Column:
    """``template`` with each ``{name}`` replaced by a column; a null prints as an empty string.

    With ``strict`` a column that has no place raises KeyError; a place without a column always does.
    """
    parts: list[Column] = []
    used = set()
    for text, name, *_ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
            used.add(name)
    if strict and (unused := set(columns) - used):
        raise KeyError(f"no place for {', '.join(sorted(unused))}")
    return F.concat(*parts) if parts else F.lit("")


def rules(value: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    """The case equal to ``value``, else ``otherwise``."""
    out = F
    for key, then in cases.items():
        out = out.when(value == key, then)
    return out.otherwise(otherwise) if cases else otherwise
