"""Functions of users for the SQL dialect."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Function = Callable[..., Any] | dict[str, Any]


def register(spark: SparkSession, functions: list[Function], returns: T.DataType | str = "string") -> list[str]:
    """Registers functions by the names they have in queries.

    A function is a callable (named like itself or its class, in lower case) or
    a dict ``name, function[, returns][, deterministic][, vectorised]``;
    vectorised ones get and return Series.
    """
    names = []
    for f in functions:
        spec = f if isinstance(f, dict) else {"function": f, "name": getattr(f, "__name__", type(f).__name__).lower()}
        call, kind = spec["function"], spec.get("returns", returns)
        if spec.get("vectorised"):
            udf = F.pandas_udf(call, kind)
        else:
            udf = F.udf(lambda *a, call=call: call(*a), kind, useArrow=True)
        if not spec.get("deterministic", True):
            udf = udf.asNondeterministic()
        spark.udf.register(spec["name"], udf)
        names.append(spec["name"])
    return names
