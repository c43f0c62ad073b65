"""What comes before and after a model: any callable of a batch of texts plugs in, in Arrow batches.

Defined results: null texts never reach a model and have null results; empty
tables give empty ones; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[pd.Series], Any]
_SPANS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))


def _run(model: Model, kind: T.DataType, *columns: Column, skip: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """The model's results where all columns are there; ``skip`` says which of the first column's rows stay as they are."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        some = pd.concat(series, axis=1).notna().all(axis=1)
        out = pd.Series([None] * len(some), dtype=object)
        if skip is not None:
            same = some & skip(series[0].fillna(""))
            out[same] = series[0][same]
            some &= ~same
        if some.any():
            out[some] = pd.Series(list(model(*(s[some].reset_index(drop=True) for s in series))), index=some.index[some], dtype=object)
        return out

    return run(*columns)


def entities(text: Column, model: Model, labels: list[str] | None = None, least: float = 0.0) -> Column:
    """(text, label, score) of what a model finds in each text, of some labels only, from a score on."""
    found = _run(model, _SPANS, text)
    return F.filter(found, lambda x: (x["score"] >= least) & (x["label"].isin(labels) if labels else F.lit(True)))


def summary(text: Column, model: Model, least: int = 50) -> Column:
    """Summaries; texts of fewer than ``least`` words stay as they are."""
    return _run(model, T.StringType(), text, skip=lambda s: s.str.split().str.len() < least)


def answer(question: Column, context: Column, model: Model, least: float = 0.05) -> Column:
    """Extractive answers by a model of (questions, contexts) to (answer, score); null under a score of ``least``."""
    kind = T.ArrayType(T.StructType([T.StructField("answer", T.StringType()), T.StructField("score", T.DoubleType())]))
    found = _run(lambda q, c: [[dict(zip(("answer", "score"), x))] for x in model(q, c)], kind, question, context)[0]
    return F.when(found["score"] >= least, found["answer"])


def translated(text: Column, detect: Model, models: dict[str, Model], target: str = "en") -> Column:
    """Translations: languages are detected, then each language's texts of a batch go to its model; texts of the target or without a model stay."""

    def run(s: pd.Series) -> list[str]:
        languages = pd.Series(list(detect(s)), index=s.index)
        out = s.copy()
        for language, part in s.groupby(languages):
            if language != target and language in models:
                out[part.index] = list(models[language](part.reset_index(drop=True)))
        return out.tolist()

    return _run(run, T.StringType(), text)


def similar(rows: DataFrame, text: str, queries: list[str], model: Callable[[pd.Series, str], Any]) -> DataFrame:
    """(qid, score and all columns): how well each query fits each text, by a model of (texts, query); queries are few and go one after the other in a batch."""
    kind = T.ArrayType(T.DoubleType())
    scores = _run(lambda s: list(zip(*(model(s, q) for q in queries))) if queries else [[] for _ in s], kind, F.col(text))
    return rows.select("*", F.posexplode(scores).alias("qid", "score"))


def labelled(rows: DataFrame, label: str = "label", out: str = "label_id") -> tuple[DataFrame, list[str]]:
    """Rows with labels as numbers from 0 in order of their names, and the names (few, on the driver); null labels have null numbers."""
    names = [r[0] for r in rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().orderBy(label).collect()]
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col(label).cast("string")) - 1 if names else F.lit(None)
    return rows.withColumn(out, number.cast("long")), names
