"""Workflows: chains of tasks over a column ``data``; other columns pass through.

Defined results: a null ``data`` goes to the actions as null (a text for which
``select`` is null passes unchanged); null and empty arrays explode to no row;
repeated rows stay; empty tables give empty ones with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.template import fill

Action = Callable[[Column], Column]


def text_of(x: Column) -> Column:
    """A value's text where it counts as true (not null, empty, zero or false), else null."""
    s = x.cast("string")
    return F.when(~s.isin("", "0", "0.0", "false"), s)


def concat(columns: list[Column], separator: str = ". ") -> Column:
    """The texts of the columns that count as true, joined."""
    return F.concat_ws(separator, *(text_of(c) for c in columns))


@dataclass
class Task:
    """Actions on ``data``, merged ``hstack`` (a struct), ``vstack`` (a row each), ``concat`` (a text) or None (columns out0, out1, ...).

    ``select``: a regular expression; rows whose text in lower case doesn't
    match pass unchanged. ``explode``: an array result becomes rows. ``column``:
    the field of ``data`` that each action gets, by name or by place.
    ``initialize`` and ``finalize`` are called before and after ``Workflow.run``.
    """

    actions: list[Action] = field(default_factory=list)
    select: str | None = None
    merge: str | None = "hstack"
    explode: bool = True
    column: list[str | int] | None = None
    initialize: Callable[[], None] | None = None
    finalize: Callable[[], None] | None = None

    def inputs(self, rows: DataFrame) -> list[Column]:
        if self.column:
            kind = rows.schema["data"].dataType
            return [F.col("data")[kind.names[c] if isinstance(c, int) and isinstance(kind, T.StructType) else c] for c in self.column]
        return [F.col("data")] * len(self.actions)

    def __call__(self, rows: DataFrame) -> DataFrame:
        if not self.actions:
            return rows
        outs = [f(x) for f, x in zip(self.actions, self.inputs(rows))]
        others = [c for c in rows.columns if c != "data"]
        if len(outs) == 1:
            new = outs[0]
            if self.select:
                new = F.when(F.lower(F.col("data").cast("string")).rlike(self.select), new).otherwise(F.col("data"))
            out = rows.select(*others, new.alias("data"))
            if self.explode and dict(out.dtypes)["data"].startswith("array"):
                out = out.withColumn("data", F.explode("data"))
            return out
        if self.merge == "hstack":
            new = F.struct(*(o.alias(f"c{i}") for i, o in enumerate(outs)))
        elif self.merge == "vstack":
            return rows.select(*others, F.explode(F.array(*outs)).alias("data"))
        elif self.merge == "concat":
            new = concat(outs)
        else:
            return rows.select(*others, *(o.alias(f"out{i}") for i, o in enumerate(outs)))
        return rows.select(*others, new.alias("data"))


def accepts(kind: str, x: Column) -> Column:
    """Whether a text looks like a ``url``, an ``image`` or a ``file``."""
    pattern = {"url": r"^\w+://", "image": r"(?i)\.(gif|bmp|jpg|jpeg|png|webp)$", "file": r"^(?:file://|/|\.{1,2}/)"}[kind]
    return x.rlike(pattern)


@dataclass
class Workflow:
    """Tasks one after the other; a workflow is a task too."""

    tasks: list[Callable[[DataFrame], DataFrame]]

    def __call__(self, rows: DataFrame) -> DataFrame:
        """The plan; no row is processed and no hook is called yet."""
        for t in self.tasks:
            rows = rows.transform(t)
        return rows

    def hooks(self, name: str) -> list[Callable[[], None]]:
        """The hooks of all tasks, also of workflows among them."""
        found = [t.hooks(name) if isinstance(t, Workflow) else [h] if (h := getattr(t, name, None)) else [] for t in self.tasks]
        return [h for hs in found for h in hs]

    def run(self, rows: DataFrame, action: Callable[[DataFrame], object]) -> object:
        """``action`` over the result, between the tasks' ``initialize`` and ``finalize``, which is called even after an error."""
        for h in self.hooks("initialize"):
            h()
        try:
            return action(self(rows))
        finally:
            for h in self.hooks("finalize"):
                h()

    def schedule(self, rows: Callable[[], DataFrame], run: Callable[[DataFrame], object], iterations: int, wait: Callable[[], None] | None = None) -> list[str]:
        """Runs over new input several times; an error ends only its own turn. Returns the errors."""
        errors = []
        for _ in range(iterations):
            try:
                self.run(rows(), run)
            except Exception as e:
                errors.append(f"{datetime.now():%Y-%m-%d %H:%M:%S} {type(e).__name__}: {e}")
            if wait:
                wait()
        return errors


def templated(template: str, columns: dict[str, str], strict: bool = True) -> Task:
    """A task that fills a template from fields of ``data`` (name in the template to field)."""
    return Task([lambda x: fill(template, {name: x[c] for name, c in columns.items()}, strict)])


def export(rows: DataFrame, path: str, kind: str = "csv", stamp: datetime | None = None) -> str:
    """Rows as CSV, JSON or Parquet files; ``stamp`` goes into the folder's name, which is returned."""
    if stamp:
        path = f"{path.rstrip('/')}-{stamp:%Y%m%d%H%M%S}"
    rows.write.mode("overwrite").format(kind).option("header", True).save(path)
    return path
