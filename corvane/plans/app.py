"""An application from a configuration: an index, functions, and workflows by name.

    writable: true
    path: s3a://bucket/index            # where the index is kept; optional
    index: {keyword: true, dense: true, columns: {text: body}}
    graph: {limit: 15, minscore: 0.1, topics: {terms: 4}}
    workflow:
      clean:
        tasks:
          - action: [lower, trim]       # functions by name, each applied to ``data``
            select: "\\.txt$"
          - action: index               # index, upsert, search: the application's own verbs
        schedule: {iterations: 3}

Tasks may also have ``merge``, ``column``, ``explode`` and ``template``. Functions
are Spark's own of one column, or those given to the application by name.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.segment import segments
from corvane.functions.vectors import Encoder
from corvane.operators.workflow import Task, Workflow, templated
from corvane.plans.engine import Index, IndexNotFoundError, ReadOnlyError, Settings, read_settings, stored_settings
from corvane.sources.content import Columns


def read_config(text: str) -> dict[str, Any]:
    """A configuration of JSON, or of YAML where a reader for it is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


class App:
    """What a configuration describes. Documents that were added wait until ``index`` or ``upsert``."""

    def __init__(self, spark: SparkSession, config: dict[str, Any] | str, functions: dict[str, Callable[[Column], Column]] | None = None, encoder: Encoder | None = None) -> None:
        self.spark, self.config, self.encoder = spark, read_config(config) if isinstance(config, str) else config, encoder
        self.functions = functions or {}
        self.waiting: list[DataFrame] = []
        self.current: Index | None = None
        columns = Columns(**self.config.get("index", {}).get("columns", {}))
        self.settings = read_settings({**stored_settings(Settings()), **self.config.get("index", {}), "columns": vars(columns)})
        self.workflows = {name: Workflow([self._task(t) for t in w["tasks"]]) for name, w in self.config.get("workflow", {}).items()}

    def _function(self, name: str) -> Callable[[Column], Column]:
        if name in self.functions:
            return self.functions[name]
        if name in ("lines", "paragraphs", "sections", "sentences"):
            return lambda x: segments(x, name)
        if hasattr(F, name):
            return getattr(F, name)
        raise KeyError(f"no function {name}")

    def _task(self, config: dict[str, Any]) -> Callable[[DataFrame], DataFrame]:
        if "template" in config:
            return templated(config["template"], config.get("columns", {}), config.get("strict", True))
        names = [config["action"]] if isinstance(config.get("action"), str) else config.get("action", [])
        verbs = {"index": self._stored(self.index), "upsert": self._stored(self.upsert), "search": lambda rows: self.batchsearch(rows, **config.get("args", {}))}
        if len(names) == 1 and names[0] in verbs:
            return verbs[names[0]]
        return Task([self._function(n) for n in names], **{k: v for k, v in config.items() if k in ("select", "merge", "explode", "column")})

    def _stored(self, verb: Callable[[], Index]) -> Callable[[DataFrame], DataFrame]:
        def run(rows: DataFrame) -> DataFrame:
            self.add(rows.select("id", "data.*") if dict(rows.dtypes)["data"].startswith("struct") else rows.select("id", F.col("data").alias(self.settings.columns.text)))
            verb()
            return rows

        return run

    # Verbs

    def _writable(self) -> None:
        if not self.config.get("writable", False):
            raise ReadOnlyError("the application isn't writable")

    def add(self, docs: DataFrame) -> None:
        """Documents (with a column ``id``) for the next ``index`` or ``upsert``."""
        self._writable()
        self.waiting.append(docs)

    def _added(self) -> DataFrame:
        rows = self.waiting[0]
        for more in self.waiting[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        self.waiting = []
        return rows

    def index(self) -> Index:
        """A new index of what was added."""
        self._writable()
        out = Index.of(self._added(), "id", self.settings, encoder=self.encoder)
        if "graph" in self.config and out.vectors is not None:
            graph = dict(self.config["graph"])
            topics = graph.pop("topics", None)
            out = out.with_graph(**graph)
            out = out.with_topics(**topics) if topics is not None else out
        return self._keep(out)

    def upsert(self) -> Index:
        """The index with what was added; a new one where there is none."""
        self._writable()
        return self._keep(self._open().upsert(self._added(), "id")) if self._open(False) is not None else self.index()

    def delete(self, ids: list[str]) -> Index:
        self._writable()
        return self._keep(self._open().delete(ids))

    def _keep(self, index: Index) -> Index:
        """The index, written as the next version where the configuration says where to."""
        self.current = index
        if path := self.config.get("path"):
            number = (self._latest(path) or 0) + 1
            index.save(f"{path}/v{number}")
            self.current = Index.load(self.spark, f"{path}/v{number}", encoder=self.encoder)
        return self.current

    def _latest(self, path: str) -> int | None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/index/_SUCCESS"))), default=None)

    def _open(self, must: bool = True) -> Index | None:
        if self.current is None and (path := self.config.get("path")) and (number := self._latest(path)):
            self.current = Index.load(self.spark, f"{path}/v{number}", encoder=self.encoder)
        if self.current is None and must:
            raise IndexNotFoundError("nothing has been indexed")
        return self.current

    def search(self, query: str, limit: int = 10, **options: Any) -> DataFrame:
        """The rows of a query; ``limit`` is held between 1 and 250, as interfaces to the outside do."""
        return self._open().search(query, max(1, min(250, limit)), **options)

    def batchsearch(self, queries: DataFrame | list[str], limit: int = 10, **options: Any) -> DataFrame:
        texts = queries if isinstance(queries, list) else [r["data"] for r in queries.select("data").collect()]
        return self._open().batchsearch(texts, max(1, min(250, limit)), **options)

    def count(self) -> int:
        return self.current.count() if self._open(False) is not None else 0

    def explain(self, query: str, limit: int = 10) -> DataFrame:
        return self._open().explain(query, limit)

    def transform(self, texts: list[str]) -> list[list[float]]:
        return self._open().transform(texts)

    def workflow(self, name: str, rows: DataFrame, action: Callable[[DataFrame], object] = lambda df: df.collect()) -> object:
        """Runs a workflow over (id, data) and gives what ``action`` makes of the result; with a schedule, the errors of its turns."""
        schedule = self.config["workflow"][name].get("schedule")
        if schedule:
            return self.workflows[name].schedule(lambda: rows, action, schedule.get("iterations", 1))
        return self.workflows[name].run(rows, action)
