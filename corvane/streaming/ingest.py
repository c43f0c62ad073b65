"""Incremental ingest: each micro-batch adds its own rows to a stored index.

An index is a folder of versions. A version holds the content of one batch and
where its numbers start, so writing costs what the batch costs, whatever the
index holds. A reader takes all versions and leaves out rows whose id a later
version has; ``compact`` writes a version that stands for all before it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.content import Columns, Content


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of an index under ``path``, oldest first."""
    jvm, root, fs = _hadoop(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/state/_SUCCESS"))]
    return sorted(done)


def _state(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/v{version}/state").first()[0])


def _write(content: Content, path: str, version: int, whole: bool) -> None:
    """A version; its state, written last, makes it count."""
    spark = content.sections.sparkSession
    content.save(f"{path}/v{version}")
    last = spark.read.parquet(f"{path}/v{version}/sections").agg(F.max("indexid")).first()[0]
    state = {"next": content.offset if last is None else last + 1, "whole": whole}
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/v{version}/state")


def latest(spark: SparkSession, path: str, upto: int | None = None) -> Content | None:
    """The content that all versions (up to one) make together, the last row of each id."""
    found = [v for v in versions(spark, path) if upto is None or v <= upto]
    states = {v: _state(spark, path, v) for v in found}
    found = found[max((i for i, v in enumerate(found) if states[v]["whole"]), default=0) :]
    if not found:
        return None
    parts = [Content.load(spark, f"{path}/v{v}") for v in found]
    tag = lambda df, v: df.withColumn("__version", F.lit(v))
    union = lambda tables: None if not tables else tables[0] if len(tables) == 1 else union([tables[0].unionByName(tables[1]), *tables[2:]])
    last = union([tag(p.documents.select("id"), v) for p, v in zip(parts, found)]).groupBy("id").agg(F.max("__version").alias("__version"))
    newest = lambda tables: None if tables is None else tables.join(last, ["id", "__version"]).drop("__version")
    sections, documents = (newest(union([tag(getattr(p, n), v) for p, v in zip(parts, found)])) for n in ("sections", "documents"))
    objects = newest(union([tag(p.objects, v) for p, v in zip(parts, found) if p.objects is not None]))
    order = lambda df, like: None if df is None else df.select(like.columns)
    kept = next((p.objects for p in parts if p.objects is not None), None)
    return Content(order(sections, parts[0].sections), order(documents, parts[0].documents), order(objects, kept), parts[-1].columns, states[found[-1]]["next"], parts[-1].schema)


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites the last version so that it stands for all before it, and deletes those."""
    found = versions(spark, path)
    if len(found) < 2:
        return
    whole = latest(spark, path)
    _write(whole, path, found[-1] + 1, True)
    jvm, _, fs = _hadoop(spark, path)
    for v in found:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)


def ingest(stream: DataFrame, id: str, path: str, checkpoint: str, tags: str | None = None, columns: Columns | None = None, available_now: bool = True) -> StreamingQuery:
    """Upserts a stream of documents into the index under ``path``.

    Batch ``n`` writes version ``2 n + 1`` (what is between is left to
    ``compact``), so a batch that runs again after a failure writes the same
    version and nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = 2 * number + 1
        before = [v for v in versions(spark, path) if v < version]
        start = _state(spark, path, before[-1])["next"] if before else 0
        _write(Content.of(batch, id, columns, tags, offset=start), path, version, False)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
