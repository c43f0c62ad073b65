"""Content: the tables ``sections``, ``documents`` and ``objects``, and how rows get into them."""

from __future__ import annotations

import json
import re
import uuid as ids
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMESPACE = ids.NAMESPACE_DNS


def uuid5(value: Column) -> Column:
    """The name-based id (SHA-1) of a text, without a UDF."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(value, "UTF-8")))
    third = F.concat(F.lit("5"), F.substring(digest, 14, 3))
    high = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), third, F.concat(F.lpad(high, 2, "0"), F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def numbered(rows: DataFrame, *order: str, start: int = 0, name: str = "indexid", ties: tuple[str, ...] = ()) -> DataFrame:
    """A dense number from ``start`` in the order of columns (then of ``ties``), without a single-partition sort.

    Rows are range-partitioned and numbered inside each partition; the
    partitions' sizes, one number each, give the offsets. This runs a job.
    """
    from corvane.sources.scratch import stage

    part, inside = "__part", "__inside"
    keyed = rows.repartitionByRange(*order).sortWithinPartitions(*order, *(t for t in ties if t not in order)).withColumn(part, F.spark_partition_id())
    keyed = keyed.withColumn(inside, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    keyed = stage(keyed, "numbered")
    sizes = keyed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(part, (F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("offset"))
    return keyed.join(F.broadcast(offsets), part).select(*rows.columns, (F.col("offset") + F.col(inside)).alias(name))


def _merged(a: T.StructType | None, b: T.StructType | None) -> T.StructType | None:
    """Columns of both; those whose types differ, and all where a side isn't known, are left out."""
    if a is None or b is None:
        return None
    return T.StructType([f for f in a if f.name not in b.names or b[f.name].dataType == f.dataType] + [f for f in b if f.name not in a.names])


@dataclass
class Columns:
    """Which columns hold what: ``store`` limits what is kept of each document (None: all; empty: nothing)."""

    text: str = "text"
    object: str = "object"
    store: list[str] | None = None


@dataclass
class Content:
    """Tables of one index. All are plain DataFrames; changes give new ones."""

    sections: DataFrame
    documents: DataFrame
    objects: DataFrame | None = None
    columns: Columns = field(default_factory=Columns)
    offset: int = 0
    schema: T.StructType | None = None

    @classmethod
    def of(cls, docs: DataFrame, id: str | None, columns: Columns | None = None, tags: str | None = None, order: list[str] | None = None, offset: int = 0, now: datetime | None = None, autoid: str = "int", idtext: bool = False) -> Content:
        """Content from a table of documents.

        All rows go to ``documents`` (of rows with one id the last in order);
        those with text (else an object) get a section and an indexid. Without
        an id, rows get numbers, or name-based ids (``autoid`` "uuid5"). A row
        whose id is null gets the name-based id of its text and data, so such
        rows stay apart unless they are equal. With ``idtext`` a row without
        text or object has its id as text. An empty table gives empty ones.
        """
        columns = columns or Columns()
        entry = F.lit(now) if now else F.current_timestamp()
        names = [c for c in docs.columns if columns.store is None or c in columns.store]
        text = F.col(columns.text) if columns.text in docs.columns else F.lit(None).cast("string")
        if columns.text in docs.columns and dict(docs.dtypes)[columns.text].startswith("array"):
            text = F.array_join(text, " ")
        obj = F.col(columns.object) if columns.object in docs.columns else F.lit(None).cast("binary")
        data = F.to_json(F.struct(*names)) if names else F.lit(None).cast("string")
        named = uuid5(F.concat_ws("\x1f", text.cast("string"), data))
        key = F.coalesce(F.col(id).cast("string"), named) if id else uuid5(text.cast("string")) if autoid == "uuid5" else F.lit(None).cast("string")
        rows = docs.select(key.alias("id"), text.cast("string").alias("text"), obj.cast("binary").alias("object"), data.alias("data"), (F.col(tags).cast("string") if tags else F.lit(None).cast("string")).alias("tags"), entry.alias("entry"), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order or ([id] if id else []))))
        sort = [c for c in rows.columns if c.startswith("__o")] or ["text", "data"]
        if not id and autoid == "int":
            rows = numbered(rows, *sort, start=offset, name="n").withColumn("id", F.col("n").cast("string")).drop("n")
        rows = rows if not (idtext and id) else rows.withColumn("text", F.when(F.col("text").isNull() & F.col("object").isNull(), F.col("id")).otherwise(F.col("text")))
        indexed = numbered(rows.where("text is not null or object is not null"), *sort, start=offset, ties=("text", "data"))
        sections = indexed.select("indexid", "id", "text", "tags", "entry")
        # The last row of an id, found by a partial aggregation: an id that many rows share isn't sorted.
        order = F.struct(*(F.col(c) for c in sort), F.col("text"), F.col("data"))
        stored = rows.groupBy("id").agg(F.max_by(F.struct("data", "tags", "entry", "object"), order).alias("r")).select("id", "r.*")
        objects = stored.where("object is not null").select("id", "object", "tags", "entry") if columns.object in docs.columns else None
        return cls(sections, stored.select("id", "data", "tags", "entry"), objects, columns, offset, T.StructType([docs.schema[c] for c in names]))

    def typed(self, path: str) -> str | None:
        """The Spark type of a path of the documents, where the columns that they came from say it."""
        kind: T.DataType | None = self.schema
        for part in re.findall(r"\[\d+\]|[^.\[\]]+", path):
            if part.startswith("["):
                kind = kind.elementType if isinstance(kind, T.ArrayType) else None
            elif isinstance(kind, T.MapType):
                kind = kind.valueType
            else:
                kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.names else None
        if isinstance(kind, T.IntegralType):
            return "bigint"
        if isinstance(kind, T.FractionalType):
            return "double"
        return "boolean" if isinstance(kind, T.BooleanType) else "string" if isinstance(kind, (T.StringType, T.DatetimeType)) else None

    def delete(self, gone: DataFrame) -> Content:
        """Less the ids in ``gone`` (id)."""
        gone = gone.select(F.col("id").cast("string").alias("id")).distinct()
        without = lambda t: None if t is None else t.join(gone, "id", "left_anti").select(t.columns)
        return replace(self, sections=without(self.sections), documents=without(self.documents), objects=without(self.objects))

    def upsert(self, other: Content) -> Content:
        """With the rows of ``other``, whose ids replace old ones; its sections are numbered after the greatest number here."""
        last = self.sections.agg(F.max("indexid")).first()[0]
        start = self.offset if last is None else last + 1
        kept = self.delete(other.documents)
        new = numbered(other.sections.withColumnRenamed("indexid", "__o"), "__o", start=start).select(self.sections.columns)
        objects = kept.objects if other.objects is None else other.objects if kept.objects is None else kept.objects.unionByName(other.objects)
        return Content(kept.sections.unionByName(new), kept.documents.unionByName(other.documents), objects, self.columns, start, _merged(self.schema, other.schema))

    def reindex(self) -> Content:
        """With numbers made dense again from 0, in the old order."""
        rows = numbered(self.sections.withColumnRenamed("indexid", "__old"), "__old").drop("__old").select("indexid", "id", "text", "tags", "entry")
        return replace(self, sections=rows, offset=0)

    def indexids(self, wanted: DataFrame) -> DataFrame:
        """(id, indexid) of ids."""
        return self.sections.join(wanted.select(F.col("id").cast("string").alias("id")).distinct(), "id").select("id", "indexid")

    def count(self) -> int:
        return self.sections.count()

    def save(self, path: str) -> None:
        """All tables as Parquet under ``path``; the description is written last, so a half-written index can't be opened."""
        spark = self.sections.sparkSession
        self.sections.write.mode("overwrite").parquet(f"{path}/sections")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        if self.objects is not None:
            self.objects.write.mode("overwrite").parquet(f"{path}/objects")
        config = {"text": self.columns.text, "object": self.columns.object, "store": self.columns.store, "offset": self.offset, "objects": self.objects is not None, "schema": self.schema.json() if self.schema else None}
        spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    def save_jdbc(self, url: str, properties: dict[str, str] | None = None, prefix: str = "") -> None:
        """The tables in a relational database, which are replaced; ``url`` and ``properties`` as JDBC has them."""
        for name in ("sections", "documents", "objects"):
            if (table := getattr(self, name)) is not None:
                table.write.jdbc(url, prefix + name, "overwrite", properties or {})

    @classmethod
    def load_jdbc(cls, spark: SparkSession, url: str, properties: dict[str, str] | None = None, prefix: str = "", objects: bool = False, columns: Columns | None = None) -> Content:
        """Tables of a relational database; ``sections`` is read in ranges of indexid, by as many tasks as there are cores."""
        found = [spark.read.jdbc(url, prefix + name, properties=properties or {}) for name in ("sections", "documents", *(["objects"] if objects else []))]
        found = [t.toDF(*(c.lower() for c in t.columns)) for t in found]
        lo, hi = found[0].agg(F.min("indexid"), F.max("indexid")).first()
        if lo is not None and hi > lo:
            ranged = spark.read.jdbc(url, prefix + "sections", "indexid", lo, hi + 1, spark.sparkContext.defaultParallelism, properties=properties or {})
            found[0] = ranged.toDF(*(c.lower() for c in ranged.columns))
        return cls(found[0], found[1], found[2] if objects else None, columns or Columns())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Content:
        config = json.loads(spark.read.text(f"{path}/config").first()[0])
        objects = spark.read.parquet(f"{path}/objects") if config["objects"] else None
        return cls(spark.read.parquet(f"{path}/sections"), spark.read.parquet(f"{path}/documents"), objects, Columns(config["text"], config["object"], config["store"]), config["offset"], T.StructType.fromJson(json.loads(config["schema"])) if config.get("schema") else None)
