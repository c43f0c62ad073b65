"""Tables of rows as documents."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.markdown import markdown
from corvane.functions.segment import segments
from corvane.operators.workflow import concat


def documents(rows: DataFrame, id: str | None = None, text: list[str] | None = None, content: list[str] | bool | None = None) -> DataFrame:
    """(id, text[, data]): the text columns that count as true, joined by ". ".

    Without ``text``, all columns but the id. ``content``: also a JSON of these
    columns (True: all).
    """
    text = text or [c for c in rows.columns if c != id]
    out = [F.col(id).cast("string").alias("id") if id else F.expr("uuid()").alias("id"), concat([F.col(c) for c in text]).alias("text")]
    if content:
        out.append(F.to_json(F.struct(*(rows.columns if content is True else content))).alias("data"))
    return rows.select(*out)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header, under a given schema (nothing is inferred)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def within(path: str, allowed: str) -> bool:
    """Whether a path lies in a folder, compared part by part; a path with ``..`` lies in none."""
    at, root = urlsplit(path), urlsplit(allowed)
    parts, top = [[p for p in x.path.split("/") if p not in ("", ".")] for x in (at, root)]
    return (at.scheme, at.netloc) == (root.scheme, root.netloc) and ".." not in parts and parts[: len(top)] == top and at.path.startswith("/") == root.path.startswith("/")


def read_files(spark: SparkSession, path: str, allowed: str) -> DataFrame:
    """(path, content) of files under an allowed folder."""
    if not within(path, allowed):
        raise ValueError(f"{path} is not in {allowed}")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def list_files(spark: SparkSession, path: str, allowed: str) -> DataFrame:
    """(path, length, modificationTime) of files under an allowed folder, without reading them."""
    if not within(path, allowed):
        raise ValueError(f"{path} is not in {allowed}")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def read_segments(spark: SparkSession, path: str, allowed: str, by: str | None = "paragraphs", minlength: int = 0) -> DataFrame:
    """(path, pos, text) of text and HTML files under an allowed folder: HTML as Markdown, then cut into segments (None: whole).

    Bytes that aren't UTF-8 are read as replacement characters; empty files have no segments.
    """
    rows = read_files(spark, path, allowed).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    page = F.col("path").rlike(r"(?i)\.x?html?$") | F.col("text").rlike(r"(?is)^\s*<(!doctype html|html)\b")
    rows = rows.select("path", F.when(page, markdown(F.col("text"), by in ("paragraphs", "sections"), by == "sections")).otherwise(F.col("text")).alias("text"))
    parts = segments(F.col("text"), by, minlength) if by else F.filter(F.array("text"), lambda x: x != "")
    return rows.select("path", F.posexplode(parts).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
