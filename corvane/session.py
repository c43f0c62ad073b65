"""Sessions with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "corvane", **more: str) -> SparkSession:
    """The running session, or one with ``SETTINGS`` and ``more`` (dots as double underscores)."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
