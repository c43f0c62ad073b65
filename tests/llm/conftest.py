"""What the tests of the training-data operators share."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

CLASH = "text_hash maybe_repeated digest row id_order h sig bands sketch bucket rep label x part piece tokens hit spans words".split()


def documents(spark: SparkSession, rows: list[tuple], extra: bool = True) -> DataFrame:
    """(doc_id, text) rows, with columns whose names the operators use themselves."""
    schema = "doc_id long, text string" + "".join(f", {c} string" for c in CLASH if extra)
    return spark.createDataFrame([(*r, *(["z"] * len(CLASH) if extra else [])) for r in rows], schema)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows, extra=True: documents(spark, rows, extra)
