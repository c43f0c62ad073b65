"""What the operators share: scratch tables, column names, Arrow helpers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.scratch import balanced, release, stage
from corvane.sources.scratch import folder as shared_dir

__all__ = ["anti_by_id", "balanced", "fixed_binary", "fresh", "id_type", "long_list", "map_text", "partitions", "release", "shared_dir", "slices", "stage", "strings", "table"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def strings(column: pa.Array) -> pa.Array:
    """As large strings with nulls as empty, contiguous from offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    return pa.concat_arrays([column]) if column.offset else column


def slices(batch: pa.RecordBatch, col: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most`` bytes of text each (one row at least), to bound memory."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(batch.schema.get_field_index(col)).cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_text(df: DataFrame, col: str, schema: T.StructType, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None]) -> DataFrame:
    """``mapInArrow`` over parts of bounded size, on all cores; ``f`` returns a batch, several, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, col):
                out = f(part)
                if out is None:
                    continue
                for x in [out] if isinstance(out, pa.RecordBatch) else out:
                    if x.num_rows:
                        yield x

    return balanced(df).mapInArrow(run, schema)


def long_list(values: np.ndarray) -> pa.Array:
    """A 2-D array as one list of equal length per row."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def fixed_binary(values: np.ndarray) -> pa.Array:
    """The rows of a 2-D array as binary values."""
    data = np.ascontiguousarray(values)
    n, width = len(data), data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.py_buffer(data)])


def anti_by_id(docs: DataFrame, col: str, gone: DataFrame, most: int = 4_000_000) -> DataFrame:
    """``docs`` without the ids in the staged table ``gone`` (one column ``col``).

    ``gone`` is broadcast only up to ``most`` ids (32 MB); beyond, both sides shuffle.
    """
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.join(gone, col, "left_anti").select(*docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
