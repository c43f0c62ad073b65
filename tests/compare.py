"""Runs registered queries beside their SQL in DuckDB and compares names, kinds and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(sf_dir, f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x: object) -> object:
    """A value that compares and sorts alike from either engine."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    return x


def rows(t: pa.Table) -> list[tuple]:
    names = sorted(t.column_names)
    return sorted(zip(*(map(plain, t.column(c).to_pylist()) for c in names)), key=repr) if names else []


def kind(t: pa.DataType) -> str:
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{kind(t.value_type)}>"
    if pa.types.is_large_string(t):
        return "string"
    return "timestamp" if pa.types.is_timestamp(t) else "binary" if pa.types.is_large_binary(t) else str(t)


def differences(found: pa.Table, wanted: pa.Table) -> list[str]:
    out = []
    if sorted(found.column_names) != sorted(wanted.column_names):
        return [f"columns {sorted(found.column_names)} instead of {sorted(wanted.column_names)}"]
    for c in found.column_names:
        a, b = kind(found.schema.field(c).type), kind(wanted.schema.field(c).type)
        if a != b and not a.startswith("struct"):
            out.append(f"{c} is {a}, in SQL {b}")
    if found.num_rows != wanted.num_rows:
        out.append(f"{found.num_rows} rows instead of {wanted.num_rows}")
    elif (a := rows(found)) != (b := rows(wanted)):
        out.append(next(f"{str(x)[:300]} instead of {str(y)[:300]}" for x, y in zip(a, b) if x != y))
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            t = f(spark, sf_dir).toArrow()
            took = time.time() - began
            said = differences(t, con.sql(sql[name]).to_arrow_table()) if name in sql else ["no SQL"]
            print(f"{name}: {t.num_rows} rows, {took:.1f} s, {'; '.join(said) or 'same'}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: {type(e).__name__} {str(e)[:600]}", flush=True)
