"""Side-by-side check of a registered Spark query against its DuckDB SQL twin.

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows (order-insensitive, columns compared by name).
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = round(v, 6) + 0.0
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def type_mismatches(spark_df, con, sql: str) -> dict:
    s = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in spark_df.schema.fields}
    rel = con.sql(sql)
    d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    types = type_mismatches(spark_df, con, sql)
    if types:
        return False, f"column types differ (spark, sql): {types}"
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} sql={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count differs: spark={len(s)} sql={len(d)}"
    rs, rd = _rows(s), _rows(d)
    for a, b in zip(rs, rd):
        if a != b:
            return False, f"first differing row (cols {sorted(s.columns)}):\n spark={a}\n sql  ={b}"
    return True, f"{len(s)} rows"
