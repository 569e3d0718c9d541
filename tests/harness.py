"""Spark-vs-DuckDB comparison used by the tests and by ``check_queries.py``."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    out = []
    for v in row:
        if v is None:
            out.append((0, ""))
        elif isinstance(v, float):
            out.append((1, f"{v:.6e}"))
        else:
            out.append((2, str(v)))
    return out


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=_key)


import os

STRICT = os.environ.get("CHECK_STRICT") == "1"


def close(a, b, rel=1e-6, abs_=1e-9) -> bool:
    if STRICT:
        rel, abs_ = 0.0, 0.0
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(float(a), float(b), rel_tol=rel, abs_tol=abs_)
    if hasattr(a, "isoformat") and hasattr(b, "isoformat"):
        return pd.Timestamp(a) == pd.Timestamp(b)
    return a == b


_DUCK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
         "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "SMALLINT": "smallint",
         "TINYINT": "tinyint", "FLOAT": "float"}


def type_mismatches(spark_df, rel) -> list[str]:
    st = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    out = []
    for name, t in zip(rel.columns, rel.types):
        dt = _DUCK.get(str(t), str(t).lower())
        if st.get(name) != dt:
            out.append(f"{name}: spark={st.get(name)} duck={dt}")
    return out


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    sp = spark_df.toPandas()
    rel = con.sql(sql)
    tm = type_mismatches(spark_df, rel)
    dd = rel.df()
    if sorted(sp.columns) != sorted(dd.columns):
        return False, f"columns differ: spark={sorted(sp.columns)} duck={sorted(dd.columns)}"
    if len(sp) != len(dd):
        return False, f"row count spark={len(sp)} duck={len(dd)}"
    a, b = rows_of(sp), rows_of(dd)
    cols = sorted(sp.columns)
    for i, (ra, rb) in enumerate(zip(a, b)):
        for c, x, y in zip(cols, ra, rb):
            if not close(x, y):
                return False, f"row {i} col {c}: spark={x!r} duck={y!r}"
    return True, f"{len(sp)} rows" + (f"  TYPES {tm}" if tm else "")
