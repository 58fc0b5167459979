"""Compare registered queries with their DuckDB SQL (the check the driver runs)."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() and abs(v) < 2**53 else round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat(sep=" ")
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat(sep=" ") if hasattr(v, "tzinfo") else v.isoformat()
    return v


def fingerprint(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in pdf.to_dict("records"))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df: DataFrame, sql: str, con) -> dict:
    ours = fingerprint(df.toPandas())
    theirs = fingerprint(con.sql(sql).df())
    return {"rows": ours[0], "oracle_rows": theirs[0], "schema": ours[1] == theirs[1],
            "values": ours[2] == theirs[2], "cols": ours[1], "oracle_cols": theirs[1]}
