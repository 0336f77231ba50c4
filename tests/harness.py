"""Compare a registered query with its DuckDB twin."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in BASE:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One comparable form per value."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def compare(spark_df, con, sql: str) -> tuple[int, str | None]:
    """Row count and the first difference, if any."""
    result = con.sql(sql)
    want, want_cols = rows_of(result.columns, result.fetchall())
    got, got_cols = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} against {want_cols}"
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        return len(got), f"rows {len(got)} against {len(want)}; only here {extra}; only there {missing}"
    types = schema_kinds(spark_df, result)
    return len(got), types


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp", "DATE": "date",
}


def schema_kinds(spark_df, result) -> str | None:
    theirs = {c: KINDS.get(str(t), str(t)) for c, t in zip(result.columns, result.types)}
    ours = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    diff = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
    return f"types {diff}" if diff else None
