"""Comparison of a query's result with its SQL statement run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

EXACT = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


SPARK_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN"}


def differences(frame, sql: str, connection) -> list[str]:
    """Empty when names, types and rows agree."""
    relation = connection.sql(sql)
    problems = []
    expected_types = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    found_types = {n: SPARK_KINDS.get(t, t) for n, t in frame.dtypes}
    for name in sorted(set(expected_types) | set(found_types)):
        if expected_types.get(name) != found_types.get(name):
            problems.append(f"column {name}: spark {found_types.get(name)}, sql {expected_types.get(name)}")
    got_names, got = _sorted_rows(frame.columns, frame.collect())
    want_names, want = _sorted_rows(relation.columns, relation.fetchall())
    if got_names != want_names:
        return [*problems, f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        problems.append(f"{len(got)} rows, expected {len(want)}")
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 20000 else got[:2]
        missing = [r for r in want if r not in got][:3] if len(want) < 20000 else want[:2]
        problems.append(f"spark only: {extra}; sql only: {missing}")
    return problems
