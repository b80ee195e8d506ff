"""Comparison of a query with its SQL, whatever the order of rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    kind = type(value).__name__
    if kind.startswith("bool"):
        return bool(value)
    return f"{float(value):.9g}" if "int" in kind or "float" in kind else str(value)


def rows(frame, columns):
    return Counter(tuple(map(cell, row)) for row in frame[columns].itertuples(index=False))


def assert_same(found, sql, sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    expected = connection.execute(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    mine, theirs = rows(found, columns), rows(expected, columns)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
