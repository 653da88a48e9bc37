"""Run an analysis and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

SPARK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "DOUBLE": "double",
    "VARCHAR": "string", "DATE": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return db


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, text: str) -> str:
    """Empty when columns, types and rows agree exactly."""
    found = db.execute(text)
    theirs = {c[0]: str(c[1]) for c in found.description}
    ours = dict(df.dtypes)
    if set(ours) != set(theirs):
        return f"columns {sorted(set(ours) ^ set(theirs))}"
    wrong = {c: (ours[c], theirs[c]) for c in ours if SPARK_TYPES.get(theirs[c]) != ours[c]}
    if wrong:
        return f"types {wrong}"
    names = sorted(ours)
    expected = _sorted(found.fetchall(), list(theirs), names)
    actual = _sorted(df.collect(), df.columns, names)
    if len(expected) != len(actual):
        return f"rows {len(actual)}, expected {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            cells = {c: (x, y) for c, x, y in zip(names, a, e) if x != y}
            return f"row {a}\nexpected {e}\ncells {cells}"
    return ""


def _sorted(rows, columns: list[str], names: list[str]) -> list[tuple]:
    at = [columns.index(c) for c in names]
    return sorted((tuple(row[i] for i in at) for row in rows), key=repr)
