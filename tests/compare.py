"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    expected_rows = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    got, expected = _rows(df.columns, df.collect()), _rows(names, expected_rows)
    if got == expected:
        return None
    extra, lacking = got - expected, expected - got
    return (f"{sum(got.values())} rows against {sum(expected.values())};"
            f" only in Spark {sum(extra.values())}: {list(extra)[:2]};"
            f" only in DuckDB {sum(lacking.values())}: {list(lacking)[:2]}")
