"""Runs a query's SQL twin in DuckDB over the same tables and compares rows without regard to their order."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _key(row):
    return tuple("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=_key)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b)))
    return a == b or str(a) == str(b)


def differences(df, con, sql: str) -> str:
    """Empty if the rows agree, else what differs."""
    got_columns = df.columns
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = rows_of(want_columns, cur.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} and {sorted(want_columns)}"
    got = rows_of(got_columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""
