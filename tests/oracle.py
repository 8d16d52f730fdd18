"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import os


def views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(frame, columns: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return repr(v)
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


def assert_same(df, sql: str, sf_dir: str) -> None:
    got, want = df.toPandas(), views(sf_dir).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    for frame in (got, want):  # whole numbers that met a null
        for c in columns:
            if str(got[c].dtype) != str(want[c].dtype) and frame[c].dtype.kind in "if":
                frame[c] = frame[c].astype(float)
    assert rows_of(got, columns) == rows_of(want, columns)
