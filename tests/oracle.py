"""Compare a query's rows with DuckDB SQL over the same tables."""

from __future__ import annotations

import glob

import duckdb
import pandas as pd


def rows_of(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def expected(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = f.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{f}'")
    return con.execute(sql).df()
