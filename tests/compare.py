"""Row-by-row comparison of a Spark result with DuckDB's."""

import duckdb
import pandas as pd


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(shown(v) for v in r) for r in frame[columns].itertuples(index=False))


def duck(sql, sf, **tables):
    con = duckdb.connect()
    if sf:
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()
