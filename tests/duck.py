"""Runs a query and its SQL side by side."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):  # pandas turns whole numbers with nulls into floats
            return int(v) if v.is_integer() else round(v, 6)
        return v

    columns = sorted(frame.columns)
    return sorted("|".join(repr(plain(v)) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def check(spark, name: str, build, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = build(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs), name
