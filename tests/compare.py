"""Side-by-side comparison of a query and its SQL in DuckDB."""

import duckdb
import pandas as pd

from tesserine.plans.sqlsuite import TABLES


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.6g}") + 0.0
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return None if v is pd.NaT else v


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    expected = sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    assert got == expected
