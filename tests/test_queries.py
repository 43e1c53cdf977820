"""Each query of the engine against its SQL on the smallest tables, if they are there."""

import glob
import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


def shown(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr(list(v))
    if pd.isna(v):
        return "NULL"
    if isinstance(v, float):
        return str(round(v, 6) + 0.0)
    try:
        return str(round(float(v), 6) + 0.0) if not isinstance(v, (str, bool)) else str(v)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    from varloom import plan_queries, queries  # noqa: F401

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert set(queries.QUERIES) == set(queries.ORACLES)
    for name, run in queries.QUERIES.items():
        a, b = run(spark, SF).toPandas(), c.execute(queries.ORACLES[name]).df()
        assert sorted(a.columns) == sorted(b.columns), name
        rows = lambda d: sorted(tuple(map(shown, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
        assert len(a) and rows(a) == rows(b), name
