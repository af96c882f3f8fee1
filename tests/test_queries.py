"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {n: q for m in entry.MODULES for n, q in m.ORACLE_SQL.items()}
PLAIN = [n for m in entry.MODULES for n in m.QUERIES if n not in SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(int(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.5f}".replace("-0.00000", "0.00000")
        if isinstance(v, datetime.date):  # the other engine's frames hold time stamps of midnight
            return str(pd.Timestamp(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or abs(float(p) - float(q)) < 2e-5


@pytest.mark.parametrize("name", ["elo_walk", "elo_final", "elo_current_peak", "league_offset_fit", "residual_by_stratum", "content_fingerprint", "elo_streamed"])
def test_runs_without_sql(spark, name):
    assert name in PLAIN
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
