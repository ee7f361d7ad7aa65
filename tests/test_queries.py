"""Every registered query against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.8g}"
    return None if v is None or str(v) in ("NaT", "<NA>") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in frame.astype(object).itertuples(index=False, name=None))


REFERENCE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", REFERENCE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if sql := entry.oracle_sql().get(name):
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
