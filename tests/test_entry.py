"""Every query with SQL gives the same rows in a second engine, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from tillstats.plans.oracles import ORACLES
from tillstats.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall())
    ours = sorted(tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming(spark, tmp_path):
    import datetime as dt

    from tillstats.streaming import daily

    source = str(tmp_path / "in")
    rows = [(dt.datetime(2026, 1, 1 + k // 2, 6 * (k % 2)), float(k)) for k in range(20)]
    spark.createDataFrame(rows, "FECHA timestamp, MONTO_APLICADO double").write.parquet(source)
    stream = spark.readStream.schema("FECHA timestamp, MONTO_APLICADO double").parquet(source)
    running = daily.write(daily.daily_sums(stream), str(tmp_path / "out"), str(tmp_path / "state")).start()
    running.processAllAvailable()
    running.stop()
    found = {str(r["ds"]): r["y"] for r in spark.read.schema("ds date, y double").parquet(str(tmp_path / "out")).collect()}
    assert found["2026-01-01"] == 1.0 and found["2026-01-03"] == 9.0
