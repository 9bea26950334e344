"""Every plain query against its SQL, and files back and forth."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from drowse.plans import queries, workloads
from drowse.sources import files

PLAIN = queries.QUERIES | workloads.QUERIES
SQL = queries.ORACLES | workloads.ORACLES


@pytest.fixture(scope="module")
def db(sf):
    out = duckdb.connect()
    for t in os.listdir(sf):
        out.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    return out


def rows(table, columns):
    plain = lambda x: None if x is None else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted((tuple(plain(r[c]) for c in columns) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, db, name):
    want = db.sql(SQL[name])
    columns = sorted(want.columns)
    expected = rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)
    df = PLAIN[name](spark, sf)
    assert sorted(df.columns) == columns
    got = rows(df.collect(), columns)
    assert len(got) == len(expected)
    assert got
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(PLAIN) - set(SQL)))
def test_without_sql(spark, sf, name):
    assert PLAIN[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_files(spark, tmp_path):
    path = str(tmp_path)
    s = spark.createDataFrame([("a", 0, "2018-08-14T15:30:00-0400", 1.5, 0.5), ("a", 1, "2018-08-14T15:30:05-0400", 2.5, 0.5)], files.SERIES)
    s.write.parquet(f"{path}/s")
    got = files.read_series(spark, f"{path}/s", ["series_id", "timestamp"])
    assert [str(r["timestamp"]) for r in got.select(F.date_format("timestamp", "HH:mm:ss").alias("timestamp")).orderBy("timestamp").collect()] == ["19:30:00", "19:30:05"]
    with open(f"{path}/e.csv", "w") as f:
        f.write("series_id,night,event,step,timestamp\na,1,onset,4992.0,2018-08-14T22:26:00-0400\na,1,wakeup,,\n")
    assert [r["step"] for r in files.read_events(spark, f"{path}/e.csv").collect()] == [4992]
    assert files.read_events(spark, f"{path}/e.csv", drop_null=False).count() == 2
    d = spark.createDataFrame([("b", 2, "onset", 0.5), ("a", 9, "wakeup", 0.4), ("a", 3, "onset", 0.7)], "series_id string, step long, event string, score double")
    files.write_detections(d, f"{path}/d")
    assert [(r["row_id"], r["series_id"], r["step"]) for r in spark.read.parquet(f"{path}/d/parquet").orderBy("row_id").collect()] == [(0, "a", 3), (1, "a", 9), (2, "b", 2)]
    assert spark.read.option("header", True).csv(f"{path}/d/csv").count() == 3
    files.write_features(d, f"{path}/f")
    files.write_features(d, f"{path}/f")
    assert spark.read.parquet(f"{path}/f").count() == 3
