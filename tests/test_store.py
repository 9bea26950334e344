"""The bucketed store: plans without exchanges, other sessions' tables, overwriting."""

import glob
import os
import tempfile
import time

from pyspark.sql import functions as F

from drowse.operators import joins
from drowse.sources import shared, store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merges_shuffle_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 4
        for i in range(n):
            df = spark.range(5000).select(F.format_string("s%d", F.col("id") % 7).alias("series_id"), (F.col("id") * (i + 1)).alias("step"), (F.col("id") * 0.5 + i).alias("p"))
            store.write_store(df.repartition(3), f"{tmp_path}/{i}", buckets=8)
        tables = [store.read_store(spark, f"{tmp_path}/{i}") for i in range(n)]
        for how, k in (("inner", n), ("left", n), ("full", 2)):
            merged = joins.merge_predictions(tables[:k], [str(i) for i in range(k)], how=how)
            assert "Exchange" not in plan(merged)
            assert "SortMergeJoin" in plan(merged)
            plain = joins.merge_predictions([spark.read.parquet(f"{tmp_path}/{i}") for i in range(k)], [str(i) for i in range(k)], how=how)
            assert "Exchange" in plan(plain)
            assert merged.count() == plain.count() > 0
            assert merged.exceptAll(plain).count() == 0
        grouped = tables[0].groupBy("series_id", "step").agg(F.max("p"))
        assert "Exchange" not in plan(grouped)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_session_and_overwriting(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.write_store(spark.createDataFrame([("a", 1, None), (None, 2, [1.5])], "series_id string, step long, p array<double>"), path, buckets=4)
    other = spark.newSession()
    assert sorted(map(tuple, store.read_store(other, path).collect()), key=str) == [("a", 1, None), (None, 2, [1.5])]
    store.write_store(spark.createDataFrame([("b", 5, 1)], "series_id string, step long, q int"), path, ["series_id"], 2)
    assert store.read_store(spark, path, ["q", "series_id"]).collect() == [(1, "b")]
    store.write_store(spark.createDataFrame([], "series_id string, step long"), path)
    assert store.read_store(spark, path).count() == 0


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    """Files of a query's shuffles go when its table is written; the session's setting is as before."""
    ids = lambda: {f for d in glob.glob(f"{tempfile.gettempdir()}/blockmgr-*") for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, setting = ids(), spark.conf.get(shared.CLEANUP, None)
    out = shared.kept(spark.range(50_000).groupBy((F.col("id") * 7 % 20_011).alias("x")).count(), "t")
    assert out.count() == 20_011
    time.sleep(2)
    assert len(ids() - before) < 4  # of the count, none of the written table's
    assert spark.conf.get(shared.CLEANUP, None) == setting
