"""Scans, halo blocks and rolling statistics against plain windows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from drowse.operators import blocks, features, rolling, windows
from drowse.operators.rolling import Rolling


def hot(spark, n=3000, nulls=0.2):
    """One series has most rows; others have one, few, or nulls only."""
    rng = np.random.default_rng(3)
    sizes = {"hot": n, "one": 1, "few": 7, "none": 40, "odd": 333}
    rows = [(s, i, None if s == "none" or rng.random() < nulls else float(rng.normal() + 1e5)) for s, k in sizes.items() for i in range(k)]
    return spark.createDataFrame(rows, "series_id string, step long, x double").repartition(5)


@pytest.mark.parametrize("w", [1, 2, 5, 12, 60, 720])
@pytest.mark.parametrize("stat", ["mean", "std", "max", "min", "sum", "median", "count"])
def test_kernels_against_plain_frames(stat, w):
    rng = np.random.default_rng(w)
    for n in (1, 3, 59, 720, 1500):
        x = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n).round(2) + 1000)
        for least in (1, max(1, w // 2), None):
            need = w if least is None else least
            got = rolling.rolled(x, stat, w, least)
            for i in rng.choice(n, min(n, 60), replace=False):
                own = x[max(0, i - w // 2) : i + (w + 1) // 2]
                own = own[~np.isnan(own)]
                some = len(own) >= max(need, 2 if stat == "std" else 0 if stat == "count" else 1)
                of = {"mean": np.mean, "std": lambda v: np.std(v, ddof=1), "max": np.max, "min": np.min, "sum": np.sum, "median": np.median, "count": len}
                assert np.isclose(got[i], of[stat](own), rtol=1e-12, atol=1e-9) if some else np.isnan(got[i]), (n, i, least)


def test_std_of_constant_stretches_is_zero():
    x = np.r_[np.full(2000, 1e9), np.full(2000, -3.7), np.linspace(0, 1, 500)]
    std = rolling.rolled(x, "std", 60)
    assert (std[30:1900] == 0).all()
    flags = np.repeat([0.0, 1.0] * 30, 100)
    assert (rolling.rolled(flags, "std", 12)[6:95] == 0).all()
    assert (rolling.rolled(flags, "std", 60)[130:171] == 0).all()
    assert (std[2100:3900] == 0).all()


@pytest.mark.parametrize("rows", [50, 4096])
def test_blocks_are_the_whole_series(spark, rows):
    specs = [Rolling(f"{s}_{w}", "x", s, w, least) for s in ("mean", "std", "max", "median") for w, least in ((5, 1), (60, 10), (120, None))]
    out = rolling.rolling_table(hot(spark), specs, rows=rows).toPandas()
    assert len(out) == 3381
    for _, p in out.groupby("series_id"):
        p = p.sort_values("step")
        assert p["step"].tolist() == list(range(len(p)))
        for s in specs:
            want = rolling.rolled(p["x"].to_numpy(), s.stat, s.w, s.least)
            assert np.allclose(p[s.name], want, rtol=1e-9, equal_nan=True)


def test_bounded_windows_are_the_plain_ones(spark):
    df = hot(spark)
    frames = lambda keys, order: {"a": F.avg("x").over(windows.centered(11, keys, order)), "b": F.lag("x", 7).over(windows.ordered(keys, order)), "c": F.max("x").over(windows.trailing(9, keys, order))}
    got = blocks.bounded(df, 8, 5, frames, rows=64)
    want = df.withColumns(frames(["series_id"], "step"))
    assert got.count() == want.count()
    assert got.withColumn("x", F.round("x", 6)).withColumn("a", F.round("a", 6)).exceptAll(want.withColumn("x", F.round("x", 6)).withColumn("a", F.round("a", 6))).count() == 0


def largest_task(df, used):
    each = df.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(used).alias("s"))
    return max(r["n"] for r in each.collect())


def test_a_hot_series_is_many_tasks(spark):
    """Most rows are one series': no task of a blocked frame holds more than a small part of them."""
    df = hot(spark, 20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        spread = blocks.halo(df, 30, 30, rows=256).repartition("series_id", "block")
        assert largest_task(spread, "x") < 20_000 / 6
        numbered = blocks.scan(df, ["series_id"], "step", {"n": F.lit(1)})
        assert largest_task(numbered, "n") < 20_000 / 6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("order", ["step", "name", "at", "x"])
@pytest.mark.parametrize("descending", [False, True])
def test_scan_is_the_plain_window(spark, order, descending):
    df = hot(spark, 500).withColumns({"name": F.concat(F.lit("n"), F.lpad(F.col("step"), 5, "0")), "at": F.timestamp_seconds(F.col("step") * 7), "x": F.when(F.col("step") % 9 > 0, (F.col("step") * 37 % 101).cast("double"))})
    df = df.withColumn("series_id", F.when(F.col("series_id") != "odd", F.col("series_id")))
    got = blocks.scan(df, ["series_id"], [order, "step"], {"n": F.lit(1), "t": F.col("x")}, descending, n=16)
    w = Window.partitionBy("series_id").orderBy(F.desc(order) if descending else F.asc(order), "step").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.sum(F.lit(1)).over(w), "t": F.sum("x").over(w)})
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_scan_without_keys_or_rows(spark):
    df = hot(spark, 300).select("series_id", "step")
    got = sorted(r["place"] for r in blocks.numbered(df, [], ["series_id", "step"], n=8).collect())
    assert got == list(range(681))
    assert blocks.numbered(df.limit(0), ["series_id"], "step").count() == 0
    assert rolling.rolling_table(df.limit(0).withColumn("x", F.lit(1.0)), [Rolling("m", "x", "mean", 5)]).count() == 0


def test_no_window_over_a_series_in_the_plan(spark):
    plan = rolling.rolling_table(hot(spark, 100), [Rolling("m", "x", "median", 720)])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "percentile" not in plan


def test_time_does_not_follow_the_width():
    x = np.random.default_rng(0).normal(size=300_000)
    took = {}
    for w in (12, 720, 5760):
        began = time.perf_counter()
        for stat in ("mean", "std", "max"):
            rolling.rolled(x, stat, w)
        took[w] = time.perf_counter() - began
    assert took[5760] < 4 * took[12]
    assert pd.notna(rolling.rolled(x, "median", 720)).all()


def test_bounds_are_not_joined_to_each_row(spark):
    df = spark.range(1000).select(F.col("id").alias("step"))
    plan = blocks.in_blocks(df, "step")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_equally_long_blocks_pass_in_one_call(spark):
    """Features of many short series, stacked: bit for bit those of each alone, from few calls."""
    rng = np.random.default_rng(8)
    sizes = features.Sizes({1: 3, 5: 6, 60: 24}, (4, 6), (5, 7), 6, 8)
    x = {c: np.where(rng.random((7, 45)) < 0.1, np.nan, rng.normal(size=(7, 45)).round(1)) for c in ("anglez", "anglez_raw", "enmo", "enmo_log")}
    both = features.block_features(x, sizes)
    for i in range(7):
        for c, alone in features.block_features({k: v[i] for k, v in x.items()}, sizes).items():
            assert np.array_equal(both[c][i], alone, equal_nan=True), c
    rows = [(s, i, float(s * i % 11)) for s in range(200) for i in range(20 + s % 3)]
    df = spark.createDataFrame(rows, "series_id long, step long, x double").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def fn(v):
        calls.add(1)
        return {"y": np.cumsum(v["x"], axis=-1)}

    got = {(r["series_id"], r["step"]): r["y"] for r in blocks.map_blocks(df, 0, 0, fn, ["x"], ["y"]).collect()}
    want = pd.DataFrame(rows, columns=["s", "i", "x"])
    assert got == dict(zip(zip(want["s"], want["i"], strict=True), want.groupby("s")["x"].cumsum(), strict=True))
    assert calls.value <= 3 * 8
