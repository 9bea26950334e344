"""Repeated segments against a plain form over whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drowse.operators import periodicity


def plain(x, day, split, stride, downsample):
    n, out = len(x), np.zeros(len(x))
    z = (x - x.mean()) / x.std() if x.std() > 0 else np.zeros(n)
    for o in range(0, split * downsample, stride):
        if n < day or n - o < day:
            continue
        small = np.round(z[o::downsample], 7) + 0.0
        m = len(small)
        size = -(-m // split)
        cells = np.concatenate([small, np.zeros(size * split - m)]).reshape(size, split)
        flags = np.array([sum((c == d).all() for d in cells) > 1 for c in cells], float)
        flags[-1] = flags[-2] if size > 1 else 0
        each = np.repeat(flags, split)[:m]
        at = np.arange(n - o) * (m - 1) / (n - o - 1) if n - o > 1 else np.zeros(1)
        out[o:] = np.maximum(out[o:], np.interp(at, np.arange(m), each))
    return out


def made(rng, n, block):
    """A series in which stretches of `block` rows occur again, at offsets of all kinds."""
    x = rng.integers(0, 50, n).astype(float)
    for _ in range(3):
        a, b = rng.integers(0, max(1, n - block), 2)
        x[b : b + block] = x[a : a + block][: len(x[b : b + block])]
    return x


@pytest.mark.parametrize(("split", "stride", "downsample"), [(4, 2, 1), (5, 3, 4), (10, 5, 3), (6, 7, 2)])
@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_against_plain_form(spark, split, stride, downsample, rows):
    rng = np.random.default_rng(split)
    period = split * downsample
    all_ = {f"s{i}": made(rng, n, 3 * period) for i, n in enumerate((1, 7, 59, 60, 61, 200, 431))}
    all_["flat"], all_["again"] = np.full(150, 3.0), np.tile(rng.integers(0, 9, period).astype(float), 6)
    df = spark.createDataFrame([(k, i, float(v)) for k, x in all_.items() for i, v in enumerate(x)], "series_id string, step long, x double").repartition(4)
    got = periodicity.detect(df, "x", 60, split, stride, downsample, rows=rows).toPandas()
    assert len(got) == sum(map(len, all_.values()))
    for k, p in got.groupby("series_id"):
        assert np.allclose(p.sort_values("step")["periodicity"], plain(all_[k], 60, split, stride, downsample)), k
    assert got["periodicity"].max() == 1


def test_first_stage_has_fewer_rows(spark):
    """One row for each chunk, none for each row and offset; nulls count as the mean."""
    df = spark.range(20_000).select(F.lit("a").alias("series_id"), F.col("id").alias("step"), F.when(F.col("id") % 11 > 0, (F.col("id") % 4000).cast("double")).alias("x"))
    hashes = periodicity.chunk_hashes(periodicity.standardized(df, "x"), 120, 36, 12)
    assert hashes.count() == sum(-(-(20_000 - o) // 1440) for o in range(0, 1440, 36)) <= 20_000 / 36 + 40
    assert periodicity.detect(df.limit(0), "x").count() == 0


@pytest.mark.parametrize(("threshold", "block"), [(0.99, 1024), (0.99, 16), (0.6, 32), (0.0, 1024)])
def test_similar_chunks_against_all_pairs(spark, threshold, block):
    rng = np.random.default_rng(5)
    rows = []
    for s, m in (("a", 120), ("b", 1), ("c", 40)):
        centres = rng.normal(size=(30, 9)) + rng.normal(size=(30, 1))
        for i in range(m):
            v = centres[rng.integers(30)] * rng.uniform(0.5, 2) + rng.normal(size=9) * rng.choice([0.01, 0.1, 1])
            rows.append((s, i, v.tolist()))
    rows += [("a", 900, [0.0] * 9), ("a", 901, None), ("a", 902, [1.0, None]), ("c", 903, [2.0] * 4), ("c", 904, [3.0] * 4), ("b", 905, rows[0][2]), ("c", 906, rows[125][2])]
    df = spark.createDataFrame(rows, "series_id string, chunk long, v array<double>")
    got = {(r["series_id"], r["chunk"]): r["periodic"] for r in periodicity.similar_chunks(df, "v", threshold, block=block).collect()}
    assert len(got) == len(rows)
    real = [(s, i, np.array(v)) for s, i, v in rows if v and None not in v and any(v)]
    for s, i, v in rows:
        mine = v if v and None not in v and any(v) else None
        other = [w for t, j, w in real if t == s and j != i and mine is not None and len(w) == len(v)]
        cosine = max((float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for w in other), default=-1)
        assert got[s, i] == int(mine is not None and cosine > threshold), (s, i, cosine)


def test_similar_chunks_multiply_few_pairs(spark):
    """Chunks whose levels differ, as of days and nights: the products in the cells are a small part of all pairs, and no cell is large."""
    n = 3000
    df = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("h"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(F.col("id") * 0.7 * i) + F.cos(F.col("id") * 0.37) * 3).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    units = df.withColumn("v", F.transform("v", lambda v: v / norm))
    groups = periodicity.chunk_cells(units, 0.99, "series_id", 256).groupBy("size", "cx", "cy", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).collect()
    assert max(r["n"] for r in groups) < 4 * 256
    assert sum(r["n"] * r["homes"] for r in groups) < n * (n - 1) / 2
