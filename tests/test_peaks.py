"""Peak suppression and the greedy picker against plain forms; rewritten windows against direct ones."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from drowse.operators import peaks, windows
from drowse.plans import workloads


def plain_pick(steps, p, chunk, height, limit):
    n, power = len(p), [10] * len(p)
    reach = [(3, peaks.NEAR, peaks.FAR), (9, peaks.FAR, peaks.NEAR)]

    def gain(c, k):
        _, left, right = reach[k]
        total = 0.0
        for i in range(n):
            if chunk[i] == chunk[c]:
                total += p[i] * sum(1 for j in range(1, power[i] + 1) if -left[j] < i - c <= right[j])
        return total

    out = []
    while len(out) < limit:
        best = [max(((gain(c, k), -c) for c in range(n)), key=lambda x: (round(x[0], 9), x[1])) for k in (0, 1)]
        k = 0 if best[0][0] > best[1][0] + 1e-12 else 1
        value, c = best[k][0], -best[k][1]
        if value < height:
            break
        after, left, right = reach[k]
        out.append((steps[c] + after, value))
        for j in range(9, -1, -1):
            for i in range(n):
                if -left[j + 1] < i - c <= right[j + 1]:
                    power[i] = min(power[i], j)
    return out


def test_greedy_picker_against_plain_form():
    """Steps and scores, ties too: predictions are multiples of 1 / 8, so that sums are exact in both."""
    rng = np.random.default_rng(4)
    for _ in range(12):
        n = 90
        p, chunk, steps = np.floor(rng.random(n) ** 4 * 8) / 8, np.repeat([0, 1, 2], [40, 35, 15]), np.arange(n) * 12
        got = [(int(steps[i]) + peaks.PHASES[k][0], v) for i, k, v in peaks.pick_events(p, chunk, 0.2, 14)]
        assert got == plain_pick(steps.tolist(), p.tolist(), chunk.tolist(), 0.2, 14)


def test_many_series_a_call(spark):
    """Rows in any order, several series and events a call: each is picked as by itself."""
    rng = np.random.default_rng(9)
    rows = [(s, int(i // 40), int(i), float(np.floor(rng.random() ** 4 * 8) / 8), float(rng.random() ** 3)) for s in range(4) for i in range(150)]
    df = spark.createDataFrame(rows, "series_id long, chunk_id long, step long, a double, b double").repartition(5)
    got = peaks.greedy_events(df, {"onset": "a", "wakeup": "b"}, 0.3, 9).collect()
    want = []
    for s in range(4):
        own = [r for r in rows if r[0] == s]
        for event, at in (("onset", 3), ("wakeup", 4)):
            found = peaks.pick_events(np.array([r[at] for r in own]), np.array([r[1] for r in own]), 0.3, 9)
            want += [(s, event, own[i][2] + peaks.PHASES[k][0], v) for i, k, v in found]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_million_rows_in_seconds():
    rng = np.random.default_rng(1)
    p = rng.random(1_000_000) ** 6
    began = time.perf_counter()
    found = peaks.pick_events(p, np.zeros(len(p), int), 0.001, 500)
    assert time.perf_counter() - began < 10
    assert len(found) == 500
    gains = [v for _, _, v in found]
    assert gains == sorted(gains, reverse=True)


def test_short_series_are_picked_in_rounds():
    """The picks of each series alone, in the time of a few calls."""
    rng = np.random.default_rng(4)
    sizes = [1, 2, 30, 61, 200, *rng.integers(40, 100, 300).tolist()]
    begin, n = np.cumsum([0, *sizes[:-1]]), sum(sizes)
    p = np.round(rng.random(n), 1) ** 3  # with ties
    chunk = np.concatenate([np.arange(s) // 32 for s in sizes])
    began = time.perf_counter()
    at, phase, gain = peaks.pick_many(p, chunk, begin, 0.05, 20)
    took = time.perf_counter() - began
    began = time.perf_counter()
    want = [(a + i, k, v) for a, s in zip(begin, sizes, strict=True) for i, k, v in peaks.pick_events(p[a : a + s], chunk[a : a + s], 0.05, 20)]
    assert list(zip(at.tolist(), phase.tolist(), gain.tolist(), strict=True)) == want
    assert len(want) > 4000 and took < (time.perf_counter() - began) / 4
    empty = peaks.pick_many(np.zeros(3), np.zeros(3, int), np.array([0]), 0.05, 20)
    assert [len(x) for x in empty] == [0, 0, 0]


def test_tournament():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 5000):
        x = rng.integers(0, 50, n)
        t = peaks.Tournament(x)
        for _ in range(200):
            a = int(rng.integers(0, n))
            z = min(n, a + int(rng.integers(1, 90)))
            x[a:z] -= rng.integers(0, 9, z - a)
            t.changed(a, z)
            assert t.best() == int(x.argmax())


def test_prediction_too_great(spark):
    df = spark.createDataFrame([("a", 0, 0, 1e6)], "series_id string, chunk_id long, step long, p double")
    with pytest.raises(Exception, match="too great"):
        peaks.greedy_events(df, {"onset": "p"}).collect()


def test_maxima_sort_their_runs_once(spark):
    """Maxima of odd values are those of a plain walk, and the rows are sorted twice: along the series, and those that are left by their runs."""
    rng = np.random.default_rng(9)
    values = [None, float("nan"), 0.0, 1.0, 1.0, 2.0, 3.0]
    rows = [(s, i, values[rng.integers(0, 7)]) for s in range(40) for i in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "series_id long, step long, x double").repartition(3)
    found = windows.local_maxima(df, "x", 1.0)
    less = lambda a, b: a is not None and b is not None and (b != b and a == a or a < b)
    same = lambda a, b: a is not None and b is not None and (a == b or a != a and b != b)
    want = []
    for s in range(40):
        x, a = [v for k, _, v in rows if k == s], 0
        while a < len(x):
            z = a
            while z + 1 < len(x) and same(x[z], x[z + 1]):
                z += 1
            if a > 0 and z + 1 < len(x) and less(x[a - 1], x[a]) and less(x[z + 1], x[a]) and not less(x[a], 1.0):
                want.append((s, (a + z) // 2))
            a = z + 1
    assert sorted((r["series_id"], r["step"]) for r in found.collect()) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Sort [") == 2


def test_suppression():
    rng = np.random.default_rng(5)
    for _ in range(100):
        rows = np.sort(rng.choice(60, 15, replace=False))
        x = rng.integers(0, 5, 15).astype(float)
        kept, order = [], sorted(range(15), key=lambda i: (-x[i], -rows[i]))
        for i in order:
            if all(abs(rows[i] - rows[j]) >= 4 for j in kept):
                kept.append(i)
        assert np.flatnonzero(peaks.suppress(rows, x, 3.5)).tolist() == sorted(kept)


def test_prefix_sums_are_the_direct_frame(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(s, i, float(rng.normal() + 1e6) if rng.random() < 0.7 or s < 2 else None) for s in range(4) for i in range((1, 7, 200, 40)[s])], "series_id long, step long, x double")
    for w in (1, 2, 5, 12):
        out = windows.rolling_mean_by_prefix(df, "x", w, "a").withColumn("b", windows.rolling(F.col("x"), "mean", windows.centered(w)))
        assert out.where((F.abs(F.col("a") - F.col("b")) > 1e-6) | (F.col("a").isNull() != F.col("b").isNull())).count() == 0


def test_ramp_is_the_widest_frames(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(s, i, int(rng.random() < 0.05)) for s in range(3) for i in range(120)], "series_id long, step long, hit int")
    widths = [1, 3, 5, 9]
    direct = F.greatest(*[F.max("hit").over(windows.ordered().rowsBetween(1 - w, w - 1)) * (1 - i / 4) for i, w in enumerate(widths)])
    out = windows.ramp_target(df, F.col("hit") == 1, widths, "a").withColumn("b", direct)
    assert out.where("abs(a - b) > 1e-9").count() == 0


def test_without_a_limit_all_are_picked():
    """As the plain form goes on until no candidate reaches the height, alone and in rounds; at height 0 picks end when nothing is gained."""
    rng = np.random.default_rng(6)
    n, ends = 60, 0
    p, chunk = np.floor(rng.random((4, n)) ** 2 * 8) / 8, np.repeat([0, 1], [35, 25])
    many = peaks.pick_many(p.ravel(), np.tile(chunk, 4) + np.repeat(np.arange(4) * 2, n), np.arange(4) * n, 0.1)
    for i in range(4):
        want = plain_pick((np.arange(n) * 12).tolist(), p[i].tolist(), chunk.tolist(), 0.1, 10**6)
        told = lambda at, k, v: (int(at) * 12 + peaks.PHASES[k][0], float(v))
        assert [told(*x) for x in peaks.pick_events(p[i], chunk, 0.1)] == want
        own = many[0] // n == i
        assert [told(at - i * n, k, v) for at, k, v in zip(*(x[own] for x in many), strict=True)] == want
        ends += len(want)
        assert len(peaks.pick_events(p[i], chunk, 0.0)) == len(peaks.pick_many(p[i], chunk, np.array([0]), 0.0)[0]) >= len(want)
    assert ends > 4 * 20


def test_scores_are_of_all_events(spark, sf, monkeypatch):
    """A series has more than 500 events that reach the height, the former default, and those of w3_score more than its former 20."""
    s = spark.range(700 * 70).select(F.lit(1).alias("series_id"), F.col("id").alias("step"), F.lit(0).alias("chunk_id"), F.expr("date_add(DATE'2024-01-01', CAST(id / 70 AS INT))").alias("day"), F.expr("CAST(id % 70 = 35 AS DOUBLE)").alias("pred_onset"), F.lit(0.0).alias("pred_wakeup"))
    seen = []
    monkeypatch.setattr(workloads.metric, "ap_table", lambda truth, found, tolerances: seen.append(found) or found.groupBy("series_id", "event").agg(F.count(F.lit(1)).alias("ap")))
    workloads.scored(s, s.select("series_id", "step"), {})
    found = seen[0].where("event = 'onset'").collect()
    assert len({r["step"] // 70 for r in found}) == 700
    assert max(r["ap"] for r in workloads.w3_score(spark, sf).collect()) > 20
