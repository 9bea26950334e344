"""The metric on hand-worked cases, and the matcher against a plain form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drowse.operators import metric, peaks

TWO = [("a", "pass", 0.0), ("a", "pass", 15.0)]
FOUND = [0.0, 10.0, 14.5]


def run(spark, truth, found, tolerances, marks=None):
    t = spark.createDataFrame(truth, "series_id string, event string, step double")
    d = spark.createDataFrame(found, "series_id string, event string, step double, score double")
    m = spark.createDataFrame(marks, "series_id string, kind string, step double") if marks else None
    return metric.mean_ap(metric.ap_table(t, d, tolerances, m)).first()[0]


@pytest.mark.parametrize(("scores", "tolerances", "want"), [((1.0, 0.5, 1.0), [1.0], 1.0), ((1.0, 1.5, 1.0), [1.0], 2 / 3), ((0.0, 0.5, 1.0), [1.0], 5 / 6), ((0.0, 0.5, 1.0), [0.1, 0.2, 1.0], 0.3888888888)])
def test_one_event(spark, scores, tolerances, want):
    found = [("a", "pass", t, s) for t, s in zip(FOUND, scores, strict=True)]
    assert run(spark, TWO, found, {"pass": tolerances}) == pytest.approx(want)


def test_two_events_and_series(spark):
    truth = [("a", "pass", 0.0), ("a", "challenge", 15.0), ("b", "pass", 0.0)]
    found = [("a", "pass", 0.0, 1.0), ("a", "challenge", 15.0, 0.5), ("b", "pass", 0.0, 1.0)]
    assert run(spark, truth, found, {"pass": [0.5, 1.0], "challenge": [0.25, 0.5]}) == 1.0


def test_scoring_intervals(spark):
    truth = [("a", "pass", 10.0), ("a", "pass", 20.0)]
    found = [("a", "pass", 10.0, 1.0), ("a", "pass", 20.0, 1.0), ("a", "pass", 40.0, 1.0)]
    assert run(spark, truth, found, {"pass": [1.0]}, [("a", "start", 0.0), ("a", "end", 30.0)]) == 1.0


def test_at_the_tolerance_nothing_matches(spark):
    assert run(spark, [("a", "pass", 0.0)], [("a", "pass", 1.0, 1.0)], {"pass": [1.0]}) == 0.0


def test_missing_column(spark):
    d = spark.createDataFrame([("a", 1.0)], "series_id string, step double")
    with pytest.raises(ValueError, match="event"):
        metric.ap_table(d, d, {"pass": [1.0]})


def plain(times, found, scores, tol):
    left, out = sorted(times), [False] * len(found)
    for j in sorted(range(len(found)), key=lambda i: (-scores[i], found[i])):
        near = [(abs(t - found[j]), t) for t in left if abs(t - found[j]) < tol]
        if near:
            left.remove(min(near)[1])
            out[j] = True
    return out


def test_matcher_against_plain_form():
    rng = np.random.default_rng(1)
    for _ in range(200):
        times, found = rng.integers(0, 60, rng.integers(0, 12)).astype(float), rng.integers(0, 60, rng.integers(1, 30)).astype(float)
        scores = rng.integers(0, 6, len(found)).astype(float)
        for tol in (1, 4, 12):
            assert metric.match(times.tolist(), found, scores, tol).tolist() == plain(times.tolist(), found, scores, tol)


def test_matches_against_plain_form(spark):
    """Many series and events, rows in any order: all tolerances at once give what the plain form gives for each."""
    rng = np.random.default_rng(2)
    truth = [(f"s{rng.integers(0, 30)}", str(rng.choice(["onset", "wakeup"])), float(rng.integers(0, 80))) for _ in range(150)]
    found = [(f"s{rng.integers(0, 35)}", str(rng.choice(["onset", "wakeup", "other"])), float(rng.integers(0, 80)), float(rng.integers(0, 6))) for _ in range(600)]
    t = spark.createDataFrame(truth, "series_id string, event string, step double").repartition(3)
    d = spark.createDataFrame(found, "series_id string, event string, step double, score double").repartition(3)
    tolerances = {"onset": [1, 4], "wakeup": [12]}
    got = sorted(map(tuple, metric.matches(t, d, tolerances).select("event", "tolerance", "series_id", "score", "matched").collect()))
    series, want = {s for s, _, _ in truth}, []
    for event, ts in tolerances.items():
        for s in series:
            own = [(x, y) for n, e, x, y in found if (n, e) == (s, event)]
            for tol in ts:
                hit = plain([x for n, e, x in truth if (n, e) == (s, event)], [x for x, _ in own], [y for _, y in own], tol)
                want += [(event, float(tol), s, y, int(h)) for (_, y), h in zip(own, hit, strict=True)]
    assert got == sorted(want)


def test_sweep_is_the_loop(spark):
    """All points of the grid in one pass give what picking, matching and scoring at each one gives; the series is scanned once."""
    rng = np.random.default_rng(3)
    rows = [(s, i, float(np.round(rng.random(), 2)), float(np.round(rng.random(), 1))) for s in range(6) for i in range(80)]
    truth = [(s, str(rng.choice(["onset", "wakeup"])), int(rng.integers(0, 80))) for s in range(5) for _ in range(6)]
    df = spark.createDataFrame(rows, "series_id long, step long, a double, b double")
    t = spark.createDataFrame(truth, "series_id long, event string, step long")
    tolerances, grid = {"onset": [1, 3], "wakeup": [2]}, [(h, d) for h in (0.3, 0.6, 0.95, 2.0) for d in (1, 4.5, 9)]
    got = {(r["height"], r["distance"]): r["mean_ap"] for r in metric.sweep(df, {"onset": "a", "wakeup": "b"}, t, tolerances, grid).collect()}
    assert len(got) == len(grid)
    for h, d in grid[::5]:
        found = [peaks.find_peaks(df, c, h, d).withColumn("event", F.lit(e)) for e, c in (("onset", "a"), ("wakeup", "b"))]
        want = metric.mean_ap(metric.ap_table(t, found[0].unionByName(found[1]), tolerances)).first()[0]
        assert got[h, d] == pytest.approx(want, abs=1e-12)
    maxima = peaks.maxima_of(df, {"onset": "a", "wakeup": "b"}, 0.3)
    assert maxima._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
