"""Event detection average precision."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drowse.sources.shared import kept

from . import blocks
from .groups import map_groups
from .joins import inside, pair_intervals
from .peaks import maxima_of, suppress

COLUMNS = {"truth": ("series_id", "event", "step"), "detections": ("series_id", "event", "step", "score")}


def match(times: Sequence[float], found: np.ndarray, scores: np.ndarray, tolerance: float) -> np.ndarray:
    """Which detections match: by score, then step, each takes the nearest free truth (the earlier of equals) nearer than the tolerance."""
    truth, free = sorted(times), [True] * len(times)
    out = np.zeros(len(found), bool)
    for j in np.lexsort((found, -scores)):
        at = bisect_left(truth, found[j])
        best, error = -1, tolerance
        i = at - 1
        while i >= 0 and found[j] - truth[i] < tolerance:
            if free[i]:
                best, error = i, found[j] - truth[i]
                break
            i -= 1
        i = at
        while i < len(truth) and truth[i] - found[j] < error:
            if free[i]:
                best, error = i, truth[i] - found[j]
                break
            i += 1
        if best >= 0:
            while best > 0 and truth[best - 1] == truth[best] and free[best - 1]:
                best -= 1
            free[best], out[j] = False, True
    return out


def matches(truth: DataFrame, detections: DataFrame, tolerances: dict[str, Sequence[float]]) -> DataFrame:
    """event, tolerance, series_id, score, matched. Detections of series without truth are left out."""
    kind = dict(truth.dtypes)["series_id"]
    series = truth.select(F.col("series_id").alias("s")).distinct()
    own = detections.where("score IS NOT NULL").join(series, F.col("series_id") == F.col("s"), "left_semi")
    keys, step = ["series_id", "event"], F.col("step").cast("double").alias("step")
    both = truth.select(*keys, step, F.lit(0.0).alias("score"), F.lit(True).alias("is_truth"))
    both = both.unionByName(own.select(*keys, step, F.col("score").cast("double").alias("score"), F.lit(False).alias("is_truth")))

    def run(rows: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        step, score, is_truth = rows["step"].to_numpy(), rows["score"].to_numpy(), rows["is_truth"].to_numpy()
        event, at, tolerance, matched = rows["event"].tolist(), [np.empty(0, int)], [], [np.empty(0, bool)]
        for a, z in spans:
            found = a + np.flatnonzero(~is_truth[a:z])
            times = np.sort(step[a:z][is_truth[a:z]]).tolist()
            for tol in tolerances.get(event[a], ()) if len(found) else ():
                at.append(found)
                tolerance += [float(tol)] * len(found)
                matched.append(match(times, step[found], score[found], tol))
        own = rows.iloc[np.concatenate(at)]
        return pd.DataFrame({"event": own["event"], "tolerance": np.array(tolerance, float), "series_id": own["series_id"], "score": own["score"], "matched": np.concatenate(matched).astype(int)})

    return map_groups(both, keys, [], run, f"event string, tolerance double, series_id {kind}, score double, matched int")


CURVE = ("event", "tolerance")


def pr_points(matched: DataFrame, totals: DataFrame, keys: Sequence[str] = CURVE) -> DataFrame:
    """The keys of a curve, score, precision, recall, gained (recall won at this score), place (from 0, highest score first) at each distinct score.
    totals: event, n of truths. Scores are counted before the running sums, which are two-phase: blocks of scores, then their offsets."""
    by_score = kept(matched.groupBy(*keys, "score").agg(F.sum("matched").alias("hits"), F.count(F.lit(1)).alias("seen")), "scores")
    run = blocks.scan(by_score, list(keys), "score", {"tp": F.col("hits"), "n_det": F.col("seen"), "place": F.lit(1).cast("long")}, descending=True)
    run = run.join(F.broadcast(totals), "event")  # one row for each event
    return run.select(*keys, "score", (F.col("tp") / F.col("n_det")).alias("precision"), (F.col("tp") / F.col("n")).alias("recall"), (F.col("hits") / F.col("n")).alias("gained"), (F.col("place") - 1).alias("place"))


def average_precision(points: DataFrame, keys: Sequence[str] = CURVE) -> DataFrame:
    """The keys of a curve, and ap: sum of recall gained times precision."""
    return points.groupBy(*keys).agg(F.sum(F.col("gained") * F.col("precision")).alias("ap"))


#: Points in a row of `pr_table`.
PIECE = 4096


def pr_table(points: DataFrame, size: int = PIECE) -> DataFrame:
    """event, tolerance, first (place of the first point), precision, recall: a curve in arrays of `size` points, highest scores first."""
    own = points.withColumn("first", F.floor(F.col("place") / size) * size)
    listed = F.array_sort(F.collect_list(F.struct("place", "precision", "recall")))
    out = own.groupBy("event", "tolerance", "first").agg(listed.alias("p"))
    return out.select("event", "tolerance", "first", F.transform("p", lambda x: x["precision"]).alias("precision"), F.transform("p", lambda x: x["recall"]).alias("recall"))


def ap_table(truth: DataFrame, detections: DataFrame, tolerances: dict[str, Sequence[float]], marks: DataFrame | None = None) -> DataFrame:
    """event, tolerance, ap for every given tolerance of an event in the truth. marks: 'start' and 'end' rows of scoring intervals."""
    for name, df in (("truth", truth), ("detections", detections)):
        if missing := set(COLUMNS[name]) - set(df.columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
    if marks is not None:
        detections = inside(detections, pair_intervals(marks))
    totals = truth.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    grid = truth.sparkSession.createDataFrame([(e, float(t)) for e, ts in tolerances.items() for t in ts], "event string, tolerance double")
    ap = average_precision(pr_points(matches(truth, detections, tolerances), totals))
    return F.broadcast(grid).join(totals.select("event"), "event").join(ap, ["event", "tolerance"], "left").select("event", "tolerance", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_ap(table: DataFrame) -> DataFrame:
    return table.groupBy("event").agg(F.avg("ap").alias("ap")).agg(F.avg("ap").alias("mean_ap"))


def sweep(df: DataFrame, x: dict[str, str], truth: DataFrame, tolerances: dict[str, Sequence[float]], grid: Sequence[tuple[float, float]]) -> DataFrame:
    """height, distance, mean_ap of peak picking at each (height, distance). The series is scanned once, for maxima of the least height; each
    series' and event's maxima and truths then pass through one call, which thins and matches them for all points of the grid."""
    maxima = maxima_of(df, x, min(h for h, _ in grid))
    series = truth.select(F.col("series_id").alias("s")).distinct()
    own = maxima.join(series, F.col("series_id") == F.col("s"), "left_semi")
    both = own.select("series_id", "event", F.col("step").cast("double").alias("step"), "score", "row")
    both = both.unionByName(truth.select("series_id", "event", F.col("step").cast("double").alias("step"), F.lit(None).cast("double").alias("score"), F.lit(-1).alias("row")))

    def run(rows: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        step, score, row, event = rows["step"].to_numpy(), rows["score"].to_numpy(), rows["row"].to_numpy(), rows["event"].tolist()
        cells, scores, hits = [], [np.empty(0)], [np.empty(0, bool)]
        for a, z in spans:
            times = np.sort(step[a:z][row[a:z] < 0]).tolist()
            peaks = a + np.flatnonzero(row[a:z] >= 0)
            for point, (height, distance) in enumerate(grid):
                high = peaks[score[peaks] >= height]
                found = high[suppress(row[high], score[high], distance)]
                for tol in tolerances.get(event[a], ()) if len(found) else ():
                    cells.append((point, event[a], float(tol), len(found)))
                    scores.append(score[found])
                    hits.append(match(times, step[found], score[found], tol))
        each = lambda i: np.repeat(np.array([c[i] for c in cells], object), [c[3] for c in cells]) if cells else []
        return pd.DataFrame({"point": each(0), "event": each(1), "tolerance": each(2), "score": np.concatenate(scores), "matched": np.concatenate(hits).astype(int)})

    matched = map_groups(both, ["series_id", "event"], ["row"], run, "point int, event string, tolerance double, score double, matched int")
    totals, keys = truth.groupBy("event").agg(F.count(F.lit(1)).alias("n")), ("point", *CURVE)
    ap = average_precision(pr_points(matched, totals, keys), keys)
    spark = truth.sparkSession
    points = spark.createDataFrame([(i, float(h), float(d)) for i, (h, d) in enumerate(grid)], "point int, height double, distance double")
    cells = spark.createDataFrame([(e, float(t)) for e, ts in tolerances.items() for t in ts], "event string, tolerance double").join(totals.select("event"), "event")
    whole = points.crossJoin(cells).join(ap, list(keys), "left")  # the grid times the tolerances, both given
    by_event = whole.groupBy("point", "height", "distance", "event").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("ap"))
    return by_event.groupBy("height", "distance").agg(F.avg("ap").alias("mean_ap"))
