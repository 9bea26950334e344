"""The three long workloads: feature table, stacking table, and scored detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drowse.functions import scalar
from drowse.operators import calibrate, chunks, features, joins, metric, peaks, periodicity, windows

from . import queries as q


def stacking_table(s: DataFrame, events: DataFrame, reach: int = 96, by: int = 12, height: float = 0.1, distance: float = 8) -> DataFrame:
    """Candidate rows around peaks of the mean prediction, in gap chunks, with features and labels."""
    s = s.withColumns(scalar.ensemble(["pred_onset", "pred_wakeup"], "p"))
    found = peaks.find_peaks(s, "p_mean", height, distance)
    rows = windows.sessions(chunks.neighbourhood(found, reach, by), by)
    out = rows.join(s, ["series_id", "step"]).join(events.select("series_id", "step", "event"), ["series_id", "step"], "left")
    keys = ["series_id", "chunk_id"]
    out = out.withColumns({f"p_mean_{n}": windows.rolling(F.col("p_mean"), "mean", windows.centered(n, keys)) for n in (3, 5)})
    out = windows.trailing_activity(out, "enmo", 3, "lids")
    return out.withColumns(scalar.one_hot("event", ["onset", "wakeup"]))


def scored(s: DataFrame, events: DataFrame, tolerances: dict, height: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Detections from calibrated predictions, all that reach the height, and their average precision table."""
    late = calibrate.late_discount("day", 0.05)
    cal = s.withColumns({c: calibrate.by_soft_offset(c, 10.0, "series_id", "day") for c in ("pred_onset", "pred_wakeup")})
    cal = cal.withColumns({c: F.col(c) * late for c in ("pred_onset", "pred_wakeup")})
    found = peaks.greedy_events(cal, {"onset": "pred_onset", "wakeup": "pred_wakeup"}, height)
    return found, metric.ap_table(events, found, tolerances)


SMALL = features.Sizes({1: 3, 5: 6, 60: 24}, (4, 6), (5, 7), 6, 8)  # sizes of short series, and the defaults on long ones
#: Digits of a flag's mean, which may end in a 5, and of other values.
FLAGS, DIGITS = 9, 5


def _feature_columns(sizes: features.Sizes) -> dict[str, int]:
    turns = [f"{c}_{f}" for c in ("hour", "month", "minute", "minute15", "weekday") for f in ("sin", "cos")]
    daily = [f"{c}_mean_24h" for c in features.DAILY]
    return {c: FLAGS if "nonzero" in c else DIGITS for c in [*features.names(sizes), *daily, "anglez_series_norm", "enmo_series_norm", "enmo_clip", "enmo_log", *turns]}


def _told(out: DataFrame, sizes: features.Sizes) -> DataFrame:
    return out.select("series_id", "step", "hour", "minute_15", *[F.round(c, n).alias(c) for c, n in _feature_columns(sizes).items()])


def _features_sql(view: str, sizes: features.Sizes) -> str:
    columns = [f"round({c}, {n}) AS {c}" for c, n in _feature_columns(sizes).items()]
    return f'WITH {q.VIEWS}, {features.feature_sql(view, sizes)} SELECT series_id, step, "hour", minute_15, {", ".join(columns)} FROM features'


def w1_features(spark: SparkSession, d: str) -> DataFrame:
    """All features of each row, frames in proportion to the short series."""
    return _told(features.feature_table(q.series(spark, d), SMALL), SMALL)


def w1_features_720(spark: SparkSession, d: str) -> DataFrame:
    """All features at their real frames, up to 720 rows, on a few long series in blocks."""
    s = q.long_series(spark, d).withColumn("anglez", F.col("k") - 50)
    return _told(features.feature_table(s, rows=1 << 13), features.Sizes())


def w1_periodic_features(spark: SparkSession, d: str) -> DataFrame:
    """The features joined with the periodicity of the raw signal."""
    s = q.series(spark, d).withColumn("enmo", F.floor(F.col("k") / 50).cast("double"))
    out = features.feature_table(s, SMALL)
    p = periodicity.detect(s, "enmo", 8, 4, 2, 1)
    return out.join(p, ["series_id", "step"]).select("series_id", "step", F.round("lids", DIGITS).alias("lids"), "periodicity", (1 - F.col("periodicity")).alias("non_periodicity"))


def w2_stacking(spark: SparkSession, d: str) -> DataFrame:
    s = q.series(spark, d)
    return stacking_table(s, q.truth(s), 4, 1, 0.1, 4).select("series_id", "chunk_id", "step", "event_onset", "event_wakeup", F.round("p_mean_3", 6).alias("p_mean_3"), F.round("lids", 6).alias("lids"))


def w3_score(spark: SparkSession, d: str) -> DataFrame:
    s = q.series(spark, d).withColumn("chunk_id", F.floor(F.col("step") / 32))
    _, table = scored(s, q.truth(s), q.TOLERANCES, 0.01)
    return table.withColumn("ap", F.round("ap", 6))


def w3_nearest_score(spark: SparkSession, d: str) -> DataFrame:
    """The plain form in SQL terms: local maxima, matched by nearest truth alone."""
    s = q.series(spark, d).withColumn("x", F.floor(F.col("k") / 10).cast("double"))
    found = windows.local_maxima(s.select("series_id", "step", "x"), "x", 3.0)
    near = joins.nearest(found, q.truth(s).where("event = 'onset'"))
    return near.withColumn("hit", (F.abs(F.col("nearest") - F.col("step")) < 3).cast("int")).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))


QUERIES = {f.__name__: f for f in (w1_features, w1_features_720, w1_periodic_features, w2_stacking, w3_score, w3_nearest_score)}
CHUNK = "(PARTITION BY series_id, chunk_id ORDER BY step ROWS BETWEEN"
STACKING_SQL = f"""WITH RECURSIVE {q.VIEWS}, {q.maxima_sql('(pred_onset + pred_wakeup) / 2', 'mx')}, hi AS (SELECT *, 4 AS distance FROM mx WHERE x >= 0.1), {q.thinned_sql('hi', 'th', 'series_id')},
nb AS (SELECT DISTINCT series_id, step + o AS step FROM th, range(-4, 4) AS t(o) WHERE step + o >= 0),
se AS (SELECT series_id, step, CAST(sum(CASE WHEN step - l <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk_id FROM (SELECT *, lag(step) OVER (PARTITION BY series_id ORDER BY step) AS l FROM nb)),
jo AS (SELECT se.series_id, se.chunk_id, se.step, s.enmo, (s.pred_onset + s.pred_wakeup) / 2 AS p, ev.event FROM se JOIN s ON s.series_id = se.series_id AND s.step = se.step LEFT JOIN ev ON ev.series_id = se.series_id AND ev.step = se.step),
ac AS (SELECT *, avg(p) OVER {CHUNK} 1 PRECEDING AND 1 FOLLOWING) AS p3, CASE WHEN count(*) OVER {CHUNK} 2 PRECEDING AND CURRENT ROW) = 3 THEN sum(greatest(enmo - 0.02, 0)) OVER {CHUNK} 2 PRECEDING AND CURRENT ROW) END AS ac FROM jo)
SELECT series_id, chunk_id, step, CAST(coalesce(event = 'onset', false) AS INTEGER) AS event_onset, CAST(coalesce(event = 'wakeup', false) AS INTEGER) AS event_wakeup, round(p3, 6) AS p_mean_3,
  round(100 / (first_value(ac IGNORE NULLS) OVER {CHUNK} CURRENT ROW AND UNBOUNDED FOLLOWING) + 1), 6) AS lids FROM ac"""
ORACLES = {"w2_stacking": STACKING_SQL, "w1_features": _features_sql("s", SMALL), "w1_features_720": _features_sql("ls", features.Sizes()), "w1_periodic_features": f"WITH {q.VIEWS}, {q.periodicity_sql('floor(k / 50)')}, fs AS (SELECT * REPLACE (floor(k / 50) AS enmo) FROM s), {features.feature_sql('fs', SMALL)} SELECT series_id, step, round(lids, {DIGITS}) AS lids, periodicity, 1 - periodicity AS non_periodicity FROM features JOIN periodic USING (series_id, step)", "w3_nearest_score": f"WITH {q.VIEWS}, {q.PEAKS_SQL}, h AS (SELECT x, (SELECT min(abs(e.step - pk.step)) FROM ev AS e WHERE e.series_id = pk.series_id AND e.event = 'onset') < 3 AS hit FROM pk) SELECT x, count(*) AS n, CAST(coalesce(sum(CAST(hit AS INTEGER)), 0) AS BIGINT) AS hits FROM h GROUP BY x"}
