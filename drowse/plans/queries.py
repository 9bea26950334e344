"""One query per operator over the given tables, with SQL that DuckDB can run where the operator can be told in SQL.

The events table stands for sensor series: a user is a series, its events in time order are the steps; value and props.k make the
signals, sign-ups and purchases the true onsets and wakeups. Sizes that are in steps are small, since series are short.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drowse.functions import scalar
from drowse.operators import blocks, calibrate, chunks, joins, metric, peaks, periodicity, rolling, splits, windows
from drowse.operators.rolling import Rolling
from drowse.sources import files, shared, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

START = 1704067200  # 2024-01-01
TOLERANCES = {"onset": [1, 3, 8], "wakeup": [1, 3, 8]}

VIEWS = f"""s AS (SELECT user_id AS series_id, event_id, ts, event_type, value, value / 100 AS enmo, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS anglez, value / 500 AS pred_onset, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS pred_wakeup,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, CAST(floor((epoch(ts) - {START}) / 5) AS BIGINT) AS step5, CAST(ts AS DATE) AS day FROM events),
ls AS (SELECT event_type AS series_id, event_id, ts, value, value / 100 AS enmo, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS anglez, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events),
ev AS (SELECT series_id, step, step5, day, CASE event_type WHEN 'signup' THEN 'onset' WHEN 'purchase' THEN 'wakeup' END AS event FROM s WHERE event_type IN ('signup', 'purchase'))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("double")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("series_id"), "event_id", ts.alias("ts"), "event_type", "value", k.alias("k"))
    step = F.row_number().over(Window.partitionBy("series_id").orderBy("ts", "event_id")) - 1
    return e.withColumns({"enmo": F.col("value") / 100, "anglez": F.col("k") - 50, "pred_onset": F.col("value") / 500, "pred_wakeup": F.col("k") / 100, "step": step.cast("long"), "step5": F.floor((F.unix_timestamp("ts") - START) / 5), "day": F.to_date("ts")})


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event type is a series here: a few long ones, numbered in blocks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("event_type").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("value") / 100).alias("enmo"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return blocks.numbered(e, ["series_id"], ["ts", "event_id"], "step")


def truth(s: DataFrame) -> DataFrame:
    event = F.when(F.col("event_type") == "signup", "onset").when(F.col("event_type") == "purchase", "wakeup")
    return s.select("series_id", "step", "step5", "day", event.alias("event")).where("event IS NOT NULL")


def detections(s: DataFrame) -> DataFrame:
    event = F.when(F.col("event_type") == "click", "onset").when(F.col("event_type") == "view", "wakeup")
    return s.select("series_id", "step", event.alias("event"), F.round("value", 1).alias("score")).where("event IS NOT NULL")


def r6(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def query(name: str, sql: str | None = None, view: Callable[[SparkSession, str], DataFrame] = series):
    """Registers fn(series view). sql follows the shared views."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(view(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {VIEWS}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return fn

    return add


W = "OVER (PARTITION BY series_id ORDER BY step"


# --- sources

def _folder(s: DataFrame, name: str) -> str:
    return f"{shared.shared_dir(s.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("a1_read_series", "SELECT CAST(series_id AS VARCHAR) AS series_id, step, CAST(floor(epoch(ts)) AS BIGINT) AS at, anglez, round(CAST(enmo AS FLOAT)::DOUBLE, 6) AS enmo FROM s")
def _(s):
    """Written as devices write them, times as text with an offset, and read back by the reader."""
    path, local = _folder(s, "series"), F.date_format(F.col("ts") - F.expr("INTERVAL 4 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    s.select(F.col("series_id").cast("string").alias("series_id"), "step", F.concat(local, F.lit("-0400")).alias("timestamp"), F.col("anglez").cast("float").alias("anglez"), F.col("enmo").cast("float").alias("enmo")).write.parquet(path)
    got = files.read_series(s.sparkSession, path, ["series_id", "step", "timestamp", "anglez", "enmo"])
    return r6(got.select("series_id", "step", F.unix_timestamp("timestamp").alias("at"), F.col("anglez").cast("double").alias("anglez"), F.col("enmo").cast("double").alias("enmo")), "enmo")


@query("a2_annotated_events", "SELECT CAST(series_id AS VARCHAR) AS series_id, CAST(date_diff('day', DATE '2024-01-01', day) AS INTEGER) AS night, event, step FROM ev WHERE step % 5 <> 0")
def _(s):
    """Written as CSV, every fifth step left empty, and read back by the reader, which drops rows without a step."""
    path, e = _folder(s, "events"), truth(s)
    night = F.datediff("day", F.lit("2024-01-01").cast("date"))
    told = e.select(F.col("series_id").cast("string"), night.alias("night"), "event", F.when(F.col("step") % 5 != 0, F.col("step").cast("double")).alias("step"), F.lit("2024-01-02T03:04:05-0400").alias("timestamp"))
    told.write.option("header", True).csv(path)
    return files.read_events(s.sparkSession, path).select("series_id", "night", "event", "step")


@query("a4_store_merge", "SELECT a.series_id, a.step, a.pred_onset AS p_m1, b.pred_wakeup AS p_m2, c.value AS p_m3 FROM s AS a JOIN s AS b USING (series_id, step) JOIN s AS c USING (series_id, step) WHERE b.step % 2 = 0 AND c.step % 3 = 0")
def _(s):
    """Three tables of predictions, written to the store and merged from there without a shuffle."""
    parts = {"pred_onset": F.lit(True), "pred_wakeup": F.col("step") % 2 == 0, "value": F.col("step") % 3 == 0}
    stored = []
    for c, rows in parts.items():
        stored.append(_folder(s, "predictions"))
        store.write_store(s.where(rows).select("series_id", "step", F.col(c).alias("p")), stored[-1], buckets=8)
    return joins.merge_predictions([store.read_store(s.sparkSession, path) for path in stored], ["m1", "m2", "m3"])


@query("a6_written_detections", "SELECT row_number() OVER (ORDER BY series_id, step, event) - 1 AS row_id, series_id, step, event, round(value, 1) AS score FROM (SELECT *, CASE event_type WHEN 'click' THEN 'onset' ELSE 'wakeup' END AS event FROM s WHERE event_type IN ('click', 'view'))")
def _(s):
    """Numbered, written as Parquet and as CSV, and read back: both must hold the same rows."""
    path = _folder(s, "detections")
    files.write_detections(detections(s), path)
    rows = s.sparkSession.read.parquet(f"{path}/parquet").select("row_id", "series_id", "step", "event", "score")
    told = s.sparkSession.read.option("header", True).csv(f"{path}/csv")
    same = told.select(F.col("row_id").cast("long"), F.col("series_id").cast("long"), F.col("step").cast("long"), "event", F.col("score").cast("double"))
    return rows.intersect(same)


@query("a3_fold_lists", "SELECT series_id % 3 AS fold, 'train' AS role, series_id FROM (SELECT DISTINCT series_id FROM s) UNION ALL SELECT series_id % 3, 'valid', series_id + 1000000 FROM (SELECT DISTINCT series_id FROM s)")
def _(s):
    ids = s.select("series_id").distinct().groupBy((F.col("series_id") % 3).alias("fold"))
    return files.explode_folds(ids.agg(F.collect_list("series_id").alias("train_series_ids"), F.collect_list(F.col("series_id") + 1_000_000).alias("valid_series_ids")))


@query("a6_row_ids", "SELECT row_number() OVER (ORDER BY series_id, step) - 1 AS row_id, series_id, step FROM s")
def _(s):
    return files.with_row_id(s.select("series_id", "step")).select("row_id", "series_id", "step")


QUERIES["a5_arrays_to_steps"] = lambda spark, d: files.explode_periodicity(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("periodicity")))
ORACLES["a5_arrays_to_steps"] = "SELECT vec_id AS series_id, CAST(i AS INTEGER) AS step, round(embedding[i + 1]::DOUBLE, 6) AS periodicity FROM embeddings, range(0, 4096) AS t(i) WHERE i < len(embedding)"


# --- expressions

@query("b1_fixed_zscore", "SELECT series_id, step, anglez AS anglez_raw, round((anglez + 8.810476) / 35.521877, 6) AS anglez, round((enmo - 0.041315) / 0.101829, 6) AS enmo FROM s")
def _(s):
    return r6(scalar.zscore_fixed(s).select("series_id", "step", "anglez_raw", "anglez", "enmo"), "anglez", "enmo")


@query("b2_cyclic_time", "SELECT series_id, step, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos, round(sin(2 * pi() * (isodow(ts) % 7) / 7), 6) + 0.0 AS week_sin FROM s")
def _(s):
    c = scalar.calendar()
    week = scalar.cyclic(c["weekday"], 7, "week")[0]
    zero = lambda x: F.round(x, 6) + 0.0
    h = scalar.cyclic(c["hour"], 24, "hour")
    return s.select("series_id", "step", zero(h[0]).alias("hour_sin"), zero(h[1]).alias("hour_cos"), zero(week).alias("week_sin"))


@query("b3_calendar", "SELECT series_id, step, hour(ts) AS hour, minute(ts) AS minute, minute(ts) % 15 AS minute15, isodow(ts) AS weekday, hour(ts) + minute(ts) AS time_idx FROM s")
def _(s):
    return s.select("series_id", "step", *[c.cast("long").alias(n) for n, c in scalar.calendar().items()])


@query("b4_clip_log", "SELECT series_id, step, least(enmo, 0.7) AS clipped, round(least(ln(1 + enmo) / 0.1, 10), 6) AS logged, round(anglez / 45, 6) AS scaled FROM s")
def _(s):
    return s.select("series_id", "step", F.least("enmo", F.lit(0.7)).alias("clipped"), F.round(scalar.clip_log(F.col("enmo")), 6).alias("logged"), F.round(F.col("anglez") / 45, 6).alias("scaled"))


@query("b5_minute", "SELECT series_id, step, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute FROM s")
def _(s):
    return s.select("series_id", "step", F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute"))


@query("b6_shifted_day", "SELECT series_id, step, CAST(CAST(ts + INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS onset_day, CAST(CAST(ts - INTERVAL 12 HOUR AS DATE) AS VARCHAR) AS noon_day FROM s")
def _(s):
    return s.select("series_id", "step", scalar.shifted_date(F.col("ts"), 5).cast("string").alias("onset_day"), scalar.shifted_date(F.col("ts"), -12).cast("string").alias("noon_day"))


@query("b7_one_hot", "SELECT series_id, step, CAST(coalesce(event_type = 'signup', false) AS INTEGER) AS event_type_signup, CAST(coalesce(event_type = 'purchase', false) AS INTEGER) AS event_type_purchase FROM s")
def _(s):
    return s.select("series_id", "step", *[c.alias(n) for n, c in scalar.one_hot("event_type", ["signup", "purchase"]).items()])


@query("b8_binary_labels", "SELECT s.series_id, s.step, CAST(coalesce(ev.event = 'onset', false) AS INTEGER) AS onset, CAST(coalesce(ev.event = 'wakeup', false) AS INTEGER) AS wakeup FROM s LEFT JOIN ev USING (series_id, step)")
def _(s):
    e = s.select("series_id", "step").join(truth(s).select("series_id", "step", "event"), ["series_id", "step"], "left")
    return e.select("series_id", "step", *[F.coalesce((F.col("event") == v).cast("int"), F.lit(0)).alias(v) for v in ("onset", "wakeup")])


@query("b9_ensemble", "SELECT series_id, step, round((a + b + c) / 3, 6) AS p_mean, round(least(a, b, c), 6) AS p_min, round(greatest(a, b, c), 6) AS p_max, round((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3, 6) AS p_var FROM (SELECT series_id, step, pred_onset AS a, pred_wakeup AS b, enmo AS c FROM s)")
def _(s):
    e = scalar.ensemble(["pred_onset", "pred_wakeup", "enmo"], "p")
    return s.select("series_id", "step", *[F.round(c, 6).alias(n) for n, c in e.items()])


@query("b10_series_subset", "SELECT series_id, step FROM s WHERE series_id IN (SELECT series_id FROM s GROUP BY series_id HAVING count(*) > 60)")
def _(s):
    ids = s.groupBy("series_id").count().where("count > 60")
    return s.join(ids, "series_id", "left_semi").select("series_id", "step")


@query("b11_suppress_periodic", "SELECT series_id, step, round(pred_onset * (1 - CASE WHEN step % 4 = 0 THEN 0.5 ELSE 0 END), 6) AS pred_onset FROM s")
def _(s):
    p = s.where("step % 4 = 0").select("series_id", "step", F.lit(0.5).alias("periodicity"))
    return r6(joins.suppress(s.select("series_id", "step", "pred_onset"), p, ["pred_onset"]), "pred_onset")


@query("b12_only_aperiodic", "SELECT series_id, step FROM s WHERE k = 0")
def _(s):
    return s.withColumn("periodicity", F.col("k")).where("periodicity = 0").select("series_id", "step")


@query("b13_every_nth", "SELECT series_id, step, value FROM s WHERE step % 4 = 0")
def _(s):
    return s.where("step % 4 = 0").select("series_id", "step", "value")


@query("b14_fill_mean", "SELECT series_id, step, round(coalesce(CASE WHEN k >= 50 THEN k END, (SELECT avg(k) FROM s WHERE k >= 50)), 6) AS x FROM s")
def _(s):
    x = s.select("series_id", "step", F.when(F.col("k") >= 50, F.col("k")).when(F.col("k") < 20, float("nan")).alias("x"))
    return r6(scalar.fill_mean(x, ["x"]), "x")


@query("b15_probabilities", "SELECT series_id, step, round(1 / (1 + exp(-anglez / 10)), 6) AS p, round(exp(pred_wakeup) / (exp(enmo) + exp(pred_onset) + exp(pred_wakeup)), 6) AS share, CASE WHEN enmo >= pred_onset AND enmo >= pred_wakeup THEN 0 WHEN pred_onset >= pred_wakeup THEN 1 ELSE 2 END AS top FROM s")
def _(s):
    l = [F.col("enmo"), F.col("pred_onset"), F.col("pred_wakeup")]
    return s.select("series_id", "step", F.round(scalar.sigmoid(F.col("anglez") / 10), 6).alias("p"), F.round(scalar.softmax_share(l, 2), 6).alias("share"), scalar.arg_max(l).cast("int").alias("top"))


@query("b16_soft_targets", "SELECT series_id, step, round(CASE WHEN pred_wakeup = 1 THEN 1 ELSE greatest(pred_wakeup - 0.1, 0) END, 6) AS decayed, round(greatest(pred_onset, CASE WHEN pred_wakeup >= 0.5 THEN pred_wakeup ELSE 0 END * 0.8), 6) AS corrected FROM s")
def _(s):
    return s.select("series_id", "step", F.round(scalar.decay(F.col("pred_wakeup")), 6).alias("decayed"), F.round(scalar.correct_label(F.col("pred_onset"), F.col("pred_wakeup"), 0.5, 0.8), 6).alias("corrected"))


@query("b17_columns_by_pattern", "SELECT pred_onset, pred_wakeup FROM s")
def _(s):
    return scalar.columns_like(s, "^pred_.*$")


@query("b18_span_keys", "SELECT series_id, step, 'a_' || series_id || '_' || (step // 16 * 16) || '_' || (step // 16 * 16 + 16) AS span_key, 'a_' || series_id AS parsed_series, step // 16 * 16 AS parsed_start, step // 16 * 16 + 16 AS parsed_end FROM s")
def _(s):
    start = F.floor(F.col("step") / 16) * 16
    s = s.withColumn("span_key", scalar.span_key(F.concat(F.lit("a_"), F.col("series_id").cast("string")), start, start + 16))
    a, b, c = scalar.parse_span_key(F.col("span_key"))
    return s.select("series_id", "step", "span_key", a.alias("parsed_series"), b.alias("parsed_start"), c.alias("parsed_end"))


@query("b18_chunk_keys", "SELECT series_id, step, series_id || '_' || lpad(CAST(step // 16 AS VARCHAR), 7, '0') AS chunk_key, CAST(series_id AS VARCHAR) AS parsed_series, step // 16 AS parsed_no FROM s")
def _(s):
    s = s.withColumn("chunk_key", scalar.chunk_key(F.col("series_id"), F.floor(F.col("step") / 16)))
    a, b = scalar.parse_chunk_key(F.col("chunk_key"))
    return s.select("series_id", "step", "chunk_key", a.alias("parsed_series"), b.alias("parsed_no"))


# --- joins

@query("c1_label_steps", "SELECT s.series_id, s.step, ev.event FROM s LEFT JOIN ev USING (series_id, step)")
def _(s):
    return s.select("series_id", "step").join(truth(s).select("series_id", "step", "event"), ["series_id", "step"], "left")


@query("c2_label_hours", "SELECT s.series_id, s.step, h.event FROM s LEFT JOIN (SELECT series_id, date_trunc('hour', ts) AS h, min(event_type) AS event FROM s WHERE event_type = 'signup' GROUP BY ALL) AS h ON s.series_id = h.series_id AND date_trunc('hour', s.ts) = h.h")
def _(s):
    s = s.withColumn("h", F.date_trunc("hour", "ts"))
    e = s.where("event_type = 'signup'").groupBy("series_id", "h").agg(F.min("event_type").alias("event"))
    return s.join(e, ["series_id", "h"], "left").select("series_id", "step", "event")


@query("c3_complete_nights", "SELECT series_id, CAST(day AS VARCHAR) AS night, step, event FROM ev WHERE (series_id, day) IN (SELECT (series_id, day) FROM ev GROUP BY series_id, day HAVING count(*) = 2)")
def _(s):
    return joins.complete_nights(truth(s).withColumn("night", F.col("day").cast("string"))).select("series_id", "night", "step", "event")


@query("c4_series_without_events", "SELECT DISTINCT series_id FROM s WHERE series_id NOT IN (SELECT series_id FROM s WHERE event_type = 'signup' AND value > 300)")
def _(s):
    return s.select("series_id").distinct().join(s.where("event_type = 'signup' AND value > 300"), "series_id", "left_anti")


@query("c5_merge_predictions", "SELECT a.series_id, a.step, a.pred_onset AS p_m1, b.pred_wakeup AS p_m2 FROM s AS a JOIN s AS b USING (series_id, step) WHERE b.step % 2 = 0")
def _(s):
    keys = ["series_id", "step"]
    return joins.merge_predictions([s.select(*keys, F.col("pred_onset").alias("p")), s.where("step % 2 = 0").select(*keys, F.col("pred_wakeup").alias("p"))], ["m1", "m2"])


@query("c6_align_predictions", "SELECT series_id, step, a.p AS p_m1, b.p AS p_m2 FROM (SELECT series_id, step, pred_onset AS p FROM s WHERE step % 3 <> 0) AS a FULL JOIN (SELECT series_id, step, pred_wakeup AS p FROM s WHERE step % 2 = 0) AS b USING (series_id, step)")
def _(s):
    keys = ["series_id", "step"]
    return joins.merge_predictions([s.where("step % 3 <> 0").select(*keys, F.col("pred_onset").alias("p")), s.where("step % 2 = 0").select(*keys, F.col("pred_wakeup").alias("p"))], ["m1", "m2"], how="full")


@query("c7_join_back", "+m AS (SELECT series_id, date_trunc('hour', ts) AS hour, avg(pred_onset) AS p FROM s GROUP BY ALL) SELECT s.series_id, s.step, round(m.p, 6) AS p FROM s JOIN m ON s.series_id = m.series_id AND date_trunc('hour', s.ts) = m.hour")
def _(s):
    coarse = s.groupBy("series_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("pred_onset").alias("p"))
    return r6(joins.join_back(s.select("series_id", "step", "ts"), coarse, "hour").select("series_id", "step", "p"), "p")


@query("c8_candidate_rows", "+n AS (SELECT DISTINCT series_id, step + o AS step FROM s, range(-8, 8, 4) AS t(o) WHERE event_type = 'signup' AND step + o >= 0) SELECT n.series_id, n.step, s.pred_onset, CASE WHEN n.series_id % 3 = 0 THEN 0 ELSE n.series_id % 5 END AS fold FROM n JOIN s USING (series_id, step)")
def _(s):
    folds = s.where("series_id % 3 <> 0").select("series_id", (F.col("series_id") % 5).alias("fold")).distinct()
    found = chunks.neighbourhood(s.where("event_type = 'signup'"), 8, 4)
    return joins.candidate_rows(found, s.select("series_id", "step", "pred_onset"), folds).select("series_id", "step", "pred_onset", "fold")


@query("c9_stage_two_rows", "SELECT s.series_id, s.step, a.pred_onset, b.pred_wakeup FROM s LEFT JOIN (SELECT * FROM s WHERE step % 2 = 0) AS a USING (series_id, step) JOIN (SELECT * FROM s WHERE step % 3 = 0) AS b USING (series_id, step)")
def _(s):
    keys = ["series_id", "step"]
    return s.select(*keys).join(s.where("step % 2 = 0").select(*keys, "pred_onset"), keys, "left").join(s.where("step % 3 = 0").select(*keys, "pred_wakeup"), keys)


SPANS_SQL = "sp AS (SELECT series_id, min(step) AS onset, max(step) AS wakeup FROM s WHERE event_type IN ('signup', 'purchase') GROUP BY series_id, day)"


def spans(s: DataFrame) -> DataFrame:
    return truth(s).groupBy("series_id", "day").agg(F.min("step").alias("onset"), F.max("step").alias("wakeup")).drop("day")


def chunk_bounds(s: DataFrame, size: int = 16) -> DataFrame:
    return chunks.windows(s, size, size).select("series_id", "start", (F.col("start") + size).alias("end"))


CHUNKS_SQL = "ch AS (SELECT series_id, st AS start, st + 16 AS \"end\" FROM (SELECT series_id, unnest(range(0, max(step) + 1, 16)) AS st FROM s GROUP BY series_id))"


@query("c10_interval_overlap", f'+{CHUNKS_SQL}, {SPANS_SQL} SELECT ch.series_id, start, "end", onset, wakeup FROM ch JOIN sp ON ch.series_id = sp.series_id AND start <= wakeup AND onset <= "end"')
def _(s):
    return joins.overlaps(chunk_bounds(s), spans(s), "start", "end", "onset", "wakeup", 16).select("series_id", "start", "end", "onset", "wakeup")


@query("c11_points_in_intervals", "+m AS (SELECT series_id, event_type, step, row_number() OVER (PARTITION BY series_id, event_type ORDER BY step) AS n FROM s WHERE event_type IN ('signup', 'purchase')), i AS (SELECT a.series_id, a.step AS a, b.step AS b FROM m AS a JOIN m AS b USING (series_id, n) WHERE a.event_type = 'signup' AND b.event_type = 'purchase') SELECT series_id, step FROM s WHERE EXISTS (SELECT 1 FROM i WHERE i.series_id = s.series_id AND s.step BETWEEN a AND b)")
def _(s):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end")
    marks = s.select("series_id", "step", kind.alias("kind")).where("kind IS NOT NULL")
    return joins.inside(s.select("series_id", "step"), joins.pair_intervals(marks))


@query("c12_nearest_event", "SELECT d.series_id, d.step, (SELECT arg_min(e.step, abs(e.step - d.step) * 2 + CASE WHEN e.step >= d.step THEN 0 ELSE 1 END) FROM ev AS e WHERE e.series_id = d.series_id AND e.event = 'onset') AS nearest FROM s AS d WHERE event_type = 'click'")
def _(s):
    return joins.nearest(s.where("event_type = 'click'").select("series_id", "step"), truth(s).where("event = 'onset'"))


@query("c13_evaluation_keys", "SELECT DISTINCT ev.series_id, ev.event, t.tolerance FROM ev, (VALUES (1::DOUBLE), (3::DOUBLE), (8::DOUBLE)) AS t(tolerance)")
def _(s):
    tol = s.sparkSession.createDataFrame([(1.0,), (3.0,), (8.0,)], "tolerance double")
    return truth(s).select("series_id", "event").distinct().join(F.broadcast(tol))


@query("c14_detection_times", "SELECT d.series_id, d.step, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT series_id, step FROM s WHERE event_type = 'click') AS d JOIN s USING (series_id, step)")
def _(s):
    return s.where("event_type = 'click'").select("series_id", "step").join(s.select("series_id", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")), ["series_id", "step"])


# --- aggregates

@query("d1_resample", "SELECT series_id, CAST(day AS VARCHAR) AS day, round(avg(pred_onset), 9) AS pred_onset, round(avg(enmo), 9) AS enmo, arg_min(event_type, step) AS event, min(step) AS step FROM s GROUP BY series_id, s.day")
def _(s):
    return r6(s.groupBy("series_id", F.col("day").cast("string").alias("day")).agg(F.avg("pred_onset").alias("pred_onset"), F.avg("enmo").alias("enmo"), F.min_by("event_type", "step").alias("event"), F.min("step").alias("step")), "pred_onset", "enmo", digits=9)


OVER_SQL = "o AS (SELECT s.*, c AS chunk_no, step - c * 8 AS pos FROM s, range(0, 4096) AS t(c) WHERE c * 8 <= step AND step < c * 8 + 16)"


@query("d2_overlap_mean", f"+{OVER_SQL} SELECT series_id, step, round(avg(pred_onset * (1 + pos / 16)), 9) AS p FROM o GROUP BY ALL")
def _(s):
    o = chunks.overlapping(s, 16, 8)
    return r6(o.groupBy("series_id", "step").agg(F.avg(F.col("pred_onset") * (1 + F.col("pos") / 16)).alias("p")), "p", digits=9)


@query("d3_shifted_ensemble", "SELECT series_id, step, round(avg(p), 6) AS p, count(*) AS n FROM (SELECT series_id, step, pred_onset AS p FROM s UNION ALL SELECT series_id, step - 2, pred_onset FROM s WHERE step >= 2) GROUP BY ALL")
def _(s):
    both = s.select("series_id", "step", F.col("pred_onset").alias("p")).unionByName(s.where("step >= 2").select("series_id", (F.col("step") - 2).alias("step"), F.col("pred_onset").alias("p")))
    return r6(both.groupBy("series_id", "step").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n")), "p")


@query("d4_exploded_chunks", f"+{OVER_SQL} SELECT series_id, step, round(avg(pred_wakeup), 6) AS p FROM o WHERE pos % 5 <> 0 GROUP BY ALL")
def _(s):
    o = chunks.overlapping(s, 16, 8).groupBy("series_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("pos", "step", "pred_wakeup", F.when(F.col("pos") % 5 == 0, -1).otherwise(0).alias("label")))).alias("rows"))
    e = o.select("series_id", F.explode("rows").alias("r")).where("r.label <> -1")
    return r6(e.groupBy("series_id", "r.step").agg(F.avg("r.pred_wakeup").alias("p")), "p")


@query("d5_nights", "SELECT series_id, CAST(day AS VARCHAR) AS night, min(step) FILTER (event = 'onset') AS onset, min(step) FILTER (event = 'wakeup') AS wakeup FROM ev GROUP BY series_id, day HAVING count(DISTINCT event) = 2")
def _(s):
    return truth(s).groupBy("series_id", F.col("day").cast("string").alias("night")).pivot("event", ["onset", "wakeup"]).agg(F.min("step")).na.drop()


@query("d6_event_counts", "SELECT series_id, event, count(*) AS n FROM ev GROUP BY ALL")
def _(s):
    return truth(s).groupBy("series_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query("d7_daily_rule", "SELECT series_id, step, round(CASE WHEN greatest(sum(pred_wakeup) OVER (PARTITION BY series_id, day), 1) > 3 THEN pred_wakeup ELSE 0.8 * pred_wakeup END, 6) AS score FROM s")
def _(s):
    return s.select("series_id", "step", F.round(calibrate.daily_rule("pred_wakeup", "series_id", "day"), 6).alias("score"))


@query("d8_distinct", "SELECT count(DISTINCT series_id) AS n_series, count(DISTINCT event_type) AS n_types FROM s")
def _(s):
    return s.agg(F.countDistinct("series_id").alias("n_series"), F.countDistinct("event_type").alias("n_types"))


@query("d9_row_ids_per_group", "SELECT series_id, string_agg(step, ',' ORDER BY step) AS steps FROM s WHERE event_type = 'click' GROUP BY series_id")
def _(s):
    return s.where("event_type = 'click'").groupBy("series_id").agg(F.array_join(F.sort_array(F.collect_list("step")), ",").alias("steps"))


@query("d10_standardize", "SELECT series_id, step, round((value - (SELECT avg(value) FROM s WHERE series_id % 5 <> 0)) / (SELECT stddev_pop(value) FROM s WHERE series_id % 5 <> 0), 6) AS value FROM s")
def _(s):
    return r6(splits.standardize(s.select("series_id", "step", "value"), ["value"], F.col("series_id") % 5 == 0), "value")


@query("d11_chunks_with_events", "SELECT series_id, step FROM s WHERE (series_id, step // 16) IN (SELECT (series_id, step // 16) FROM s GROUP BY series_id, step // 16 HAVING max(CAST(event_type = 'signup' AS INTEGER)) = 1 AND avg(CAST(k < 50 AS INTEGER)) <= 0.5)")
def _(s):
    c = s.withColumns(chunks.fixed(16))
    ok = c.groupBy("series_id", "chunk_no").agg(F.max((F.col("event_type") == "signup").cast("int")).alias("any"), F.avg((F.col("k") < 50).cast("int")).alias("share")).where("any = 1 AND share <= 0.5")
    return c.join(ok, ["series_id", "chunk_no"], "left_semi").select("series_id", "step")


@query("d12_block_mean", "SELECT series_id, step // 4 AS block, round(avg(value), 6) AS value FROM s GROUP BY ALL")
def _(s):
    return r6(s.groupBy("series_id", F.floor(F.col("step") / 4).alias("block")).agg(F.avg("value").alias("value")), "value")


@query("d13_candidate_recall", "SELECT round(count(*) FILTER (event_type = 'signup' AND value > 50)::DOUBLE / count(*) FILTER (event_type = 'signup'), 6) AS recall FROM s")
def _(s):
    own = F.col("event_type") == "signup"
    return s.agg(F.round(F.count(F.when(own & (F.col("value") > 50), 1)) / F.count(F.when(own, 1)), 6).alias("recall"))


@query("d14_scatter_max", "SELECT series_id, step // 16 AS chunk_no, CAST(floor(step % 16 + value / 100) AS BIGINT) AS pos, max(pred_wakeup) AS p FROM s GROUP BY ALL")
def _(s):
    c = s.withColumns(chunks.fixed(16)).withColumn("p", F.col("pred_wakeup"))
    return chunks.scatter_max(c.withColumnRenamed("pos", "idx"), ["series_id", "chunk_no"], F.col("idx") + F.col("value") / 100, "p")


@query("d15_prevalence", "SELECT event, count(*) AS n FROM ev GROUP BY event")
def _(s):
    return truth(s).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


# --- windows

@query("e1_series_zscore", "SELECT series_id, step, round((value - avg(value) OVER p) / stddev_samp(value) OVER p, 6) AS z FROM s WINDOW p AS (PARTITION BY series_id)")
def _(s):
    return s.select("series_id", "step", F.round(windows.zscore_series("value"), 6).alias("z"))


@query("e2_changes", f"SELECT series_id, step, round(coalesce(value - lag(value) {W}), 0), 6) AS diff, CAST(abs(coalesce(k - lag(k) {W}), 0)) < 10 AS INTEGER) AS small FROM s")
def _(s):
    return s.select("series_id", "step", F.round(windows.change("value"), 6).alias("diff"), (F.abs(windows.change("k")) < 10).cast("int").alias("small"))


@query("e3_rolling_min_periods", f"SELECT series_id, step, round(avg(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5, round(stddev_samp(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS std5, max(value) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS max3 FROM s")
def _(s):
    r = lambda stat, w: windows.rolling(F.col("value"), stat, windows.centered(w))
    return s.select("series_id", "step", F.round(r("mean", 5), 6).alias("mean5"), F.round(r("std", 5), 6).alias("std5"), r("max", 3).alias("max3"))


@query("e3_rolling_prefix_sums", f"SELECT series_id, step, round(avg(value) {W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 6) AS mean20 FROM s")
def _(s):
    return r6(windows.rolling_mean_by_prefix(s.select("series_id", "step", "value"), "value", 20, "mean20"), "mean20").select("series_id", "step", "mean20")


@query("e4_rolling_full", f"SELECT series_id, step, round(coalesce(CASE WHEN count(*) {W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) = 6 THEN avg(value) {W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) END, 0), 6) AS mean6 FROM s")
def _(s):
    return s.select("series_id", "step", F.round(F.coalesce(windows.rolling(F.col("value"), "mean", windows.centered(6), 6), F.lit(0.0)), 6).alias("mean6"))


@query("e5_rolling_median", f"SELECT series_id, step, round(median(value) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median5 FROM s")
def _(s):
    return s.select("series_id", "step", F.round(windows.rolling(F.col("value"), "median", windows.centered(5)), 6).alias("median5"))


WIDE = "OVER (PARTITION BY series_id ORDER BY step ROWS BETWEEN 360 PRECEDING AND 359 FOLLOWING)"
NULLS = "x AS (SELECT series_id, step, CASE WHEN k >= 20 THEN value END AS x FROM ls)"


@query("e5_rolling_median_720", f"+{NULLS} SELECT series_id, step, round(median(x) {WIDE}, 6) AS median720, round(coalesce(CASE WHEN count(x) OVER (PARTITION BY series_id ORDER BY step ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) >= 50 THEN median(x) OVER (PARTITION BY series_id ORDER BY step ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) END, 0), 6) AS median60 FROM x", long_series)
def _(s):
    x = s.select("series_id", "step", F.when(F.col("k") >= 20, F.col("value")).alias("x"))
    out = rolling.rolling_table(x, [Rolling("median720", "x", "median", 720), Rolling("median60", "x", "median", 60, 50, 0.0)], rows=1000)
    return r6(out.drop("x"), "median720", "median60")


@query("e3_rolling_std_max_720", f"+x AS (SELECT series_id, step, CASE WHEN k >= 20 THEN ln(1 + value) END AS x FROM ls) SELECT series_id, step, round(avg(x) {WIDE}, 6) AS mean, round(stddev_samp(x) {WIDE}, 6) AS std, round(max(x) {WIDE}, 6) AS \"max\", round(min(x) {WIDE}, 6) AS \"min\", round(sum(x) {WIDE}, 6) AS \"sum\" FROM x", long_series)
def _(s):
    x = s.select("series_id", "step", F.when(F.col("k") >= 20, F.log1p("value")).alias("x"))
    stats = ("mean", "std", "max", "min", "sum")
    return r6(rolling.rolling_table(x, [Rolling(n, "x", n, 720) for n in stats], rows=1000).drop("x"), *stats)


@query("e4_rolling_full_720", f"+{NULLS} SELECT series_id, step, round(coalesce(CASE WHEN count(value) {WIDE} = 720 THEN avg(value) {WIDE} END, 0), 6) AS mean, round(coalesce(CASE WHEN count(value) {WIDE} = 720 THEN stddev_samp(value) {WIDE} END, 0), 6) AS std, coalesce(CASE WHEN count(value) {WIDE} = 720 THEN max(value) {WIDE} END, 0) AS \"max\" FROM ls", long_series)
def _(s):
    out = rolling.rolling_table(s.select("series_id", "step", "value"), [Rolling(n, "value", n, 720, None, 0.0) for n in ("mean", "std", "max")], rows=1000)
    return r6(out.drop("value"), "mean", "std")


@query("e_halo_frames", f"+a AS (SELECT series_id, step, sum(greatest(enmo - 0.02, 0)) {W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS ac, value - lag(value) {W}) AS diff, max(value) {W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS top FROM ls) SELECT series_id, step, round(ac, 6) AS ac, round(diff, 6) AS diff, top FROM a", long_series)
def _(s):
    frames = lambda keys, order: {"ac": windows.activity("enmo", 25, keys, order), "diff": F.col("value") - F.lag("value").over(windows.ordered(keys, order)), "top": F.max("value").over(windows.trailing(25, keys, order))}
    return r6(blocks.bounded(s, 24, 12, frames, rows=500).select("series_id", "step", "ac", "diff", "top"), "ac", "diff")


@query("e_block_numbers", "SELECT series_id, event_id, step, round(sum(value) OVER (PARTITION BY series_id ORDER BY step ROWS UNBOUNDED PRECEDING), 4) AS upto FROM ls", long_series)
def _(s):
    return r6(blocks.scan(s.select("series_id", "event_id", "step", "value"), ["series_id"], "step", {"upto": F.col("value")}).drop("value"), "upto", digits=4)


@query("e6_activity", f"+a AS (SELECT series_id, step, sum(greatest(enmo - 0.02, 0)) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ac FROM s) SELECT series_id, step, round(ac, 6) AS ac, round(avg(1 / (ac + 1)) {W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS lids FROM a")
def _(s):
    s = windows.lids(s.withColumn("ac", windows.activity("enmo", 5)), "enmo", 5, 6, "lids")
    return r6(s.select("series_id", "step", "ac", "lids"), "ac", "lids")


CW = "OVER (PARTITION BY series_id, chunk_id ORDER BY step"


@query("e7_trailing_activity", f"+a AS (SELECT *, step // 16 AS chunk_id FROM s), b AS (SELECT *, CASE WHEN count(*) {CW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN sum(greatest(enmo - 0.02, 0)) {CW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS ac FROM a) SELECT series_id, step, round(100 / (first_value(ac IGNORE NULLS) {CW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1), 6) AS lids FROM b")
def _(s):
    c = s.withColumn("chunk_id", F.floor(F.col("step") / 16))
    return r6(windows.trailing_activity(c, "enmo", 4, "lids").select("series_id", "step", "lids"), "lids")


@query("e8_mean_minus_current", f"SELECT series_id, step, round(CASE WHEN step >= 3 THEN avg(value) {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) - value END, 6) AS prev, round(CASE WHEN count(*) {W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 THEN avg(value) {W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - value END, 6) AS lead FROM s")
def _(s):
    return s.select("series_id", "step", F.round(windows.mean_minus_current("value", 4), 6).alias("prev"), F.round(windows.mean_minus_current("value", 4, "leading"), 6).alias("lead"))


@query("e9_time_of_day_profile", "SELECT series_id, step, round(avg(value) OVER (PARTITION BY series_id, step % 8), 6) AS profile FROM s")
def _(s):
    return s.select("series_id", "step", F.round(windows.time_of_day_profile("value", 8), 6).alias("profile"))


@query("e10_row_index", "SELECT series_id, step, row_number() OVER (PARTITION BY series_id ORDER BY step) - 1 AS row_index FROM s WHERE k >= 30")
def _(s):
    return s.where("k >= 30").select("series_id", "step", windows.row_index().alias("row_index"))


@query("e11_gap_sessions", "+g AS (SELECT series_id, step, lag(step) OVER w AS l FROM s WHERE k >= 30 WINDOW w AS (PARTITION BY series_id ORDER BY step)) SELECT series_id, step, CAST(sum(CASE WHEN step - l <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk_id FROM g")
def _(s):
    return windows.sessions(s.where("k >= 30").select("series_id", "step"), 1)


@query("e12_transitions", f"+t AS (SELECT series_id, step, pred_onset, CAST(k >= 50 AS INTEGER) AS label, lag(CAST(k >= 50 AS INTEGER)) {W}) AS l FROM s) SELECT series_id, step, CASE WHEN label = 1 THEN 'onset' ELSE 'wakeup' END AS event, round(CASE WHEN label = 1 THEN pred_onset ELSE 1 - pred_onset END, 6) AS score FROM t WHERE l <> label")
def _(s):
    t = windows.transitions(s.withColumn("label", (F.col("k") >= 50).cast("int")), "label", "pred_onset")
    return r6(t.select("series_id", "step", "event", "score"), "score")


@query("e13_sleep_state", f"SELECT series_id, step, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state FROM s")
def _(s):
    e = s.join(truth(s).select("series_id", "step", "event"), ["series_id", "step"], "left")
    return e.select("series_id", "step", windows.sleep_state("event").alias("state"))


@query("e14_ramp_target", "+d AS (SELECT a.series_id, a.step, (SELECT min(abs(e.step - a.step)) FROM ev AS e WHERE e.series_id = a.series_id AND e.event = 'onset') AS d FROM s AS a) SELECT series_id, step, round(CASE WHEN d <= 0 THEN 1 WHEN d <= 2 THEN 0.75 WHEN d <= 4 THEN 0.5 WHEN d <= 8 THEN 0.25 ELSE 0 END::DOUBLE, 6) AS target FROM d")
def _(s):
    return windows.ramp_target(s, F.col("event_type") == "signup", [1, 3, 5, 9], "target").select("series_id", "step", "target")


@query("e15_daily_norm", "SELECT series_id, step, round(pred_onset / (sum(pred_onset) OVER (PARTITION BY series_id, event_type, day) + 1), 6) AS score FROM s")
def _(s):
    return s.select("series_id", "step", F.round(calibrate.by_offset("pred_onset", 1.0, "series_id", "event_type", "day"), 6).alias("score"))


@query("e16_soft_daily_norm", "SELECT series_id, step, round(pred_onset / (sum(pred_onset) OVER w + 1 / (10 + sum(pred_onset) OVER w)), 6) AS score FROM s WINDOW w AS (PARTITION BY series_id, day)")
def _(s):
    return s.select("series_id", "step", F.round(calibrate.by_soft_offset("pred_onset", 10.0, "series_id", "day"), 6).alias("score"))


@query("e17_late_discount", "SELECT series_id, step, round(1 - 0.05 * date_diff('day', min(day) OVER w, day) / (date_diff('day', min(day) OVER w, max(day) OVER w) + 1), 6) AS factor FROM s WINDOW w AS (PARTITION BY series_id)")
def _(s):
    return s.select("series_id", "step", F.round(calibrate.late_discount("day", 0.05), 6).alias("factor"))


def _expect(x: str, counts: tuple[int, ...]) -> str:
    return " + ".join([f"sum({x}) {W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in counts] + [f"coalesce(sum({x}) {W} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), 0)" for k in counts])


@query("e18_expectation", f"SELECT series_id, step, round({_expect('pred_onset', (1, 3, 5, 8))}, 6) AS gain FROM s")
def _(s):
    return s.select("series_id", "step", F.round(windows.expectation("pred_onset", (1, 3, 5, 8)), 6).alias("gain"))


def _phase(x: str, left: tuple[int, ...], right: tuple[int, ...]) -> str:
    w = "OVER (PARTITION BY series_id, step // 32 ORDER BY step"
    return " + ".join([f"sum({x}) {w} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in left] + [f"coalesce(sum({x}) {w} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), 0)" for k in right])


@query("e18_phases", f"SELECT series_id, step, round({_phase('pred_onset', windows.NEARER, windows.FARTHER)}, 6) AS gain3, round({_phase('pred_onset', windows.FARTHER, windows.NEARER)}, 6) AS gain9 FROM s")
def _(s):
    c = s.withColumn("chunk_id", F.floor(F.col("step") / 32))
    return r6(c.select("series_id", "step", *[x.alias(n) for n, x in windows.phase_expectations("pred_onset", ("series_id", "chunk_id")).items()]), "gain3", "gain9")


@query("e19_smoothed_periodicity", "+n AS (SELECT series_id, step, pred_wakeup AS p, count(*) OVER (PARTITION BY series_id) AS n FROM s), m AS (SELECT a.series_id, a.step, any_value(a.p) AS p, sum(b.p) / 6 AS m FROM n AS a, range(-3, 3) AS t(o), n AS b WHERE b.series_id = a.series_id AND b.step = CASE WHEN a.step + o < 0 THEN -1 - (a.step + o) WHEN a.step + o >= a.n THEN 2 * a.n - 1 - (a.step + o) ELSE a.step + o END GROUP BY a.series_id, a.step) SELECT series_id, step, round(least(p, m), 6) AS p FROM m")
def _(s):
    return r6(windows.smoothed_periodicity(s.select("series_id", "step", F.col("pred_wakeup").alias("x")), "x", "p", 6).select("series_id", "step", "p"), "p")


@query("e20_chunk_bounds", "SELECT series_id, step, min(step) OVER w AS low, max(step) OVER w AS high FROM s WINDOW w AS (PARTITION BY series_id, step // 16)")
def _(s):
    w = Window.partitionBy("series_id", F.floor(F.col("step") / 16))
    return s.select("series_id", "step", F.min("step").over(w).alias("low"), F.max("step").over(w).alias("high"))


PEAKS_SQL = f"""r AS (SELECT *, sum(CASE WHEN x IS DISTINCT FROM l THEN 1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT series_id, step, floor(k / 10) AS x, lag(floor(k / 10)) {W}) AS l FROM s)),
g AS (SELECT series_id, run, any_value(x) AS x, min(step) AS a, max(step) AS z FROM r GROUP BY series_id, run),
pk AS (SELECT series_id, (a + z) // 2 AS step, x FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS c FROM g WINDOW w AS (PARTITION BY series_id ORDER BY run)) WHERE b < x AND c < x AND x >= 3)"""


@query("e21_local_maxima", f"+{PEAKS_SQL} SELECT series_id, step, x FROM pk")
def _(s):
    p = s.select("series_id", "step", F.floor(F.col("k") / 10).cast("double").alias("x"))
    return windows.local_maxima(p, "x", 3.0)


# --- order and sets

@query("f1_best_per_day", "SELECT series_id, step, 'onset' AS event, pred_onset AS score FROM (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY pred_onset DESC, step) AS n FROM s) WHERE n = 1")
def _(s):
    return peaks.best_per_day(s, "pred_onset", "onset", "day")


@query("f3_head_rows", "SELECT series_id, step FROM s WHERE step < 10")
def _(s):
    n = F.row_number().over(windows.ordered())
    return s.withColumn("n", n).where("n <= 10").select("series_id", "step")


@query("f4_top_events", "SELECT series_id, step, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, step) AS n FROM s WHERE value >= 20) WHERE n <= 5")
def _(s):
    n = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("value"), "step"))
    return s.where("value >= 20").withColumn("n", n).where("n <= 5").select("series_id", "step", "value")


@query("f5_union_parts", "SELECT series_id, step, 1 AS label FROM s WHERE event_type = 'signup' UNION ALL SELECT series_id, step, 0 FROM s WHERE event_type = 'view'")
def _(s):
    return s.where("event_type = 'signup'").select("series_id", "step", F.lit(1).alias("label")).unionByName(s.where("event_type = 'view'").select("series_id", "step", F.lit(0).alias("label")))


@query("f6_distinct_rows", "SELECT DISTINCT series_id, CAST(day AS VARCHAR) AS day FROM s")
def _(s):
    return s.select("series_id", F.col("day").cast("string").alias("day")).distinct()


# --- chunks and labels

@query("g1_neighbourhood", "SELECT DISTINCT series_id, step + o AS step FROM s, range(-8, 8, 4) AS t(o) WHERE event_type = 'signup' AND step + o >= 0")
def _(s):
    return chunks.neighbourhood(s.where("event_type = 'signup'"), 8, 4)


@query("g2_padded_chunks", "+n AS (SELECT series_id, max(step) + 1 AS n FROM s GROUP BY series_id), g AS (SELECT series_id, i AS step, i // 16 AS chunk_no, i % 16 AS pos FROM n, range(0, 4096) AS t(i) WHERE i < (n // 16 + 1) * 16) SELECT g.series_id, g.step, chunk_no, pos, value FROM g LEFT JOIN s USING (series_id, step)")
def _(s):
    return chunks.padded(s.select("series_id", "step", "value"), 16)


@query("g3_overlapping_chunks", f"+{OVER_SQL} SELECT series_id, step, chunk_no, pos FROM o")
def _(s):
    return chunks.overlapping(s.select("series_id", "step"), 16, 8)


@query("g4_stride_windows", "+n AS (SELECT series_id, max(step) + 1 AS n FROM s GROUP BY series_id) SELECT series_id, c AS start, least(n, c + 16) AS \"end\" FROM (SELECT series_id, n, unnest(range(3, n, 8)) AS c FROM n)")
def _(s):
    return chunks.windows(s, 16, 8, offset=3).select("series_id", "start", "end")


@query("g5_right_aligned_windows", "+n AS (SELECT series_id, max(step) + 1 AS n FROM s GROUP BY series_id) SELECT DISTINCT series_id, greatest(0, least(c, n - 16)) AS start, least(n, greatest(0, least(c, n - 16)) + 16) AS \"end\" FROM (SELECT series_id, n, unnest(range(0, n, 8)) AS c FROM n)")
def _(s):
    return chunks.windows(s, 16, 8, "right").select("series_id", "start", "end")


@query("g6_short_tail_windows", "+n AS (SELECT series_id, max(step) + 1 AS n FROM s GROUP BY series_id) SELECT series_id, c AS start, least(n, c + 16) AS \"end\" FROM (SELECT series_id, n, unnest(range(0, n, 16)) AS c FROM n)")
def _(s):
    return chunks.windows(s, 16, 16).select("series_id", "start", "end")


@query("g6_filled_chunks", "+n AS (SELECT series_id, max(step) + 1 AS n FROM s GROUP BY series_id), c AS (SELECT series_id, n, unnest(CASE WHEN n > 50 THEN range(0, n, 40) ELSE [0] END) AS start FROM n), p AS (SELECT c.series_id, c.start, i, s.step, s.pred_onset FROM c, range(0, 50) AS t(i) LEFT JOIN s ON s.series_id = c.series_id AND s.step = c.start + i WHERE n > 50 OR i < n) SELECT series_id, start, string_agg(coalesce(step, -1), ',' ORDER BY i) AS steps, string_agg(CAST(round(coalesce(pred_onset, -1) * 1000) AS BIGINT), ',' ORDER BY i) AS p FROM p GROUP BY ALL")
def _(s):
    c = chunks.chunk_arrays(s, 50, 40, ["pred_onset"])
    whole = F.transform("pred_onset", lambda x: F.round(x * 1000).cast("long"))
    return c.select("series_id", "start", F.array_join("step", ",").alias("steps"), F.array_join(whole, ",").alias("p"))


FRAME = lambda e, start, duration, frames: f"CAST(trunc(({e} - {start})::DOUBLE / {duration} * {frames}) AS INTEGER)"
LABEL_SQL = f"""lab AS (SELECT DISTINCT series_id, start, 'onset' AS kind, {FRAME('onset', 'start', 16, 8)} AS frame FROM pr WHERE {FRAME('onset', 'start', 16, 8)} BETWEEN 0 AND 7
  UNION ALL SELECT DISTINCT series_id, start, 'wakeup', {FRAME('wakeup', 'start', 16, 8)} FROM pr WHERE {FRAME('wakeup', 'start', 16, 8)} BETWEEN 0 AND 7
  UNION ALL SELECT DISTINCT series_id, start, 'sleep', CAST(f AS INTEGER) FROM pr, range(0, 8) AS t(f) WHERE f >= greatest(0, {FRAME('onset', 'start', 16, 8)}) AND f < least(8, {FRAME('wakeup', 'start', 16, 8)})),
mask AS (SELECT DISTINCT series_id, start, kind, tolerance, CAST(f AS INTEGER) AS frame FROM lab, (VALUES (1), (2), (5)) AS o(tolerance), range(0, 8) AS t(f) WHERE kind <> 'sleep' AND f >= frame - tolerance AND f < frame + tolerance)"""
PAIR_SQL = 'pr AS (SELECT ch.series_id, start, onset, wakeup FROM ch JOIN sp ON ch.series_id = sp.series_id AND start <= wakeup AND onset <= "end")'


@query("g7_frame_labels", f"+{CHUNKS_SQL}, {SPANS_SQL}, {PAIR_SQL}, {LABEL_SQL} SELECT * FROM lab")
def _(s):
    return chunks.frame_labels(joins.overlaps(chunk_bounds(s), spans(s), "start", "end", "onset", "wakeup", 16), 16, 8)


@query("g7_tolerance_masks", f"+{CHUNKS_SQL}, {SPANS_SQL}, {PAIR_SQL}, {LABEL_SQL} SELECT * FROM mask")
def _(s):
    labels = chunks.frame_labels(joins.overlaps(chunk_bounds(s), spans(s), "start", "end", "onset", "wakeup", 16), 16, 8)
    return chunks.tolerance_masks(labels, 8, (1, 2, 5))


@query("g7_sleep_frames", f'+{CHUNKS_SQL}, {SPANS_SQL}, p AS (SELECT ch.series_id, start, greatest(0, CAST(trunc((onset - start)::DOUBLE / 16 * 8) AS INTEGER)) AS a, least(8, CAST(trunc((wakeup - start)::DOUBLE / 16 * 8) AS INTEGER)) AS b FROM ch JOIN sp ON ch.series_id = sp.series_id AND start <= wakeup AND onset <= "end") SELECT DISTINCT series_id, start, CAST(f AS INTEGER) AS frame FROM p, range(0, 8) AS t(f) WHERE f >= a AND f < b')
def _(s):
    return chunks.sleep_frames(joins.overlaps(chunk_bounds(s), spans(s), "start", "end", "onset", "wakeup", 16), 16, 8)


@query("g8_gaussian_labels", "SELECT series_id, step // 16 * 16 AS start, CAST(step % 16 + o AS INTEGER) AS frame, round(sum(exp(-(o * o)::DOUBLE / (2 * 2.25))), 6) AS value FROM ev, range(-4, 5) AS t(o) WHERE event = 'onset' AND step % 16 + o BETWEEN 0 AND 15 AND exp(-(o * o)::DOUBLE / (2 * 2.25)) >= 0.001 GROUP BY ALL")
def _(s):
    e = truth(s).where("event = 'onset'").select("series_id", (F.floor(F.col("step") / 16) * 16).alias("start"), (F.col("step") % 16).cast("int").alias("frame"))
    return r6(chunks.gaussian(e, 4, 1.5, 16), "value")


@query("g9_center_labels", f'+{CHUNKS_SQL}, {SPANS_SQL} SELECT ch.series_id, start, onset, CAST(trunc((onset - start)::DOUBLE / 16 * 6) AS INTEGER) AS position, round((onset - start)::DOUBLE / 16 * 6 - trunc((onset - start)::DOUBLE / 16 * 6), 6) AS "offset", round(least(6, greatest(0, (wakeup - onset)::DOUBLE / 16 * 6)), 6) AS size FROM ch JOIN sp ON ch.series_id = sp.series_id AND start <= wakeup AND onset <= "end"')
def _(s):
    p = joins.overlaps(chunk_bounds(s), spans(s), "start", "end", "onset", "wakeup", 16).withColumn("at", F.col("onset"))
    return r6(chunks.center_labels(p, 16, 6).select("series_id", "start", "onset", "position", "offset", "size"), "offset", "size")


@query("g10_interpolate", f"+x AS (SELECT series_id, step, CASE WHEN k >= 40 THEN value END AS v FROM s), y AS (SELECT *, last_value(v IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS x0, first_value(v IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1, last_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS t0, first_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM x) SELECT series_id, step, round(coalesce(v, x0 + (x1 - x0) * (step - t0) / nullif(t1 - t0, 0), x0, x1), 6) AS v FROM y")
def _(s):
    x = s.select("series_id", "step", F.when(F.col("k") >= 40, F.col("value")).alias("x"))
    return r6(chunks.interpolate(x, "x", "v").select("series_id", "step", "v"), "v")


@query("g12_flatten_chunks", "SELECT series_id, step, pred_onset AS value FROM s WHERE step >= 0")
def _(s):
    size, halo = 16, 4
    c = chunks.overlapping(s, size, size - 2 * halo, lead=halo).groupBy("series_id", "chunk_no").agg(F.collect_list(F.struct("pos", "pred_onset")).alias("rows"))
    arr = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(F.transform(F.filter("rows", lambda r: r["pos"] == i), lambda r: r["pred_onset"]), F.lit(0)))
    n = s.groupBy("series_id").agg((F.max("step") + 1).alias("n"))
    return chunks.flatten(c.select("series_id", "chunk_no", arr.alias("p")), "p", size, halo, n)


# --- grouped algorithms

def periodicity_sql(x: str) -> str:
    """Table expressions, the last of them `periodic`: chunks of 4 rows from offsets 0 and 2, in series of 8 rows or more."""
    return f"""z0 AS (SELECT series_id, step, round(({x} - avg({x}) OVER p) / stddev_pop({x}) OVER p, 7) AS z, count(*) OVER p AS n FROM s WINDOW p AS (PARTITION BY series_id)),
c0 AS (SELECT series_id, o, (step - o) // 4 AS chunk, list(z ORDER BY step) AS vals FROM z0, range(0, 4, 2) AS t(o) WHERE n >= 8 AND step >= o AND n - o >= 8 GROUP BY ALL),
f0 AS (SELECT series_id, o, chunk, CASE WHEN count(*) OVER (PARTITION BY series_id, o, list_concat(vals, list_transform(range(len(vals), 4), lambda x: 0.0::DOUBLE))) > 1 THEN 1.0 ELSE 0.0 END AS flag FROM c0),
g0 AS (SELECT series_id, o, chunk, flag, lag(flag) OVER w AS l, lead(chunk) OVER w AS nx FROM f0 WINDOW w AS (PARTITION BY series_id, o ORDER BY chunk)),
e0 AS (SELECT series_id, o, chunk, CASE WHEN nx IS NULL THEN coalesce(l, 0) ELSE flag END AS flag FROM g0),
periodic AS (SELECT z0.series_id, z0.step, coalesce(max(e0.flag), 0.0)::DOUBLE AS periodicity FROM z0 LEFT JOIN e0 ON z0.series_id = e0.series_id AND z0.step >= e0.o AND (z0.step - e0.o) // 4 = e0.chunk GROUP BY ALL)"""


@query("h1_periodicity", f"+{periodicity_sql('floor(k / 50)')} SELECT series_id, step, periodicity FROM periodic")
def _(s):
    return periodicity.detect(s.select("series_id", "step", F.floor(F.col("k") / 50).cast("double").alias("x")), "x", day=8, split=4, stride=2, downsample=1)


QUERIES["h1b_similar_chunks"] = lambda spark, d: periodicity.similar_chunks(spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 50).alias("series_id"), F.col("vec_id").alias("chunk"), F.transform("embedding", lambda x: x.cast("double")).alias("v")), "v", 0.4)
ORACLES["h1b_similar_chunks"] = "WITH v AS (SELECT vec_id % 50 AS series_id, vec_id AS chunk, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT a.series_id, a.chunk, max(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) AS c FROM v AS a JOIN v AS b ON a.series_id = b.series_id AND a.chunk <> b.chunk GROUP BY ALL) SELECT v.series_id, v.chunk, CAST(coalesce(c.c, 0) > 0.4 AS INTEGER) AS periodic FROM v LEFT JOIN c USING (series_id, chunk)"


def maxima_sql(x: str, name: str, source: str = "s") -> str:
    """Table expressions, the last of them `name`: series_id, row (from 1), step, x of local maxima, plateaus at their middle."""
    w = "OVER (PARTITION BY series_id ORDER BY step"
    return f"""{name}_r AS (SELECT *, sum(CASE WHEN x IS DISTINCT FROM l THEN 1 ELSE 0 END) {w} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT series_id, step, row_number() {w}) AS row, {x} AS x, lag({x}) {w}) AS l FROM {source})),
{name}_g AS (SELECT series_id, run, any_value(x) AS x, min(row) AS a, max(row) AS z FROM {name}_r GROUP BY series_id, run),
{name}_m AS (SELECT series_id, (a + z) // 2 AS row, x FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS c FROM {name}_g WINDOW w AS (PARTITION BY series_id ORDER BY run)) WHERE b < x AND c < x),
{name} AS (SELECT m.series_id, m.row, r.step, m.x FROM {name}_m AS m JOIN {name}_r AS r ON r.series_id = m.series_id AND r.row = m.row)"""


def thinned_sql(source: str, name: str, keys: str) -> str:
    """Table expressions, the last of them `name`: the rows of `source` (keys, row, step, x, distance) that stay, highest first, the later of
    equals; one is taken a round and key, and remembers the rows that stay."""
    key, own = keys.split(", "), ", ".join(f"o.{k}" for k in keys.split(", "))
    same = " AND ".join(f"o.{k} IS NOT DISTINCT FROM t.{k}" for k in key)
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x DESC, row DESC) AS i FROM {source}),
{name}_t AS (SELECT {keys}, step, x, i, true AS stays, [row] AS rows FROM {name}_o WHERE i = 1 UNION ALL
  SELECT {own}, o.step, o.x, o.i, len(list_filter(t.rows, lambda y: abs(y - o.row) < o.distance)) = 0,
    CASE WHEN len(list_filter(t.rows, lambda y: abs(y - o.row) < o.distance)) = 0 THEN list_append(t.rows, o.row) ELSE t.rows END
  FROM {name}_t AS t JOIN {name}_o AS o ON {same} AND o.i = t.i + 1),
{name} AS (SELECT * FROM {name}_t WHERE stays)"""


def matched_sql(detections: str, keys: str = "") -> str:
    """Table expressions, the last of them `matched`: for each tolerance, by score and step, each row of `detections` (keys, series_id, event, step,
    score) takes the nearest free truth, the earlier of equals, nearer than the tolerance; one is worked a round."""
    more = "".join(f"{k}, " for k in keys.split(", ") if k)
    own, same = "".join(f"d.{k}, " for k in keys.split(", ") if k), "".join(f" AND d.{k} = m.{k}" for k in keys.split(", ") if k)
    grid = ", ".join(f"('{e}', {float(t)}::DOUBLE)" for e, ts in TOLERANCES.items() for t in ts)
    best = "list_min(list_transform(list_filter(m.free, lambda y: abs(y - d.step) < m.tolerance), lambda y: {'e': abs(y - d.step), 't': y}))"
    place = f"list_position(m.free, ({best}).t)"
    return f"""grid AS (SELECT * FROM (VALUES {grid}) AS v(event, tolerance)),
times AS (SELECT series_id, event, list(step ORDER BY step) AS times FROM ev GROUP BY ALL),
dets AS (SELECT *, row_number() OVER (PARTITION BY {more}series_id, event ORDER BY score DESC, step) AS i FROM {detections} WHERE score IS NOT NULL AND series_id IN (SELECT series_id FROM ev)),
m0 AS (SELECT DISTINCT {own}d.series_id, d.event, tolerance, coalesce(times, []) AS free FROM dets AS d JOIN grid USING (event) LEFT JOIN times USING (series_id, event)),
m1 AS (SELECT {more}series_id, event, tolerance, free, 0::BIGINT AS i, NULL::DOUBLE AS score, 0 AS matched FROM m0 UNION ALL
  SELECT {own}d.series_id, d.event, m.tolerance, CASE WHEN {best} IS NULL THEN m.free ELSE list_concat(m.free[1:{place} - 1], m.free[{place} + 1:]) END, d.i, d.score, CAST({best} IS NOT NULL AS INTEGER)
  FROM m1 AS m JOIN dets AS d ON d.series_id = m.series_id AND d.event = m.event AND d.i = m.i + 1{same}),
matched AS (SELECT {more}event, tolerance, series_id, score, matched FROM m1 WHERE i > 0)"""


def ap_sql(keys: str = "") -> str:
    """Table expressions after `matched`, the last of them `ap`: keys, event, tolerance, ap of every tolerance that has a detection."""
    more = "".join(f"{k}, " for k in keys.split(", ") if k)
    return f"""tot AS (SELECT event, count(*) AS n FROM ev GROUP BY event),
sc AS (SELECT {more}event, tolerance, score, sum(matched) AS tp, count(*) AS k FROM matched GROUP BY ALL),
cu AS (SELECT *, sum(tp) OVER w AS tps, sum(k) OVER w AS ks FROM sc WINDOW w AS (PARTITION BY {more}event, tolerance ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT {more}event, tolerance, sum(tp / n * tps / ks) AS ap FROM cu JOIN tot USING (event) GROUP BY ALL)"""


DETECTIONS_SQL = "det AS (SELECT series_id, step, CASE event_type WHEN 'click' THEN 'onset' ELSE 'wakeup' END AS event, round(value, 1) AS score FROM s WHERE event_type IN ('click', 'view'))"
GRID = [(h, d) for h in (0.2, 0.35, 0.5, 0.8) for d in (1, 2, 4, 6, 9)]


@query("h2_find_peaks", f"+{maxima_sql('pred_wakeup', 'mx')}, hi AS (SELECT *, 4 AS distance FROM mx WHERE x >= 0.3), {thinned_sql('hi', 'th', 'series_id')} SELECT series_id, step, x AS score FROM th")
def _(s):
    return peaks.find_peaks(s, "pred_wakeup", 0.3, 4)


@query("h3_greedy_events")
def _(s):
    c = s.withColumn("chunk_id", F.floor(F.col("step") / 32))
    return r6(peaks.greedy_events(c, {"onset": "pred_onset", "wakeup": "pred_wakeup"}, 0.05, 20), "score")


@query("h3b_greedy_events_unchunked")
def _(s):
    c = s.where("step % 2 = 0").withColumn("chunk_id", F.lit(0))
    return r6(peaks.greedy_events(c, {"onset": "pred_onset"}, 0.05, 20), "score")


@query("h4_match", f"+{DETECTIONS_SQL}, {matched_sql('det')} SELECT * FROM matched")
def _(s):
    return metric.matches(truth(s), detections(s), TOLERANCES)


POINTS_SQL = "m AS (SELECT 'onset' AS event, CAST(series_id % 2 AS DOUBLE) AS tolerance, round(value, 0) AS score, CAST(k >= 50 AS INTEGER) AS matched FROM s), t AS (SELECT event, tolerance, score, sum(matched) AS tp, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT event, tolerance, score, sum(tp) OVER w / sum(n) OVER w AS prec, sum(tp) OVER w / (SELECT count(*) FROM s) AS rec FROM t WINDOW w AS (PARTITION BY event, tolerance ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


def _points(s: DataFrame) -> DataFrame:
    m = s.select(F.lit("onset").alias("event"), (F.col("series_id") % 2).cast("double").alias("tolerance"), F.round("value", 0).alias("score"), (F.col("k") >= 50).cast("int").alias("matched"))
    return metric.pr_points(m, s.agg(F.count(F.lit(1)).alias("n")).withColumn("event", F.lit("onset")))


@query("h5_average_precision", f"+{POINTS_SQL} SELECT event, tolerance, round(sum(d * prec), 6) AS ap FROM (SELECT *, rec - coalesce(lag(rec) OVER (PARTITION BY event, tolerance ORDER BY score DESC), 0) AS d FROM p) GROUP BY ALL")
def _(s):
    return r6(metric.average_precision(_points(s)), "ap")


@query("h6_pr_curve", f"+{POINTS_SQL} SELECT event, tolerance, CAST(row_number() OVER (PARTITION BY event, tolerance ORDER BY score DESC) - 1 AS INTEGER) AS i, round(prec, 6) AS precision, round(rec, 6) AS recall FROM p")
def _(s):
    t = metric.pr_table(_points(s), 100).select("event", "tolerance", "first", F.posexplode(F.arrays_zip("precision", "recall")).alias("at", "p"))
    return r6(t.select("event", "tolerance", (F.col("first") + F.col("at")).cast("int").alias("i"), "p.precision", "p.recall"), "precision", "recall")


@query("h5_matched_ap", f"+{DETECTIONS_SQL}, {matched_sql('det')}, {ap_sql()} SELECT event, tolerance, round(ap, 6) AS ap FROM ap")
def _(s):
    """Average precision of the detections that the matcher matched."""
    totals = truth(s).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    return r6(metric.average_precision(metric.pr_points(metric.matches(truth(s), detections(s), TOLERANCES), totals)), "ap")


@query("h7_mean_ap", f"+{DETECTIONS_SQL}, {matched_sql('det')}, {ap_sql()} SELECT round(avg(ap), 6) AS mean_ap FROM (SELECT event, avg(coalesce(ap, 0)) AS ap FROM grid LEFT JOIN ap USING (event, tolerance) WHERE event IN (SELECT event FROM ev) GROUP BY event)")
def _(s):
    return r6(metric.mean_ap(metric.ap_table(truth(s), detections(s), TOLERANCES)), "mean_ap")


POINTS = ", ".join(f"({i}, {h}::DOUBLE, {d}::DOUBLE)" for i, (h, d) in enumerate(GRID))


@query("h8_sweep", f"""+{maxima_sql('pred_onset', 'mo')}, {maxima_sql('pred_wakeup', 'mw')}, pts AS (SELECT * FROM (VALUES {POINTS}) AS v(point, height, distance)),
hi AS (SELECT point, 'onset' AS event, mo.*, distance FROM mo, pts WHERE x >= height UNION ALL SELECT point, 'wakeup', mw.*, distance FROM mw, pts WHERE x >= height),
{thinned_sql('hi', 'th', 'point, event, series_id')}, det AS (SELECT point, series_id, event, step, x AS score FROM th), {matched_sql('det', 'point')}, {ap_sql('point')}
SELECT height, distance, round(avg(ap), 6) AS mean_ap FROM (SELECT point, height, distance, event, avg(coalesce(ap, 0)) AS ap FROM pts CROSS JOIN grid LEFT JOIN ap USING (point, event, tolerance) WHERE event IN (SELECT event FROM ev) GROUP BY ALL) GROUP BY height, distance""")
def _(s):
    return r6(metric.sweep(s, {"onset": "pred_onset", "wakeup": "pred_wakeup"}, truth(s), TOLERANCES, GRID), "mean_ap")


@query("h9_dummy_rows", "+d AS (SELECT series_id, 'onset' AS event, step, value AS score FROM s WHERE event_type = 'click' AND value > 400) SELECT series_id, event, step, score FROM d UNION ALL SELECT DISTINCT series_id, 'onset', 0, 0.0 FROM s WHERE series_id NOT IN (SELECT series_id FROM d)")
def _(s):
    d = s.where("event_type = 'click' AND value > 400").select("series_id", F.lit("onset").alias("event"), "step", F.col("value").alias("score"))
    return peaks.or_dummy(d, s.select("series_id", F.lit("onset").alias("event")).distinct())


# --- folds and samples

def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("series_id"))
    return c.join(o.withColumnRenamed("o_custkey", "series_id"), "series_id", "left").fillna(0, ["n"])


CLASS_SQL = "c AS (SELECT c_custkey AS series_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey), q AS (SELECT unnest(quantile_cont(n, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM c WHERE n > 0), k AS (SELECT series_id, n, CASE WHEN n > 0 THEN 1 + (SELECT count(*) FROM q WHERE c.n > e) ELSE 0 END AS class FROM c)"
QUERIES["i1_quantile_classes"] = lambda spark, d: splits.quantile_classes(_orders(spark, d)).select("series_id", "n", F.col("class").cast("long").alias("class"))
ORACLES["i1_quantile_classes"] = f"WITH {CLASS_SQL} SELECT series_id, n, CAST(class AS BIGINT) AS class FROM k"
QUERIES["i2_stratified_folds"] = lambda spark, d: splits.stratified_folds(splits.quantile_classes(_orders(spark, d)), 5).select("series_id", "fold")
ORACLES["i2_stratified_folds"] = f"WITH {CLASS_SQL}, g AS (SELECT class, min(series_id) AS f FROM k GROUP BY class), r AS (SELECT k.class, row_number() OVER (ORDER BY g.f, series_id) - 1 AS p FROM k JOIN g USING (class)), a AS (SELECT class, p % 5 AS fold, count(*) AS n FROM r GROUP BY ALL), u AS (SELECT class, fold, sum(n) OVER (PARTITION BY class ORDER BY fold) AS upto FROM a), w AS (SELECT class, series_id, row_number() OVER (PARTITION BY class ORDER BY series_id) - 1 AS i FROM k) SELECT series_id, CAST((SELECT min(fold) FROM u WHERE u.class = w.class AND u.upto > w.i) AS INTEGER) AS fold FROM w"


@query("i3_fold_table", "SELECT DISTINCT series_id, CASE WHEN series_id % 3 = 0 THEN 0 ELSE series_id % 5 END AS fold FROM s")
def _(s):
    ids = s.select("series_id").distinct()
    listed = ids.where("series_id % 3 <> 0").select("series_id", (F.col("series_id") % 5).alias("fold"))
    return ids.join(listed, "series_id", "left").fillna(0, ["fold"])


@query("i4_out_of_fold", "SELECT series_id, step, round(value - m, 6) AS p FROM s JOIN (SELECT f, avg(value) AS m FROM s, range(0, 5) AS t(f) WHERE series_id % 5 <> f GROUP BY f) AS o ON series_id % 5 = f")
def _(s):
    fold = (F.col("series_id") % 5).alias("fold")
    own = s.groupBy(fold).agg(F.sum("value").alias("own"), F.count("value").alias("n"))
    whole = s.agg(F.sum("value").alias("all"), F.count("value").alias("all_n"))
    model = own.join(F.broadcast(whole)).select("fold", ((F.col("all") - F.col("own")) / (F.col("all_n") - F.col("n"))).alias("m"))  # what the others learn
    return s.join(model, F.col("series_id") % 5 == F.col("fold")).select("series_id", "step", F.round(F.col("value") - F.col("m"), 6).alias("p"))


@query("i5_negative_sample", "SELECT series_id, step, CAST(event_type = 'signup' AS INTEGER) AS label FROM s WHERE event_type = 'signup' OR ('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1")
def _(s):
    return splits.downsample_negatives(s.withColumn("label", (F.col("event_type") == "signup").cast("int")), "label", "event_id").select("series_id", "step", "label")


@query("i6_epoch_chunks", "SELECT series_id, step FROM s WHERE (step // 16) % 3 = 1")
def _(s):
    return s.withColumns(chunks.fixed(16)).where("chunk_no % 3 = 1").select("series_id", "step")


@query("i7_series_sample", "SELECT series_id FROM (SELECT DISTINCT series_id FROM s) ORDER BY ('0x' || substr(md5('0:' || series_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, series_id LIMIT 10")
def _(s):
    return splits.sample_series(s, 10)


CROP_SQL = f"""n AS (SELECT series_id, max(step) + 1 AS n FROM s GROUP BY series_id),
free AS (SELECT series_id, step, event_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, step) AS i FROM s WHERE (series_id, step) NOT IN (SELECT (series_id, step) FROM ev)) WHERE i <= 3),
drawn AS (SELECT series_id, step, event_id, 'background' AS source FROM free UNION ALL SELECT series_id, step, event_id, 'event' FROM s WHERE event_type IN ('signup', 'purchase')),
crop AS (SELECT drawn.*, n, greatest(0, step - 15) AS a, greatest(0, least(step, n - 16)) AS z, ('0x' || substr(md5('9:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM drawn JOIN n USING (series_id)),
cr AS (SELECT series_id, step, source, CAST(least(a, z) + floor(u * (z - least(a, z) + 1)) AS BIGINT) AS start, n FROM crop)"""


def drawn_crops(s: DataFrame) -> DataFrame:
    """Crops of 16 steps around three background positions of each series and around all its events."""
    free = s.join(truth(s).select("series_id", "step"), ["series_id", "step"], "left_anti").select("series_id", "step", "event_id")
    n = F.row_number().over(Window.partitionBy("series_id").orderBy(splits.seeded(F.col("event_id"), 7), "step"))
    drawn = free.withColumn("_n", n).where("_n <= 3").drop("_n").withColumn("source", F.lit("background"))
    drawn = drawn.unionByName(s.where("event_type IN ('signup', 'purchase')").select("series_id", "step", "event_id", F.lit("event").alias("source")))
    lengths = s.groupBy("series_id").agg((F.max("step") + 1).alias("n"))
    return chunks.random_crop(drawn, 16, lengths, splits.seeded(F.col("event_id"), 9)).drop("event_id")


@query("g11_random_crops", f'+{CROP_SQL} SELECT series_id, step, source, start, least(n, start + 16) AS "end" FROM cr')
def _(s):
    return drawn_crops(s)


@query("g11_crop_labels", f"+{CROP_SQL}, {SPANS_SQL}, pr AS (SELECT DISTINCT cr.series_id, start, onset, wakeup FROM cr JOIN sp ON cr.series_id = sp.series_id AND start <= wakeup AND onset <= least(n, start + 16)), {LABEL_SQL} SELECT *, -1 AS tolerance FROM lab UNION ALL SELECT series_id, start, kind, frame, tolerance FROM mask")
def _(s):
    """Labels of all three kinds and their masks, on the frames of drawn crops: each crop meets the spans that overlap it."""
    crops = drawn_crops(s).select("series_id", "start", "end").distinct()
    labels = chunks.frame_labels(joins.overlaps(crops, spans(s), "start", "end", "onset", "wakeup", 16), 16, 8)
    masks = chunks.tolerance_masks(labels, 8, (1, 2, 5))
    return labels.withColumn("tolerance", F.lit(-1)).unionByName(masks)


@query("g11_background_positions", "+f AS (SELECT series_id, step, row_number() OVER (PARTITION BY series_id ORDER BY ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, step) AS n FROM s WHERE (series_id, step) NOT IN (SELECT (series_id, step) FROM ev)) SELECT series_id, step FROM f WHERE n <= 3")
def _(s):
    free = s.join(truth(s).select("series_id", "step"), ["series_id", "step"], "left_anti")
    n = F.row_number().over(Window.partitionBy("series_id").orderBy(splits.seeded(F.col("event_id"), 7), "step"))
    return free.withColumn("n", n).where("n <= 3").select("series_id", "step")
