"""The feature table of series: fixed and series-wide z-scores, calendar, changes, rolling statistics, activity, and time-of-day means."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drowse.functions import scalar

from . import blocks, windows
from .rolling import rolled


@dataclass(frozen=True)
class Sizes:
    """Frames in rows; the defaults are those of rows 5 seconds apart. `minutes` names the centred frames of signal and flags, `full` are frames
    that need all their rows, `active` the sum of activity and its smoothing, `median` the frame of the changes' median."""

    minutes: dict[int, int] = field(default_factory=lambda: {1: 12, 5: 60, 60: 720})
    full: tuple[int, ...] = (6, 12)
    active: tuple[int, int] = (120, 360)
    median: int = 60
    day: int = 17_280

    @property
    def reach(self) -> int:
        """Rows that any of the frames needs on either side, one for the change before its frame."""
        return max(*(w // 2 for w in (*self.minutes.values(), *self.full, self.median)), sum(self.active) // 2) + 1


def names(sizes: Sizes) -> list[str]:
    """Columns of `block_features`, in order."""
    out = ["anglez_diff", "enmo_diff", "anglez_abs_diff", "anglez_diff_nonzero"]
    for m in sizes.minutes:
        out += [f"anglez_abs_diff_{m}_{s}" for s in ("median", "std", "mean", "max")]
    for m in sizes.minutes:
        out += [f"anglez_diff_nonzero_{m}", f"anglez_diff_nonzero_{m}_max", f"anglez_diff_nonzero_{m}_std"]
    out += ["activity_count", "lids", "anglez_diff_5min_median"]
    for w in sizes.full:
        out += [f"{x}_{w}_rolling_{s}" for s, own in FULL.items() for x in own]
    return out


FULL = {"mean": ("enmo", "enmo_log"), "std": ("anglez", "enmo", "enmo_log"), "max": ("enmo", "enmo_log")}
#: Columns whose mean over all days at the same time of day is a feature.
DAILY = ("anglez_abs_diff", "anglez_diff_nonzero_5", "anglez_diff_nonzero_60", "lids")


def changes(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.nan)


def block_features(x: dict[str, np.ndarray], sizes: Sizes) -> dict[str, np.ndarray]:
    """All features that look at neighbouring rows, of one block with its halo, or of equally long ones, as rows. A missing value's change counts as 0."""
    zero = lambda v: np.where(np.isnan(v), 0.0, v)
    diff, raw = changes(x["anglez"]), zero(changes(x["anglez_raw"]))
    out = {"anglez_diff": zero(diff), "enmo_diff": zero(changes(x["enmo"])), "anglez_abs_diff": np.abs(zero(diff)), "anglez_diff_nonzero": (np.abs(raw) < 0.1).astype(float)}
    for m, w in sizes.minutes.items():
        for s in ("median", "std", "mean", "max"):
            out[f"anglez_abs_diff_{m}_{s}"] = rolled(x["anglez"], s, w)
        for s in ("mean", "max", "std"):
            out[f"anglez_diff_nonzero_{m}{'' if s == 'mean' else '_' + s}"] = rolled(out["anglez_diff_nonzero"], s, w)
    out["activity_count"] = rolled(rolled(np.maximum(x["enmo"] - 0.02, 0), "sum", sizes.active[0]), "mean", sizes.active[1])
    out["lids"] = 1 / (out["activity_count"] + 1)
    out["anglez_diff_5min_median"] = rolled(np.abs(diff), "median", sizes.median, None, 0.0)
    for w in sizes.full:
        out |= {f"{c}_{w}_rolling_{s}": rolled(x[c], s, w, None, 0.0) for s, own in FULL.items() for c in own}
    return out


def feature_table(s: DataFrame, sizes: Sizes | None = None, rows: int = blocks.ROWS) -> DataFrame:
    """series_id, step (the row's place in its series), ts, anglez and enmo with all features. Rows are shuffled by blocks of a series, and once
    more by time of day; series-wide means are one row a series, joined."""
    sizes = sizes or Sizes()
    own = s.groupBy("series_id").agg(*[f(c).alias(f"_{n}_{c}") for c in ("anglez", "enmo") for n, f in (("avg", F.avg), ("std", F.stddev_samp))])
    s = scalar.zscore_fixed(s)
    s = s.withColumns({"enmo_clip": F.least("enmo", F.lit(7.0)), "enmo_log": F.log1p("enmo")})
    s = blocks.map_blocks(s, sizes.reach, sizes.reach, lambda x: block_features(x, sizes), ["anglez", "anglez_raw", "enmo", "enmo_log"], names(sizes), rows=rows)
    s = s.withColumns({f"{c}_mean_24h": windows.time_of_day_profile(c, sizes.day) for c in DAILY if c in names(sizes)})
    s = s.join(own, "series_id")
    s = s.withColumns({f"{c}_series_norm": (F.col(f"{c}_raw") - F.col(f"_avg_{c}")) / F.col(f"_std_{c}") for c in ("anglez", "enmo")}).drop(*own.columns[1:])
    calendar = {"hour": (F.hour("ts"), 24), "month": (F.month("ts"), 12), "minute": (F.minute("ts"), 60), "minute15": (F.minute("ts") % 15, 15), "weekday": (F.weekday("ts") + 1, 7)}
    turns = [c for name, (x, period) in calendar.items() for c in scalar.cyclic(x, period, name)]
    return s.select("*", *turns, F.hour("ts").alias("hour"), (F.minute("ts") % 15).alias("minute_15"))


def feature_sql(view: str, sizes: Sizes) -> str:
    """The same table as common table expressions for DuckDB, the last of them `features`."""
    over = lambda w: f"OVER (PARTITION BY series_id ORDER BY step ROWS BETWEEN {w // 2} PRECEDING AND {(w + 1) // 2 - 1} FOLLOWING)"
    sql = {"median": "median", "std": "stddev_samp", "mean": "avg", "max": "max"}
    full = lambda s, x, w: f"coalesce(CASE WHEN count({x}) {over(w)} = {w} THEN {sql[s]}({x}) {over(w)} END, 0)"
    rolls = [f"{sql[s]}(anglez) {over(w)} AS anglez_abs_diff_{m}_{s}" for m, w in sizes.minutes.items() for s in sql]
    rolls += [f"{sql[s]}(anglez_diff_nonzero) {over(w)} AS anglez_diff_nonzero_{m}{'' if s == 'mean' else '_' + s}" for m, w in sizes.minutes.items() for s in ("mean", "max", "std")]
    rolls += [f"{full(s, x, w)} AS {x}_{w}_rolling_{s}" for w in sizes.full for s, own in FULL.items() for x in own]
    turn = lambda name, x, period: f"sin(2 * pi() * ({x}) / {period}) AS {name}_sin, cos(2 * pi() * ({x}) / {period}) AS {name}_cos"
    turns = [turn("hour", "hour(ts)", 24), turn("month", "month(ts) % 12", 12), turn("minute", "minute(ts)", 60), turn("minute15", "minute(ts) % 15", 15), turn("weekday", "isodow(ts) % 7", 7)]
    daily = [f"avg({c}) OVER (PARTITION BY series_id, step % {sizes.day}) AS {c}_mean_24h" for c in DAILY if c in names(sizes)]
    (am, asd), (em, esd) = scalar.MEAN_STD["anglez"], scalar.MEAN_STD["enmo"]
    o = "OVER (PARTITION BY series_id ORDER BY step)"
    return f"""z AS (SELECT series_id, step, ts, anglez AS anglez_raw, enmo AS enmo_raw, (anglez - ({am})) / {asd} AS anglez, (enmo - {em}) / {esd} AS enmo FROM {view}),
y AS (SELECT *, coalesce(anglez - lag(anglez) {o}, 0) AS anglez_diff, coalesce(enmo - lag(enmo) {o}, 0) AS enmo_diff, abs(coalesce(anglez - lag(anglez) {o}, 0)) AS anglez_abs_diff,
  CAST(abs(coalesce(anglez_raw - lag(anglez_raw) {o}, 0)) < 0.1 AS DOUBLE) AS anglez_diff_nonzero, abs(anglez - lag(anglez) {o}) AS moved, least(enmo, 7) AS enmo_clip, ln(1 + enmo) AS enmo_log,
  sum(greatest(enmo - 0.02, 0)) {over(sizes.active[0])} AS active FROM z),
x AS (SELECT *, {', '.join(rolls)}, avg(active) {over(sizes.active[1])} AS activity_count, {full("median", "moved", sizes.median)} AS anglez_diff_5min_median FROM y),
v AS (SELECT *, 1 / (activity_count + 1) AS lids FROM x),
features AS (SELECT *, {', '.join(daily)}, (anglez_raw - avg(anglez_raw) OVER p) / stddev_samp(anglez_raw) OVER p AS anglez_series_norm, (enmo_raw - avg(enmo_raw) OVER p) / stddev_samp(enmo_raw) OVER p AS enmo_series_norm,
  {', '.join(turns)}, CAST(hour(ts) AS INTEGER) AS "hour", CAST(minute(ts) % 15 AS INTEGER) AS minute_15 FROM v WINDOW p AS (PARTITION BY series_id))"""
