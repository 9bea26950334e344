"""Joins of series, events, predictions and intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import FIRST, LAST

KEYS = ["series_id", "step"]


def complete_nights(events: DataFrame) -> DataFrame:
    """Events of nights that have exactly two annotated ones."""
    pairs = events.where("step IS NOT NULL").groupBy("series_id", "night").count().where("count = 2")
    return events.join(pairs, ["series_id", "night"], "left_semi")


def merge_predictions(tables: Sequence[DataFrame], names: Sequence[str], keys: Sequence[str] = KEYS, how: str = "inner") -> DataFrame:
    """One row per key, value columns suffixed by model. `full` keeps keys that any table has."""
    own = [t.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in t.columns if c not in keys]) for t, n in zip(tables, names, strict=True)]
    return reduce(lambda a, b: a.join(b, list(keys), how), own)


def overlaps(spans: DataFrame, others: DataFrame, start: str, end: str, o_start: str, o_end: str, bin_size: int, key: str = "series_id") -> DataFrame:
    """Pairs with start <= o_end and o_start <= end. Both sides go to the bins they touch, so a pair meets on an equal key, and only
    the pair's first common bin reports it."""
    bins = lambda df, a, b: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size))))
    pairs = bins(spans, start, end).join(bins(others, o_start, o_end), [key, "_bin"])
    first = F.floor(F.greatest(F.col(start), F.col(o_start)) / bin_size)
    return pairs.where((F.col(start) <= F.col(o_end)) & (F.col(o_start) <= F.col(end)) & (F.col("_bin") == first)).drop("_bin")


def pair_intervals(marks: DataFrame, key: str = "series_id", at: str = "step", kind: str = "kind") -> DataFrame:
    """start, end: the i-th 'start' with the i-th 'end' of a series."""
    n = F.row_number().over(Window.partitionBy(key, kind).orderBy(at))
    own = marks.withColumn("_n", n)
    return own.where(F.col(kind) == "start").select(key, "_n", F.col(at).alias("start")).join(own.where(F.col(kind) == "end").select(key, "_n", F.col(at).alias("end")), [key, "_n"]).drop("_n")


def inside(points: DataFrame, intervals: DataFrame, at: str = "step", key: str = "series_id", bin_size: float = 1024) -> DataFrame:
    """Points in any interval, both ends included. Intervals go to the bins they touch, so points meet them on an equal key."""
    i = intervals.select(F.col(key).alias("_k"), "start", "end").where(F.col("start") <= F.col("end"))
    i = i.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    here = (F.col(key) == F.col("_k")) & (F.floor(F.col(at) / bin_size) == F.col("_bin"))
    return points.join(i, here & F.col(at).between(F.col("start"), F.col("end")), "left_semi")


def nearest(points: DataFrame, truth: DataFrame, at: str = "step", key: str = "series_id", name: str = "nearest") -> DataFrame:
    """The nearest truth of each point, the later one of equals: one sort of both together, no pairs."""
    p = points.withColumns({"_t": F.lit(None).cast("long"), "_p": F.lit(1)})
    both = p.unionByName(truth.select(key, F.col(at), F.col(at).cast("long").alias("_t"), F.lit(0).alias("_p")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_p")
    both = both.withColumns({"_b": F.last("_t", ignorenulls=True).over(w.rowsBetween(FIRST, 0)), "_f": F.first("_t", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, F.desc("_p")).rowsBetween(0, LAST))})
    back, ahead = F.col(at) - F.col("_b"), F.col("_f") - F.col(at)
    pick = F.when(F.col("_b").isNull(), F.col("_f")).when(F.col("_f").isNull(), F.col("_b")).when(ahead <= back, F.col("_f")).otherwise(F.col("_b"))
    return both.where("_p = 1").withColumn(name, pick).drop("_t", "_p", "_b", "_f")


def join_back(rows: DataFrame, coarse: DataFrame, unit: str, ts: str = "ts", key: str = "series_id") -> DataFrame:
    """Each raw row with the values of its time unit: `coarse` has the unit's start in column `unit`."""
    return rows.withColumn(unit, F.date_trunc(unit, ts)).join(coarse, [key, unit])


def candidate_rows(candidates: DataFrame, rows: DataFrame, folds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the candidates, with their series' fold; series without one are in fold 0."""
    return candidates.join(rows, list(keys)).join(folds, "series_id", "left").fillna(0, ["fold"])


def suppress(df: DataFrame, periodicity: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """cols * (1 - periodicity), missing as 0; *_sin and *_cos stay."""
    own = df.join(periodicity.select(*keys, F.col("periodicity").alias("_p")), list(keys), "left")
    less = 1 - F.coalesce("_p", F.lit(0.0))
    return own.withColumns({c: F.col(c) * less for c in cols if not c.endswith(("_sin", "_cos"))}).drop("_p")
