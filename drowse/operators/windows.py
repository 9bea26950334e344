"""Per-series windows. Frames count rows; a centred frame of w rows covers i - w // 2 to i + ceil(w / 2) - 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("series_id",)
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def ordered(keys: Sequence[str] = KEY, order: str = "step") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def centered(w: int, keys: Sequence[str] = KEY, order: str = "step") -> WindowSpec:
    return ordered(keys, order).rowsBetween(-(w // 2), (w + 1) // 2 - 1)


def trailing(w: int, keys: Sequence[str] = KEY, order: str = "step") -> WindowSpec:
    return ordered(keys, order).rowsBetween(1 - w, 0)


STATS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum, "median": lambda c: F.percentile(c, 0.5)}


def rolling(x: Column, stat: str, frame: WindowSpec, least: int = 1) -> Column:
    """Null until the frame has `least` values."""
    value = STATS[stat](x).over(frame)
    return value if least <= 1 else F.when(F.count(x).over(frame) >= least, value)


def rolling_mean_by_prefix(df: DataFrame, x: str, w: int, name: str) -> DataFrame:
    """Centred mean over the values among up to w rows, from running sums: linear in the rows for any w. Nulls count neither as values nor
    in the mean, which is null where the frame has no value. The series mean is taken off first."""
    o, whole = ordered(), Window.partitionBy(*KEY)
    df = df.withColumn("_m", F.avg(x).over(whole))
    df = df.withColumns({"_s": F.sum(F.coalesce(F.col(x) - F.col("_m"), F.lit(0.0))).over(o.rowsBetween(FIRST, 0)), "_n": F.count(x).over(o.rowsBetween(FIRST, 0))})
    ahead = {f"{c}_hi": F.coalesce(F.lead(c, (w + 1) // 2 - 1).over(o), F.last(c).over(o.rowsBetween(FIRST, LAST))) for c in ("_s", "_n")}
    back = {f"{c}_lo": F.coalesce(F.lag(c, w // 2 + 1).over(o), F.lit(0)) for c in ("_s", "_n")}
    df = df.withColumns(ahead | back)
    count = F.nullif(F.col("_n_hi") - F.col("_n_lo"), F.lit(0))
    return df.withColumn(name, (F.col("_s_hi") - F.col("_s_lo")) / count + F.col("_m")).drop("_m", "_s", "_n", *ahead, *back)


def row_index(keys: Sequence[str] = KEY, order: str = "step") -> Column:
    """Place of a row in its series, from 0."""
    return F.row_number().over(ordered(keys, order)) - 1


def zscore_series(x: str) -> Column:
    own = Window.partitionBy(*KEY)
    return (F.col(x) - F.avg(x).over(own)) / F.stddev_samp(x).over(own)


def change(x: str, keys: Sequence[str] = KEY, order: str = "step") -> Column:
    return F.coalesce(F.col(x) - F.lag(x).over(ordered(keys, order)), F.lit(0.0))


def activity(enmo: str, w: int, keys: Sequence[str] = KEY, order: str = "step") -> Column:
    return F.sum(F.greatest(F.col(enmo) - 0.02, F.lit(0.0))).over(centered(w, keys, order))


def lids(df: DataFrame, enmo: str, w: int, smooth: int, name: str, order: str = "step") -> DataFrame:
    """1 / (smoothed activity count + 1)."""
    df = df.withColumn("_ac", activity(enmo, w, order=order))
    return df.withColumn(name, F.avg(1 / (F.col("_ac") + 1)).over(centered(smooth, order=order))).drop("_ac")


def back_filled(x: Column, keys: Sequence[str] = KEY, order: str = "step") -> Column:
    """The next value that isn't null, within the partition."""
    return F.first(x, ignorenulls=True).over(ordered(keys, order).rowsBetween(0, LAST))


def trailing_activity(df: DataFrame, enmo: str, w: int, name: str, keys: Sequence[str] = ("series_id", "chunk_id")) -> DataFrame:
    """100 / (full trailing activity count + 1), back-filled in the chunk."""
    df = df.withColumn("_ac", rolling(F.greatest(F.col(enmo) - 0.02, F.lit(0.0)), "sum", trailing(w, keys), w))
    return df.withColumn(name, 100 / (back_filled(F.col("_ac"), keys) + 1)).drop("_ac")


def mean_minus_current(x: str, w: int, direction: str = "trailing", keys: Sequence[str] = KEY) -> Column:
    frame = trailing(w, keys) if direction == "trailing" else ordered(keys).rowsBetween(0, w - 1)
    return rolling(F.col(x), "mean", frame, w) - F.col(x)


def time_of_day_profile(x: str, day: int, step: str = "step") -> Column:
    """Mean over all days at the same place of the day."""
    return F.avg(x).over(Window.partitionBy(*KEY, F.col(step) % day))


def gap_sessions(expected: int, step: str = "step") -> Column:
    """Number of the chunk of rows whose steps follow each other by `expected`, from 0."""
    o = ordered(order=step)
    return F.col(step) - F.lag(step).over(o) != expected


def sessions(df: DataFrame, expected: int, step: str = "step", name: str = "chunk_id") -> DataFrame:
    df = df.withColumn("_new", F.coalesce(gap_sessions(expected, step), F.lit(False)).cast("int"))
    return df.withColumn(name, F.sum("_new").over(ordered(order=step).rowsBetween(FIRST, 0))).drop("_new")


def transitions(df: DataFrame, label: str, p: str, step: str = "step") -> DataFrame:
    """Rows where the label turns: onset with score p, wakeup with 1 - p."""
    df = df.withColumn("_last", F.lag(label).over(ordered(order=step)))
    turned = df.withColumn("event", F.when((F.col("_last") == 0) & (F.col(label) == 1), "onset").when((F.col("_last") == 1) & (F.col(label) == 0), "wakeup"))
    return turned.where("event IS NOT NULL").withColumn("score", F.when(F.col("event") == "onset", F.col(p)).otherwise(1 - F.col(p))).drop("_last")


def sleep_state(event: str, step: str = "step") -> Column:
    running = ordered(order=step).rowsBetween(FIRST, 0)
    count = lambda v: F.sum(F.coalesce((F.col(event) == v).cast("int"), F.lit(0))).over(running)
    return count("onset") - count("wakeup")


def ramp_target(df: DataFrame, is_event: Column, widths: Sequence[int], name: str, step: str = "step") -> DataFrame:
    """1 - i / n for the narrowest widths[i] that reaches the nearest event: two linear passes instead of one wide frame per width."""
    o = ordered(order=step)
    df = df.withColumn("_i", F.row_number().over(o))
    at = F.when(is_event, F.col("_i"))
    df = df.withColumns({"_b": F.last(at, ignorenulls=True).over(o.rowsBetween(FIRST, 0)), "_f": F.first(at, ignorenulls=True).over(o.rowsBetween(0, LAST))})
    d = F.least(F.col("_i") - F.col("_b"), F.col("_f") - F.col("_i"))
    value = F.lit(0.0)
    for i, w in reversed(list(enumerate(widths))):
        value = F.when(d <= w - 1, 1 - i / len(widths)).otherwise(value)
    return df.withColumn(name, value).drop("_i", "_b", "_f")


# Rows that the ten tolerances reach on the nearer and the farther side of a candidate 3 steps after a row, and 9 steps after it
NEARER, FARTHER = (1, 3, 5, 8, 10, 13, 15, 20, 25, 30), (1, 3, 5, 7, 10, 12, 15, 20, 25, 30)


def expectation(x: str, counts: Sequence[int], keys: Sequence[str] = KEY, order: str = "step", right: Sequence[int] | None = None) -> Column:
    """Sum over tolerances of the trailing sums of `counts` rows, and of the leading ones of `right` rows (or as many) without the row itself. Rings
    between neighbouring counts are summed once each and weigh as many tolerances as reach them."""
    o, n = ordered(keys, order), len(counts)

    def rings(reach: Sequence[int], side: int) -> list[Column]:
        ends = [0, *reach]
        frame = lambda a, z: o.rowsBetween(-(z - 1), -a) if side < 0 else o.rowsBetween(a + 1, z)
        return [F.coalesce(F.sum(x).over(frame(a, z)), F.lit(0.0)) * (n - i) for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False))]

    parts = rings(counts, -1) + rings(counts if right is None else right, 1)
    return sum(parts[1:], parts[0])


def phase_expectations(x: str, keys: Sequence[str] = KEY, order: str = "step") -> dict[str, Column]:
    """Expected gain of the candidates 3 and 9 steps after each row, over all ten tolerances."""
    return {"gain3": expectation(x, NEARER, keys, order, FARTHER), "gain9": expectation(x, FARTHER, keys, order, NEARER)}


def smoothed_periodicity(df: DataFrame, p: str, name: str, w: int = 10, step: str = "step") -> DataFrame:
    """min(p, centred mean over w rows); past an edge the series is mirrored, the edge row counted again. The series must have w rows."""
    o = ordered(order=step)
    half, ahead = w // 2, (w + 1) // 2 - 1
    df = df.withColumns({"_i": F.row_number().over(o) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*KEY))})
    whole = o.rowsBetween(FIRST, LAST)
    edge = lambda r: F.sum(F.when(F.col("_i") < r, F.col(p))).over(whole)
    low = F.lit(0.0)
    for r in range(1, half + 1):  # rows missing before: the first r values again
        low = F.when(F.col("_i") == half - r, edge(r)).otherwise(low)
    high = F.lit(0.0)
    for r in range(1, ahead + 1):
        high = F.when(F.col("_n") - 1 - F.col("_i") == ahead - r, F.sum(F.when(F.col("_n") - 1 - F.col("_i") < r, F.col(p))).over(whole)).otherwise(high)
    mean = (F.sum(p).over(o.rowsBetween(-half, ahead)) + low + high) / w
    return df.withColumn(name, F.least(F.col(p), mean)).drop("_i", "_n")


def local_maxima(df: DataFrame, x: str, height: float, keys: Sequence[str] = KEY, step: str = "step") -> DataFrame:
    """Rows above both neighbouring runs of other values, at the middle of a plateau; edges never. Rows that are too low, and those that neither rise
    above both neighbours nor equal one, are left out before the runs are sorted."""
    o, v = ordered(keys, step), F.col(x)
    df = df.withColumns({"_i": F.row_number().over(o), "_before": F.lag(x).over(o), "_after": F.lead(x).over(o)})
    df = df.withColumn("_r", F.sum(F.coalesce((v != F.col("_before")).cast("int"), F.lit(1))).over(o.rowsBetween(FIRST, 0)))
    single = (F.col("_before") < v) & (F.col("_after") < v)
    df = df.where((v >= height) & (single | (F.col("_before") == v) | (F.col("_after") == v)))
    runs = Window.partitionBy(*keys, "_r")
    df = df.withColumns({"_a": F.min("_i").over(runs), "_z": F.max("_i").over(runs)})
    df = df.withColumns({"_before": F.max(F.when(F.col("_i") == F.col("_a"), F.col("_before"))).over(runs), "_after": F.max(F.when(F.col("_i") == F.col("_z"), F.col("_after"))).over(runs)})
    peak = (F.col("_i") == F.floor((F.col("_a") + F.col("_z")) / 2)) & (F.col("_before") < v) & (F.col("_after") < v)
    return df.where(peak).drop("_i", "_r", "_a", "_z", "_before", "_after")
