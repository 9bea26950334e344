"""Row-wise expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean and standard deviation of the signals
MEAN_STD = {"anglez": (-8.810476, 35.521877), "enmo": (0.041315, 0.101829)}


def zscore_fixed(df: DataFrame, stats: dict[str, tuple[float, float]] = MEAN_STD) -> DataFrame:
    """Signals by fixed mean and deviation, the originals as *_raw."""
    raw = df.withColumns({f"{c}_raw": F.col(c) for c in stats})
    return raw.withColumns({c: (F.col(c) - m) / s for c, (m, s) in stats.items()})


def cyclic(x: Column, period: float, name: str) -> list[Column]:
    turn = 2 * math.pi * (x % period) / period
    return [F.sin(turn).alias(f"{name}_sin"), F.cos(turn).alias(f"{name}_cos")]


def calendar(ts: str = "ts", shift: int = 0) -> dict[str, Column]:
    """Calendar fields; shift 1 keeps 0 free for padding. time_idx is hour + minute."""
    hour, minute, week = F.hour(ts), F.minute(ts), F.weekday(ts) + 1
    return {"hour": hour + shift, "minute": minute + shift, "minute15": minute % 15 + shift, "weekday": week + shift, "time_idx": hour + minute + shift}


def clip_log(x: Column, scale: float = 0.1, top: float = 10.0) -> Column:
    return F.least(F.log1p(x) / scale, F.lit(top))


def shifted_date(ts: Column, hours: Column | int) -> Column:
    return F.to_date(ts + F.make_dt_interval(hours=F.lit(hours) if isinstance(hours, int) else hours))


def one_hot(column: str, values: Sequence[str]) -> dict[str, Column]:
    """0 where the column is null."""
    return {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}


def ensemble(cols: Sequence[str], name: str, legacy_scale: bool = False) -> dict[str, Column]:
    """Mean, min, max and population variance over model columns; a null counts as 0 in the sums."""
    k, own = len(cols), [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]
    mean = sum(own[1:], own[0]) / k
    var = sum([(mean - c) * (mean - c) for c in own[1:]], (mean - own[0]) * (mean - own[0])) / k
    scale = k if legacy_scale else 1
    return {f"{name}_mean": mean, f"{name}_min": F.least(*cols) / scale, f"{name}_max": F.greatest(*cols) / scale, f"{name}_var": var}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_share(logits: Sequence[Column], which: int) -> Column:
    e = [F.exp(x) for x in logits]
    return e[which] / sum(e[1:], e[0])


def arg_max(values: Sequence[Column]) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    a = F.array(*values)
    return F.array_position(a, F.array_max(a)) - 1


def decay(target: Column, by: float = 0.1) -> Column:
    return F.when(target == 1, 1.0).otherwise(F.greatest(target - by, F.lit(0.0)))


def correct_label(label: Column, p: Column, threshold: float, rate: float) -> Column:
    return F.greatest(label, F.when(p >= threshold, p).otherwise(0.0) * rate)


def chunk_key(series: Column, number: Column) -> Column:
    return F.format_string("%s_%07d", series.cast("string"), number)


def parse_chunk_key(key: Column) -> tuple[Column, Column]:
    return F.regexp_extract(key, r"^(.*)_\d+$", 1), F.regexp_extract(key, r"_(\d+)$", 1).cast("long")


def span_key(series: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", series.cast("string"), start.cast("string"), end.cast("string"))


def parse_span_key(key: Column) -> tuple[Column, Column, Column]:
    """The series may hold underscores itself."""
    part = lambda i: F.regexp_extract(key, r"^(.*)_(\d+)_(\d+)$", i)
    return part(1), part(2).cast("long"), part(3).cast("long")


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(df.colRegex(f"`{pattern}`"))


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls and NaN by the column's mean over real values: one aggregate row, broadcast."""
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    means = df.agg(*[F.avg(real(c)).alias(f"_{c}") for c in cols])
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(real(c), f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])
