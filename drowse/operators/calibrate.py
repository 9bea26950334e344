"""Scores per day and per series."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _day(*keys: str):
    return Window.partitionBy(*keys)


def by_offset(score: str, offset: float, *keys: str) -> Column:
    """score / (sum of the group + offset)."""
    return F.col(score) / (F.sum(score).over(_day(*keys)) + offset)


def by_soft_offset(p: str, offset: float, *keys: str) -> Column:
    """p / (sum + 1 / (offset + sum))."""
    s = F.sum(p).over(_day(*keys))
    return F.col(p) / (s + 1 / (offset + s))


def late_discount(date: str, rate: float, series: str = "series_id") -> Column:
    own = Window.partitionBy(series)
    first, last = F.min(date).over(own), F.max(date).over(own)
    return 1 - rate * F.datediff(date, first) / (F.datediff(last, first) + 1)


def exact_sum(score: str, *keys: str) -> Column:
    """The sum of the group in decimals, which no order of the rows changes; in doubles where a value is not finite or has 11 digits before the point."""
    day, exact = _day(*keys), F.col(score).try_cast("decimal(28, 18)")
    return F.when(F.count(exact).over(day) == F.count(score).over(day), F.sum(exact).over(day).cast("double")).otherwise(F.sum(score).over(day))


def daily_rule(score: str, *keys: str, threshold: float = 3.0, factor: float = 0.8) -> Column:
    """The score as it is on days whose sum, at least 1, is above the threshold; damped on others."""
    s = F.greatest(exact_sum(score, *keys), F.lit(1.0))
    return F.when(s > threshold, F.col(score)).otherwise(F.col(score) * factor)
