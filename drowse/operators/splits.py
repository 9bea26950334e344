"""Folds and samples. Random choices are hashes of keys with a seed, so they are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def quantile_classes(counts: DataFrame, x: str = "n", bins: int = 10) -> DataFrame:
    """class 1..bins by linearly interpolated quantiles, bins closed on the right; 0 for rows whose count is 0."""
    edges = counts.where(F.col(x) > 0).agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_e"))
    above = F.size(F.filter("_e", lambda e: F.col(x) > e)) + 1
    return counts.join(F.broadcast(edges)).withColumn("class", F.when(F.col(x) > 0, above).otherwise(0)).drop("_e")


def stratified_folds(df: DataFrame, k: int, key: str = "series_id", label: str = "class") -> DataFrame:
    """fold: within a class, blocks of rows in key order. Block sizes: with all rows sorted by class (classes by their first key),
    fold f gets from a class as many rows as places p of the class there are with p mod k = f."""
    sizes = df.groupBy(label).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = lambda n, f: F.floor((n - f - 1) / k) + 1  # noqa: E731  places below n that are f mod k
    share = [upto(F.col("_from") + F.col("_n"), f) - upto(F.col("_from"), f) for f in range(k)]
    ends = F.array(*[sum(share[1 : f + 1], share[0]) for f in range(k)])
    own = blocks.numbered(df, [label], key, "_place").join(F.broadcast(sizes.select(label, ends.alias("_ends"))), label)
    return own.withColumn("fold", F.size(F.filter("_ends", lambda e: e <= F.col("_place")))).drop("_place", "_ends")


def seeded(key: Column, seed: int = 0) -> Column:
    """Uniform in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32


def downsample_negatives(df: DataFrame, label: str, key: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    return df.where((F.col(label) > 0) | (seeded(F.col(key), seed) < rate))


def sample_series(df: DataFrame, n: int, seed: int = 0, key: str = "series_id") -> DataFrame:
    return df.select(key).distinct().orderBy(seeded(F.col(key), seed), key).limit(n)


def standardize(df: DataFrame, cols: list[str], fold: Column) -> DataFrame:
    """cols by mean and population deviation of the rows outside the fold; a deviation of 0 counts as 1."""
    stats = df.where(~fold).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.join(F.broadcast(stats)).withColumns({c: z(c) for c in cols}).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
