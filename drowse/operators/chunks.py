"""Chunks of series, and labels on their frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbourhood(detections: DataFrame, n: int, by: int, step: str = "step") -> DataFrame:
    """Distinct series_id, step of [s - n, s + n) in strides, none below 0."""
    out = detections.select("series_id", F.explode(F.sequence(F.col(step) - n, F.col(step) + n - by, F.lit(by))).alias("step"))
    return out.where("step >= 0").distinct()


def fixed(size: int, shift: int = 0, step: str = "step") -> dict[str, Column]:
    at = F.col(step) - shift
    return {"chunk_no": F.floor(at / size), "pos": F.pmod(at, F.lit(size))}


def padded(df: DataFrame, size: int, step: str = "step") -> DataFrame:
    """len // size + 1 chunks of `size` rows for each series; rows past the end have nulls."""
    last = df.groupBy("series_id").agg((F.max(step) + 1).alias("_n"))
    grid = last.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.floor(F.col("_n") / size) + 1) * size - 1)).alias(step))
    return grid.withColumns(fixed(size, step=step)).join(df, ["series_id", step], "left")


def overlapping(df: DataFrame, duration: int, stride: int, lead: int = 0, step: str = "step") -> DataFrame:
    """Each row once for every chunk that covers it: chunk c covers [c * stride - lead, c * stride - lead + duration)."""
    at = F.col(step) + lead
    low = F.greatest(F.lit(0), F.floor((at - duration) / stride) + 1)
    return df.withColumn("chunk_no", F.explode(F.sequence(low.cast("long"), F.floor(at / stride).cast("long")))).withColumn("pos", at - F.col("chunk_no") * stride)


def windows(df: DataFrame, size: int, stride: int, tail: str = "short", step: str = "step", offset: int = 0) -> DataFrame:
    """start, end (exclusive) of windows of each series, the first at `offset`. tail: short, or right-aligned to the series' end. A series
    that ends before the offset has none."""
    n = df.groupBy("series_id").agg((F.max(step) + 1).cast("long").alias("n"))
    start = n.select("series_id", "n", F.explode(F.sequence(F.lit(offset).cast("long"), F.greatest(F.col("n") - 1, F.lit(offset)), F.lit(stride).cast("long"))).alias("start"))
    start = start.where((F.col("start") < F.col("n")) | (F.lit(offset) == 0))
    if tail == "right":
        start = start.withColumn("start", F.greatest(F.lit(0), F.least("start", F.col("n") - size))).distinct()
    return start.withColumn("end", F.least("n", F.col("start") + size))


def frame_of(at: Column, start: Column, duration: int, frames: int) -> Column:
    """Truncates toward 0."""
    return ((at - start) / duration * frames).cast("int")


def sleep_frames(pairs: DataFrame, duration: int, frames: int) -> DataFrame:
    """Frames asleep of each (chunk start, onset, wakeup) pair: series_id, start, frame."""
    a = F.greatest(F.lit(0), frame_of(F.col("onset"), F.col("start"), duration, frames))
    b = F.least(F.lit(frames), frame_of(F.col("wakeup"), F.col("start"), duration, frames))
    return pairs.where(b > a).select("series_id", "start", F.explode(F.sequence(a, b - 1)).alias("frame")).distinct()


# Reach, in frames, of the tolerances that masks are made for
TOLERANCES = (12, 36, 60, 90, 120, 150, 180, 240, 300, 360)


def frame_labels(pairs: DataFrame, duration: int, frames: int) -> DataFrame:
    """series_id, start, kind (onset, wakeup or sleep), frame: the frames of a chunk that are labelled, for its (chunk start, onset, wakeup) pairs. An
    event whose frame is outside the chunk has no label there; sleep is cut at the chunk's ends."""
    at = [pairs.select("series_id", "start", F.lit(e).alias("kind"), frame_of(F.col(e), F.col("start"), duration, frames).alias("frame")) for e in ("onset", "wakeup")]
    points = at[0].unionByName(at[1]).where(F.col("frame").between(0, frames - 1)).distinct()
    return points.unionByName(sleep_frames(pairs, duration, frames).withColumn("kind", F.lit("sleep")))


def tolerance_masks(labels: DataFrame, frames: int, tolerances: Sequence[int] = TOLERANCES) -> DataFrame:
    """series_id, start, kind, tolerance, frame: the frames from `tolerance` before an onset or wakeup to just before `tolerance` after it. labels: of
    `frame_labels`. Runs that overlap are joined before they are spread, so a frame is told once without a distinct over frames."""
    runs = labels.where("kind <> 'sleep'").withColumn("tolerance", F.explode(F.array(*[F.lit(t) for t in tolerances])))
    runs = runs.select("series_id", "start", "kind", "tolerance", F.greatest(F.lit(0), F.col("frame") - F.col("tolerance")).alias("a"), F.least(F.lit(frames), F.col("frame") + F.col("tolerance")).alias("z"))
    # events of one kind that follow each other in a chunk have growing ends, too: each adds what the one before has not told
    before = F.lag("z").over(Window.partitionBy("series_id", "start", "kind", "tolerance").orderBy("a", "z"))
    runs = runs.withColumn("a", F.greatest("a", F.coalesce(before, F.lit(0)))).where("a < z")
    return runs.select("series_id", "start", "kind", "tolerance", F.explode(F.sequence("a", F.col("z") - 1)).alias("frame"))


def random_crop(positions: DataFrame, duration: int, lengths: DataFrame, u: Column, at: str = "step") -> DataFrame:
    """positions with start and end (exclusive) of a crop of `duration` steps that holds each one and lies in its series: all such starts are alike,
    u in [0, 1) draws one. A series shorter than the duration is its own crop. lengths: series_id, n."""
    out = positions.join(lengths.select("series_id", F.col("n").alias("_n")), "series_id")
    low = F.greatest(F.lit(0), F.col(at) - duration + 1)
    high = F.greatest(F.lit(0), F.least(F.col(at), F.col("_n") - duration))
    low = F.least(low, high)
    out = out.withColumn("start", (low + F.floor(u * (high - low + 1))).cast("long"))
    return out.withColumn("end", F.least(F.col("_n"), F.col("start") + duration)).drop("_n")


def chunk_arrays(df: DataFrame, size: int, stride: int, columns: Sequence[str], fill: float = -1, step: str = "step") -> DataFrame:
    """series_id, start, and an array of `size` values for step and each of `columns`: chunks from each multiple of `stride`, the tail filled up with
    `fill`. A series of `size` rows or fewer is one chunk of its own length, not filled."""
    own = df.select("series_id", F.col(step).cast("long").alias(step), *columns)
    n = own.groupBy("series_id").agg((F.max(step) + 1).alias("_n"))
    spread = overlapping(own, size, stride, step=step).join(n, "series_id").where((F.col("_n") > size) | (F.col("chunk_no") == 0))
    rows = spread.groupBy("series_id", "_n", (F.col("chunk_no") * stride).alias("start")).agg(F.array_sort(F.collect_list(F.struct("pos", step, *columns))).alias("_rows"))
    missing = F.when(F.col("_n") > size, F.lit(size) - F.size("_rows")).otherwise(F.lit(0))
    kinds = dict(own.dtypes)
    filled = lambda c: F.concat(F.transform("_rows", lambda r: r[c]), F.array_repeat(F.lit(fill).cast(kinds[c]), missing)).alias(c)
    return rows.select("series_id", "start", *[filled(c) for c in (step, *columns)])


def gaussian(events: DataFrame, reach: int, sigma: float, frames: int, least: float = 1e-3) -> DataFrame:
    """Sum of kernels around event frames: chunk keys, frame, value."""
    spread = events.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    spread = spread.withColumn("_v", F.exp(-F.pow(F.col("_d").cast("double"), 2) / (2 * sigma * sigma))).where(F.col("_v") >= least)
    return spread.withColumn("frame", F.col("frame") + F.col("_d")).where(F.col("frame").between(0, frames - 1)).groupBy("series_id", "start", "frame").agg(F.sum("_v").alias("value"))


def center_labels(pairs: DataFrame, duration: int, frames: int) -> DataFrame:
    """Position, fraction and clipped size of the box of an event at `at` in a chunk."""
    exact = (F.col("at") - F.col("start")) / duration * frames
    return pairs.withColumns({"position": exact.cast("int"), "offset": exact - exact.cast("int"), "size": F.least(F.lit(float(frames)), F.greatest(F.lit(0.0), (F.col("wakeup") - F.col("onset")) / duration * frames))})


def scatter_max(df: DataFrame, keys: list[str], at: Column, p: str) -> DataFrame:
    return df.withColumn("pos", at.cast("long")).groupBy(*keys, "pos").agg(F.max(p).alias(p))


def interpolate(df: DataFrame, x: str, name: str, step: str = "step") -> DataFrame:
    """Nulls by the line between the neighbours that have values; the nearest one at the edges."""
    o = Window.partitionBy("series_id").orderBy(step)
    back, ahead = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(x).isNotNull(), F.col(step))
    df = df.withColumns({"_x0": F.last(x, True).over(back), "_x1": F.first(x, True).over(ahead), "_t0": F.last(at, True).over(back), "_t1": F.first(at, True).over(ahead)})
    line = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col(step) - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0))
    return df.withColumn(name, F.coalesce(F.col(x), line, "_x0", "_x1")).drop("_x0", "_x1", "_t0", "_t1")


def flatten(chunks: DataFrame, values: str, size: int, halo: int, lengths: DataFrame) -> DataFrame:
    """series_id, step, value of chunk arrays, without halo and what lies past the series' end."""
    out = chunks.select("series_id", "chunk_no", F.posexplode(values).alias("pos", "value")).where((F.col("pos") >= halo) & (F.col("pos") < size - halo))
    out = out.withColumn("step", F.col("chunk_no") * (size - 2 * halo) + F.col("pos") - halo).join(lengths, "series_id")
    return out.where((F.col("step") >= 0) & (F.col("step") < F.col("n"))).select("series_id", "step", "value")
