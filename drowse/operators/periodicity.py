"""Artificially repeated segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .groups import map_groups


def standardized(df: DataFrame, x: str, step: str = "step") -> DataFrame:
    """series_id, step, z (population deviation; 0 where it is 0, or x is null) and n, the rows of the series. The sums are joined, not windowed."""
    own = df.groupBy("series_id").agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"), F.count(F.lit(1)).alias("n"))
    z = F.coalesce((F.col(x) - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)), F.lit(0.0))
    return df.join(own, "series_id").select("series_id", F.col(step).cast("long").alias("step"), z.alias("z"), "n")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def chunk_hashes(z: DataFrame, split: int, stride: int, downsample: int, digits: int = 7, day: int = 0, rows: int = blocks.ROWS) -> DataFrame:
    """series_id, n, offset, chunk, h1, h2: a chunk is `split` values, `downsample` rows apart; chunks begin every split * downsample rows from each
    multiple of `stride` on, with zeros past the end. A block of the series with the rows behind it hashes the chunks that begin in it, so
    there is one row a chunk, fewer than the series has: none for each row and offset. Two hashes of 64 bits name the values."""
    span = split * downsample
    spread = blocks.halo(z.where(F.col("n") >= day), 0, span, "step", rows)
    weights = np.random.default_rng(7).integers(1, 1 << 63, (2, split), dtype=np.uint64) | np.uint64(1)
    kind = dict(z.dtypes)["series_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.group_tables(batches, ["series_id", "block"]):
            first, n, own = t["step"][0].as_py(), t["n"][0].as_py(), int(pc.sum(t["own"]).as_py() or 0)
            start = first + np.arange(own)
            start = start[(start % span % stride == 0) & (n - start % span >= day)]
            value = np.round(t["z"].to_numpy(), digits) + 0.0  # no negative zero
            code = _mixed(np.concatenate([value, np.zeros(span)]).view(np.uint64))
            hashes = np.zeros((2, len(start)), np.uint64)
            for i in range(split):
                hashes += _mixed(code[start - first + i * downsample] ^ weights[:, i : i + 1])
            columns = [pc.take(t["series_id"].combine_chunks(), pa.array(np.zeros(len(start), np.int64))), *[pa.array(c, pa.int64()) for c in (np.full(len(start), n), start % span, start // span, *hashes.view(np.int64))]]
            yield pa.RecordBatch.from_arrays(columns, ["series_id", "n", "offset", "chunk", "h1", "h2"])

    sort = ["series_id", "block"]
    return spread.repartition(*sort).sortWithinPartitions(*sort, "step").mapInArrow(run, f"series_id {kind}, n long, offset long, chunk long, h1 long, h2 long")


def repeated_chunks(hashes: DataFrame, span: int) -> DataFrame:
    """series_id, n, offset, chunk of the chunks that equal another one of their offset; the last chunk, which the end cuts, copies the one before."""
    same = F.count(F.lit(1)).over(Window.partitionBy("series_id", "offset", "h1", "h2")) > 1
    last = F.ceil((F.col("n") - F.col("offset")) / span) - 1
    own = hashes.withColumn("_same", same).where(F.col("_same") & (F.col("chunk") < last))
    return own.select("series_id", "n", "offset", F.explode(F.when(F.col("chunk") == last - 1, F.array("chunk", last)).otherwise(F.array("chunk"))).alias("chunk"))


def detect(df: DataFrame, x: str, day: int = 17_280, split: int = 120, stride: int = 36, downsample: int = 12, step: str = "step", rows: int = blocks.ROWS) -> DataFrame:
    """series_id, step, periodicity: the flags of each offset spread over the rows by linear interpolation, then their maximum.
    Series shorter than a day have 0. `step` is the row's place in its series; a long series is as many groups as it has blocks."""
    z, span = standardized(df, x, step), split * downsample
    flags = repeated_chunks(chunk_hashes(z, split, stride, downsample, day=day, rows=rows), span)
    n, off = F.col("n"), F.col("offset")
    samples = F.ceil((n - off) / downsample)
    per = F.when(samples > 1, (n - off - 1) / (samples - 1)).otherwise(F.lit(1.0))  # rows a sample; the last sample is the last row
    low = F.greatest(off, off + F.floor((F.col("chunk") * split - 1) * per) - 1)
    high = F.when(samples > 1, F.least(n - 1, off + F.ceil((F.col("chunk") + 1) * split * per) + 1)).otherwise(n - 1)
    reached = flags.withColumn("block", F.explode(F.sequence(F.floor(low / rows).cast("long"), F.floor(high / rows).cast("long"))))
    none = F.lit(-1).cast("long")
    both = z.select("series_id", F.floor(F.col("step") / rows).alias("block"), "step", "n", none.alias("offset"), none.alias("chunk"))
    both = both.unionByName(reached.select("series_id", "block", none.alias("step"), "n", "offset", "chunk"))

    def spread(p: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        steps, n, offset, chunk = (p[c].to_numpy() for c in ("step", "n", "offset", "chunk"))
        value, at = np.zeros(len(p)), steps >= 0
        for a, z in spans:
            first = a + int(np.searchsorted(steps[a:z], 0))  # flags come first
            if first == a:
                continue
            for o in np.unique(offset[a:first]):
                mine, m = np.sort(chunk[a:first][offset[a:first] == o]), -(-(n[a] - o) // downsample)
                i = steps[first:z] - o
                place = np.maximum(i, 0) * (m - 1) / (n[a] - o - 1) if n[a] - o > 1 else np.zeros(len(i))
                low = np.floor(place)
                flag = lambda k: np.isin((k // split).astype(np.int64), mine).astype(float)  # noqa: E731, B023
                left, right = flag(low), flag(np.minimum(low + 1, m - 1))
                value[first:z] = np.maximum(value[first:z], np.where(i >= 0, left + (right - left) * (place - low), 0))
        return pd.DataFrame({"series_id": p["series_id"][at], "step": steps[at], "periodicity": value[at]})

    kind = dict(df.dtypes)["series_id"]
    return map_groups(both, ["series_id", "block"], ["step", "offset", "chunk"], spread, f"series_id {kind}, step long, periodicity double")


#: Vectors of a block of a cell.
BLOCK = 1024


def chunk_cells(units: DataFrame, threshold: float, key: str, block: int = BLOCK) -> DataFrame:
    """Unit vectors `v` (named by `h`) in the groups in which those with a cosine above the threshold meet: key, size, cx, cy, lo, hi, part, home.

    Their distance is below sqrt(2 - 2 * threshold), and so is that of their projections on any unit vector. A cell is a square of that width of
    two projections, on the vector of equal components and on the one whose second half is negative. A vector is at home in its cell and
    visits four of the eight around it, so that neighbours meet once. A cell with more than `block` homes is worked as pairs of blocks."""
    width, half = max(1e-6, (2 - 2 * threshold) ** 0.5) * (1 + 1e-9), F.ceil(F.size("v") / 2).cast("int")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    root = F.sqrt(F.greatest(F.size("v"), F.lit(1)))
    first = total(F.slice("v", F.lit(1), F.greatest(half, F.lit(1))))
    own = units.select(key, "h", "v", F.size("v").alias("size"), F.floor(total("v") / root / width).alias("x"), F.floor((2 * first - total("v")) / root / width).alias("y"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    spread = own.withColumn("to", F.explode(steps)).select(key, "size", (F.col("x") + F.col("to.a")).alias("cx"), (F.col("y") + F.col("to.b")).alias("cy"), "h", "v", ((F.col("to.a") == 0) & (F.col("to.b") == 0)).alias("home"))
    cell = [key, "size", "cx", "cy"]
    sizes = spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("homes > 0 AND n > 1")
    spread = spread.join(sizes.select(*cell, F.ceil(F.col("n") / block).cast("int").alias("parts")), cell)
    spread = spread.withColumns({"part": F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    return spread.select(*cell, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "home", "h", "v")


def similar_chunks(df: DataFrame, vector: str, threshold: float = 0.99, key: str = "series_id", number: str = "chunk", block: int = BLOCK) -> DataFrame:
    """key, number, periodic: chunks whose cosine with another chunk of the series is above the threshold. Equal unit vectors are found by hash and
    compared as one; the others by products of matrices in the cells of `chunk_cells`. No pair is a row. A null vector, one with a null
    component, and one of zeros are like none; vectors of different sizes are not compared."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v))
    own = df.select(key, number, F.when(norm > 0, F.transform(vector, lambda v: v / norm)).alias("v")).withColumn("h", F.xxhash64("v", F.size("v")))
    kinds = {**dict(df.dtypes)}
    once = own.where("v IS NOT NULL").groupBy(key, "h").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    group = [key, "size", "cx", "cy", "lo", "hi"]

    def meet(p: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        part, home, hit = p["part"].to_numpy(), p["home"].to_numpy(), np.zeros(len(p), bool)
        cross, vectors = (p["lo"] != p["hi"]).to_numpy(), p["v"].tolist()
        for a, z in spans:
            m, at = np.stack(vectors[a:z]), np.flatnonzero(home[a:z])
            above = m[at] @ m.T > threshold  # two visitors meet elsewhere, where one is at home
            above[np.arange(len(at)), at] = False
            if cross[a]:
                above &= part[a:z][at, None] != part[None, a:z]
            hit[a:z] = above.any(0)
            hit[a + at] |= above.any(1)
        return p.loc[hit, [key, "h"]]

    found = map_groups(chunk_cells(once, threshold, key, block), group, ["h"], meet, f"{key} {kinds[key]}, h long")
    same = once.where(F.col("n") > 1).select(key, "h") if threshold < 1 else once.limit(0).select(key, "h")
    like = found.union(same).distinct().withColumn("_like", F.lit(1))
    return own.join(like, [key, "h"], "left").select(key, number, F.coalesce("_like", F.lit(0)).alias("periodic"))
