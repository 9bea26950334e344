"""Ordered work on series of any length: two-phase scans, and blocks with halos.

A window over (series) puts a series into one task. Here a series is many blocks of its order. A running sum is the sum within the block plus
the totals of the blocks before (`scan`); a frame of bounded reach is evaluated in blocks that also hold the neighbouring rows that it
needs (`halo`). So a series with a third of all rows is as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that a scan cuts the order into; rows of a block of `halo`.
BLOCKS, ROWS = 256, 1 << 16


def free(df: DataFrame, name: str) -> str:
    """`name`, or as many underscores behind it as it takes to be no column of `df`."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def as_number(df: DataFrame, order: str) -> Column:
    """A number that never falls along `order`: rows of equal numbers share a block. Of strings it is their first seven bytes."""
    kind = dict(df.dtypes)[order]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(order, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order).cast("double")


def in_blocks(df: DataFrame, order: str, descending: bool = False, n: int = BLOCKS, name: str = "_block") -> DataFrame:
    """`df` with the block of each row: quantiles of `order` over all rows are the bounds, one aggregate with a bounded state. A row with a
    null goes first, as in an ascending sort, or last in a descending one."""
    at = as_number(df, order)
    at = -at if descending else at
    bounds = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10 * n)).first()[0]  # n - 1 numbers
    bounds = np.array(bounds or [], np.float64)

    @F.pandas_udf("int")
    def block(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(np.float64), side="right"), dtype="int32")

    return df.withColumn(name, F.when(F.col(order).isNull(), F.lit(n + 1 if descending else -1)).otherwise(block(at.cast("double"))))


def scan(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], sums: dict[str, Column], descending: bool = False, n: int = BLOCKS) -> DataFrame:
    """`df` with running sums of `sums` (name -> values) within `keys`, along the columns `order` (descending: the first of them), the row itself
    included. One shuffle by (keys, block) and sums there; each block's totals, at most n rows a key, give the blocks' offsets."""
    first, *rest = [order] if isinstance(order, str) else order
    block, key, own = free(df, "_block"), free(df, "_key"), [free(df, f"_own_{i}") for i in range(len(sums))]
    cut = in_blocks(df, first, descending, n, block).withColumn(key, F.struct(F.lit(0).alias("_"), *keys))  # in a struct, nulls are equal
    w = Window.partitionBy(key, block).orderBy(F.desc(first) if descending else F.asc(first), *rest).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(key, block).agg(*[F.sum(x).alias(c) for c, x in zip(own, sums.values(), strict=True)])
    before = Window.partitionBy("_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key).alias("_k"), F.col(block).alias("_at"), *own)
    offsets = offsets.select("_k", "_at", *[F.sum(c).over(before).alias(f"_before_{i}") for i, c in enumerate(own)])
    cut = cut.withColumns({c: F.sum(x).over(w) for c, x in zip(own, sums.values(), strict=True)})
    out = cut.join(offsets.hint("merge"), (F.col(key) == F.col("_k")) & (F.col(block) == F.col("_at")))
    values = {name: F.coalesce(F.col(f"_before_{i}") + F.coalesce(F.col(c), F.lit(0)), F.col(c)) for i, (name, c) in enumerate(zip(sums, own, strict=True))}
    return out.select(*df.columns, *[v.alias(name) for name, v in values.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str = "place", n: int = BLOCKS) -> DataFrame:
    """`df` with the row's place within `keys` along `order`, from 0."""
    return scan(df, keys, order, {name: F.lit(1).cast("long")}, n=n).withColumn(name, F.col(name) - 1)


def halo(df: DataFrame, before: int, after: int, place: str = "step", rows: int = ROWS) -> DataFrame:
    """Each row in its block of `rows` places, and again in each block whose frames, `before` rows back and `after` ahead, reach it. Columns
    `block` and `own` (whether the row belongs to the block). `place` numbers the rows of a series without gaps."""
    at = F.col(place)
    low, high = F.greatest(F.lit(0), F.floor((at - after) / rows)), F.floor((at + before) / rows)
    spread = df.withColumn("block", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    return spread.withColumn("own", F.floor(at / rows) == F.col("block"))


def bounded(df: DataFrame, before: int, after: int, columns: Callable[[Sequence[str], str], dict[str, Column]], keys: Sequence[str] = ("series_id",), place: str = "step", rows: int = ROWS) -> DataFrame:
    """`df` with window columns whose frames reach `before` rows back and `after` ahead at most: columns(keys, order) makes them over the keys
    that it is given, here those of the series and the block."""
    spread = halo(df, before, after, place, rows)
    made = columns([*keys, "block"], place)
    return spread.withColumns(made).where("own").select(*df.columns, *made)


def group_tables(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups, one at a time, from batches whose rows are sorted by `keys`."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, new = pa.table(batch), np.zeros(batch.num_rows, bool)
        for k in keys:
            x = pc.dictionary_encode(rows[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        new[0] = not held or any(held[-1][k][-1] != rows[k][0] for k in keys)
        starts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        if starts[0] > 0:
            held.append(rows.slice(0, starts[0]))
        for a, z in zip(starts, starts[1:], strict=False):
            if held:
                yield pa.concat_tables(held)
            held = [rows.slice(a, z - a)]
    if held:
        yield pa.concat_tables(held)


def many_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups, about `rows` rows of them at a time, and where each begins and the last one ends, from batches whose rows are sorted by `keys`."""
    held, size = [], 0

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = pc.dictionary_encode(t[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.r_[0, np.flatnonzero(new), t.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.table(batch))
        size += batch.num_rows
        if size >= rows:
            t = pa.concat_tables(held).combine_chunks()
            at = cut(t)
            held, size = [t.slice(at[-2])], 0
            if len(at) > 2:
                yield t.slice(0, at[-2]), at[:-1]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, cut(t)


#: Rows of the groups that `map_blocks` works at a time.
MANY = 1 << 15


def map_blocks(df: DataFrame, before: int, after: int, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: Sequence[str], outputs: Sequence[str], keys: Sequence[str] = ("series_id",), place: str = "step", rows: int = ROWS) -> DataFrame:
    """`df` with the columns `outputs` (double): fn gets the arrays `inputs` of blocks with their halos, in order, nulls as NaN, as matrices with equally
    long blocks as rows, and gives such matrices, of which the blocks' own rows stay, NaN as null. Other columns pass as Arrow, unchanged."""
    spread = halo(df, before, after, place, rows)
    columns, sort = df.columns, [*keys, "block"]
    names = [*columns, *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in many_groups(batches, sort, MANY):
            own, size = t["own"].to_numpy(), np.diff(at)
            values = {c: pc.cast(t[c], pa.float64()).to_numpy(zero_copy_only=False) for c in inputs}
            size[np.add.reduceat(own.astype(int), at[:-1]) == 0] = 0  # halos without a row of the block
            made = {c: np.empty(t.num_rows) for c in outputs}
            for n in np.unique(size[size > 0]):
                rows_ = at[:-1][size == n, None] + np.arange(n)
                for c, x in fn({c: x[rows_] for c, x in values.items()}).items():
                    if c in made:
                        made[c][rows_] = x
            if own.any():
                kept = t.select(columns).filter(t["own"])
                arrays = [c.combine_chunks() for c in kept.columns] + [pa.array(made[c][own], pa.float64(), from_pandas=True) for c in outputs]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in df.dtypes), *(f"`{c}` double" for c in outputs)])
    return spread.repartition(*sort).sortWithinPartitions(*sort, place).mapInArrow(run, schema)
