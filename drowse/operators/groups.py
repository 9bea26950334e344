"""Sequential work on many groups a call: sorted rows stream through a task, whole groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def whole_groups(batches: Iterable[pd.DataFrame], key: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows of many whole groups at a time, and where each group begins and ends, from batches whose rows are sorted by `key`."""
    held: pd.DataFrame | None = None
    key = list(key)
    for batch in batches:
        if batch.empty:
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(rows), bool)
        for k in key:
            code = pd.factorize(rows[k], use_na_sentinel=False)[0]
            new[1:] |= code[1:] != code[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        held = rows.iloc[starts[-1] :]
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], list(zip(starts, starts[1:], strict=False))
    if held is not None:
        yield held, [(0, len(held))]


def map_groups(df: DataFrame, key: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str) -> DataFrame:
    """fn over runs of whole groups, sorted by key and order. The calls are few, and a task holds a batch and one group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, spans in whole_groups(batches, key):
            yield fn(rows, spans)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)
