"""Rolling statistics of wide frames over the rows of a block, in time that does not depend on the frame's width (the median: its logarithm).

A frame of w rows covers i - w // 2 to i + ceil(w / 2) - 1, cut at the ends of the series. Rows are laid in pieces of w, so a frame is the
end of one piece and the beginning of the next: running sums, maxima and second moments from both ends of each piece give every frame
by one combination, without subtracting great sums. The median keeps an ordered skip list of the frame.

Arrays are one block, or several equally long ones as rows of a matrix, each on its own, with the same results.

Nulls, and NaN, are no values: a frame counts the others, and its statistic is null below `least` of them, std also below two.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import blocks


@dataclass(frozen=True)
class Rolling:
    """`stat` (mean, std, max, min, sum, median or count) of x over w rows; `fill` in place of null, if given. least=None: w values."""

    name: str
    x: str
    stat: str
    w: int
    least: int | None = 1
    fill: float | None = None


class Frames:
    """The frames of w rows over n rows, as an end of a piece (`a`) and a beginning of the next (`b`)."""

    def __init__(self, n: int, w: int):
        self.n, self.w = n, w
        i = np.arange(n)
        low, high = np.maximum(i - w // 2, 0), np.minimum(i + (w + 1) // 2 - 1, n - 1)
        self.low, self.high, self.two = low, high, low // w != high // w
        self.begins = ~self.two & (low % w == 0)  # the frame is a beginning of a piece, or the whole

    def both(self, x: np.ndarray, neutral: float, run: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
        pieces = np.full((*x.shape[:-1], -(-self.n // self.w) * self.w), neutral)
        pieces[..., : self.n] = x
        parts = pieces.reshape(*x.shape[:-1], -1, self.w)
        ahead = run.accumulate(parts, axis=-1).reshape(pieces.shape)[..., self.high]
        back = run.accumulate(parts[..., ::-1], axis=-1)[..., ::-1].reshape(pieces.shape)[..., self.low]
        return np.where(self.begins, ahead, back), np.where(self.two, ahead, neutral)

    def total(self, x: np.ndarray) -> np.ndarray:
        a, b = self.both(x, 0.0, np.add)
        return a + b

    def moments(self, x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sum of squared differences from it, of the values among each frame's rows. Pieces are centred on their own means."""
        piece, count = np.arange(self.n) // self.w, -(-self.n // self.w)
        of = (piece + count * np.arange(x.size // max(1, self.n))[:, None]).ravel()
        sums = lambda v: np.bincount(of, v.ravel(), x.size // max(1, self.n) * count).reshape(*x.shape[:-1], count)
        size = sums(real)
        centre = sums(np.where(real, x, 0)) / np.maximum(size, 1)
        d = np.where(real, x - centre[..., piece], 0)
        parts = [self.both(v, 0.0, np.add) for v in (real.astype(float), d, d * d)]
        first, second = self.low // self.w, self.high // self.w
        (na, nb), (sa, sb), (qa, qb) = parts
        ma, mb = centre[..., first] + sa / np.maximum(na, 1), centre[..., second] + sb / np.maximum(nb, 1)
        spread = (qa - sa * sa / np.maximum(na, 1)) + (qb - sb * sb / np.maximum(nb, 1))
        n = np.maximum(na + nb, 1)
        gap = np.where((na > 0) & (nb > 0), mb - ma, 0)
        mean = np.where(na > 0, ma + gap * nb / n, mb)
        return mean, np.maximum(spread + gap * gap * na * nb / n, 0)


def rolled(x: np.ndarray, stat: str, w: int, least: int | None = 1, fill: float | None = None, frames: Frames | None = None) -> np.ndarray:
    """One statistic of one array; NaN where there is none."""
    frames = frames or Frames(x.shape[-1], w)
    real = ~np.isnan(x)
    count = frames.total(real.astype(float))
    need = np.full(x.shape, float(w if least is None else least))
    if stat == "count":
        out = count
    elif stat == "sum":
        out = frames.total(np.where(real, x, 0))
    elif stat == "max":
        out = np.maximum(*frames.both(np.where(real, x, -np.inf), -np.inf, np.maximum))
    elif stat == "min":
        out = np.minimum(*frames.both(np.where(real, x, np.inf), np.inf, np.minimum))
    elif stat == "mean":
        out = frames.moments(x, real)[0]
    elif stat == "std":
        out = np.sqrt(frames.moments(x, real)[1] / np.maximum(count - 1, 1))
        high = np.maximum(*frames.both(np.where(real, x, -np.inf), -np.inf, np.maximum))
        low = np.minimum(*frames.both(np.where(real, x, np.inf), np.inf, np.minimum))
        out = np.where(high == low, 0.0, out)  # no rounding error in a frame of equal values
        need = np.maximum(need, 2)
    elif stat == "median":
        apart = np.full((*x.shape[:-1], frames.n + w), np.nan)  # no frame reaches the next block
        apart[..., : frames.n] = x
        out = pd.Series(apart.ravel()).rolling(w, center=True, min_periods=1).median().to_numpy().reshape(apart.shape)[..., : frames.n]
    else:
        raise ValueError(f"no statistic {stat}")
    out = np.where(count >= np.maximum(need, 0 if stat == "count" else 1), out, np.nan)
    return out if fill is None else np.where(np.isnan(out), fill, out)


def rolling_table(df: DataFrame, specs: Sequence[Rolling], keys: Sequence[str] = ("series_id",), place: str = "step", rows: int = blocks.ROWS) -> DataFrame:
    """`df` with a column for each of `specs`. `place` numbers the rows of a series without gaps (`blocks.numbered` makes one)."""
    before, after = max(s.w // 2 for s in specs), max((s.w + 1) // 2 - 1 for s in specs)

    def made(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, frames = next(iter(x.values())).shape[-1], {}
        return {s.name: rolled(x[s.x], s.stat, s.w, s.least, s.fill, frames.setdefault(s.w, Frames(n, s.w))) for s in specs}

    return blocks.map_blocks(df, before, after, made, list(dict.fromkeys(s.x for s in specs)), [s.name for s in specs], keys, place, rows)
