"""Peak picking, and the greedy choice of events by expected gain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups
from .windows import local_maxima, ordered


def best_per_day(df: DataFrame, score: str, event: str, date: str = "date") -> DataFrame:
    n = F.row_number().over(Window.partitionBy("series_id", date).orderBy(F.desc(score), "step"))
    return df.withColumn("_n", n).where("_n = 1").select("series_id", "step", F.lit(event).alias("event"), F.col(score).alias("score"))


def suppress(rows: np.ndarray, scores: np.ndarray, distance: float) -> np.ndarray:
    """Which peaks stay: highest first, the later of equals, none nearer than `distance` rows to one that stays. rows ascend, so each peak that
    stays walks over its neighbours only."""
    keep, at, gap = [True] * len(rows), rows.tolist(), float(np.ceil(distance))
    for j in np.lexsort((rows, scores))[::-1].tolist():
        if keep[j]:
            for way in (-1, 1):
                k = j + way
                while 0 <= k < len(at) and abs(at[k] - at[j]) < gap:
                    keep[k] = False
                    k += way
    return np.array(keep, bool)


def maxima_of(df: DataFrame, cols: dict[str, str], height: float, step: str = "step") -> DataFrame:
    """series_id, event, step, score, row: local maxima of each event's column, from one scan of the series."""
    df = df.withColumn("_row", F.row_number().over(ordered(order=step)))  # before rows are multiplied
    each = F.array(*[F.struct(F.lit(e).alias("event"), F.col(c).cast("double").alias("score")) for e, c in cols.items()])
    long = df.select("series_id", step, F.col("_row").alias("row"), F.explode(each).alias("p")).select("series_id", "p.event", step, "p.score", "row")
    return local_maxima(long, "score", height, ["series_id", "event"], step)


def find_peaks(df: DataFrame, x: str, height: float, distance: float, step: str = "step") -> DataFrame:
    """series_id, step, score. Maxima are found by windows, so only they reach Python, many series a call."""
    numbered = df.select("series_id", step, F.col(x).cast("double").alias("score"), F.row_number().over(ordered(order=step)).alias("row"))
    maxima = local_maxima(numbered, "score", height, step=step)

    def thin(p: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        rows, scores = p["row"].to_numpy(), p["score"].to_numpy()
        kept = [a + np.flatnonzero(suppress(rows[a:z], scores[a:z], distance)) for a, z in spans]
        return p.iloc[np.concatenate(kept)][["series_id", step, "score"]]

    kinds = dict(df.dtypes)
    return map_groups(maxima, ["series_id"], ["row"], thin, f"series_id {kinds['series_id']}, {step} {kinds[step]}, score double")


def or_dummy(detections: DataFrame, keys: DataFrame) -> DataFrame:
    """A row at step 0 with score 0 for each (series_id, event) of `keys` without a detection."""
    missing = keys.join(detections, ["series_id", "event"], "left_anti").withColumns({"step": F.lit(0).cast("long"), "score": F.lit(0.0)})
    return detections.select("series_id", "event", "step", "score").unionByName(missing.select("series_id", "event", "step", "score"))


# Rows that a tolerance reaches on the nearer and on the farther side of a candidate
NEAR, FAR = (0, 1, 3, 5, 8, 10, 13, 15, 20, 25, 30), (0, 1, 3, 5, 7, 10, 12, 15, 20, 25, 30)
PHASES = ((3, NEAR, FAR), (9, FAR, NEAR))  # steps after the row, reach to the left (the row included), reach to the right


#: Gains are sums of predictions in units of 1 / UNIT, so that they are exact in any order; predictions reach up to MOST.
UNIT, MOST, FAN = 1 << 40, 1 << 13, 64


def expected(p: np.ndarray, first: np.ndarray, last: np.ndarray, power: np.ndarray, much: np.ndarray, phase: int) -> np.ndarray:
    """What rows give to the candidates of a phase through their levels (much, power]: row i of level j reaches the candidates from
    i - right[j] to i + left[j] - 1 of its chunk. Ranges are added as differences, one pass of sums makes them values."""
    _, left, right = PHASES[phase]
    diff = np.zeros(len(p) + 1, np.int64)
    i = np.arange(len(p))
    for j in range(1, len(left)):
        on = (j > much) & (j <= power)
        np.add.at(diff, np.maximum(i - right[j], first)[on], p[on])
        np.add.at(diff, np.minimum(i + left[j], last + 1)[on], -p[on])
    return np.cumsum(diff)[:-1]


class Tournament:
    """The greatest of n values and its first place, after changes of a few: each level holds the winners of FAN places of the one below."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN)))

    def changed(self, a: int, z: int) -> None:
        """The values from a to z - 1 have new values."""
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            a, z = a // FAN, (z - 1) // FAN + 1
            level[a:z] = np.maximum.reduceat(below[a * FAN : z * FAN], np.arange(0, len(below[a * FAN : z * FAN]), FAN))

    def best(self) -> int:
        at = 0
        for level in reversed(self.levels):
            at = at * FAN + int(level[at * FAN : (at + 1) * FAN].argmax()) if level is not self.levels[-1] else int(level.argmax())
        return at


def pick_events(p: np.ndarray, chunk: np.ndarray, height: float, limit: int | None = None) -> list[tuple[int, int, float]]:
    """(row, phase, gain), in order: again and again the candidate of most expected gain, of equals one of the second phase and then the first;
    rows it reaches keep only the levels they don't share with it. A pick changes gains near it alone. Without a limit all are picked that reach
    the height and gain something: a pick without gain changes nothing, so it would be picked for ever."""
    n, p = len(p), np.rint(p * UNIT).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    sizes = np.diff(np.r_[starts, n])
    first, last = np.repeat(starts, sizes), np.repeat(starts + sizes - 1, sizes)
    power, none = np.full(n, len(NEAR) - 1), np.zeros(n, int)
    trees = [Tournament(expected(p, first, last, power, none, k)) for k in (0, 1)]
    out, far = [], max(NEAR[-1], FAR[-1])
    while limit is None or len(out) < limit:
        tops = [t.best() for t in trees]
        gains = [int(t.levels[0][i]) for t, i in zip(trees, tops, strict=True)]
        k = 0 if gains[0] > gains[1] else 1
        at, (_, left, right) = tops[k], PHASES[k]
        if gains[k] / UNIT < height or limit is None and gains[k] <= 0:
            break
        out.append((at, k, gains[k] / UNIT))
        l, r = np.arange(min(left[-1], at + 1)), np.arange(1, min(right[-1], n - 1 - at) + 1)
        rows = np.r_[at - l, at + r]
        level = np.r_[np.searchsorted(left, l, side="right") - 1, np.searchsorted(right, r, side="left") - 1]
        a, z = max(0, int(rows.min()) - far), min(n, int(rows.max()) + far + 1)
        new = power[a:z].copy()
        new[rows - a] = np.minimum(new[rows - a], level)
        low, high = np.maximum(first[a:z] - a, 0), np.minimum(last[a:z] - a, z - a - 1)
        for q in (0, 1):
            trees[q].levels[0][a:z] -= expected(p[a:z], low, high, power[a:z], new, q)
            trees[q].changed(a, z)
        power[a:z] = new
    return out


#: Longest series that `pick_many` takes; rows before and behind a pick that change, and candidates that these reach.
SHORT, CHANGED = 2048, np.arange(1 - NEAR[-1], NEAR[-1] + 1)
LEVELS = np.array([np.where(CHANGED <= 0, np.searchsorted(left, -CHANGED, side="right"), np.searchsorted(right, CHANGED, side="left")) - 1 for _, left, right in PHASES])
BEFORE, WIDE = 2 * NEAR[-1] - 1, 4 * NEAR[-1]


def pick_many(p: np.ndarray, chunk: np.ndarray, begin: np.ndarray, height: float, limit: int | None = None) -> tuple[np.ndarray, ...]:
    """`pick_events` of many short series, one behind the other from the rows `begin` on: row, phase and gain of the picks, in order in each series.
    A round takes the next pick of every series that still has one."""
    n, p, end = len(p), np.rint(p * UNIT).astype(np.int64), np.append(begin[1:], len(p))
    new = np.r_[True, chunk[1:] != chunk[:-1]]
    new[begin] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, n])
    first, last = np.repeat(starts, sizes), np.repeat(starts + sizes - 1, sizes)
    power, none = np.full(n, len(NEAR) - 1), np.zeros(n, int)
    values = [expected(p, first, last, power, none, k) for k in (0, 1)]
    live, out, rounds = np.arange(len(begin)), [(np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0))], 0
    while len(live) and (limit is None or rounds < limit):
        tops, gains = [], []
        for v in values:
            most = np.maximum.reduceat(v, begin)
            hits = np.flatnonzero(v == np.repeat(most, end - begin))
            tops.append(hits[np.searchsorted(hits, begin[live])])
            gains.append(most[live])
        k = np.where(gains[0] > gains[1], 0, 1)
        at, gain = np.where(k == 0, *tops), np.where(k == 0, *gains) / UNIT
        on = ~(gain < height) & (limit is not None or gain > 0)
        live, at, k, gain = live[on], at[on], k[on], gain[on]
        out.append((live, at, k, gain))
        rounds += 1
        rows = at[:, None] + CHANGED
        inside = (rows >= begin[live, None]) & (rows < end[live, None])
        old = power[np.where(inside, rows, 0)]
        changed = inside & (LEVELS[k] < old)
        series, i, high, low = np.nonzero(changed)[0], rows[changed], old[changed], LEVELS[k][changed]
        power[i] = low
        times = high - low  # a row gives its levels back one by one
        each = np.repeat(np.arange(len(i)), times)
        j = low[each] + 1 + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        i, series, base = i[each], series[each], at - BEFORE
        for v, (_, left, right) in zip(values, PHASES, strict=True):
            diff = np.zeros((len(at), WIDE + 1), np.int64)
            np.add.at(diff, (series, np.maximum(i - np.array(right)[j], first[i]) - base[series]), p[i])
            np.add.at(diff, (series, np.minimum(i + np.array(left)[j], last[i] + 1) - base[series]), -p[i])
            less = np.cumsum(diff, axis=1)
            where = np.nonzero(less)
            v[base[where[0]] + where[1]] -= less[where]
    series, at, k, gain = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(series, kind="stable")
    return at[order], k[order], gain[order]


def greedy_events(df: DataFrame, cols: dict[str, str], height: float = 0.001, limit: int | None = None, chunk: str = "chunk_id") -> DataFrame:
    """series_id, event, step, score of each event's prediction column, all that reach the height, or the first `limit` of a series. A series is one group: a pick takes levels
    from its neighbours beyond a chunk's border, too. Many series pass in one call, the short ones in rounds; in a long one each pick costs its reach and one path of the tree."""
    each = F.array(*[F.struct(F.lit(e).alias("event"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("p")) for e, c in cols.items()])
    told = F.lit("a prediction is too great for exact gains").cast("string")
    value = F.when(F.col("e.p") > MOST, F.raise_error(told).cast("double")).otherwise(F.col("e.p"))
    long = df.select("series_id", F.col(chunk).cast("long").alias("chunk"), F.col("step").cast("long").alias("step"), F.explode(each).alias("e")).select("series_id", "e.event", "chunk", "step", value.alias("p"))

    def pick(rows: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        p, step, chunks = rows["p"].to_numpy(), rows["step"].to_numpy(), rows["chunk"].to_numpy()
        found = [(a + i, k, gain) for a, z in spans if z - a > SHORT for i, k, gain in pick_events(p[a:z], chunks[a:z], height, limit)]
        at, phase, gain = (np.array([x[i] for x in found], kind) for i, kind in ((0, int), (1, int), (2, float)))
        if short := [(a, z) for a, z in spans if z - a <= SHORT]:
            own = np.concatenate([np.arange(a, z) for a, z in short])
            many = pick_many(p[own], chunks[own], np.cumsum([0, *[z - a for a, z in short[:-1]]]), height, limit)
            at, phase, gain = np.append(at, own[many[0]]), np.append(phase, many[1]), np.append(gain, many[2])
        own = rows.iloc[at]
        return pd.DataFrame({"series_id": own["series_id"], "event": own["event"], "step": step[at] + np.array([x for x, _, _ in PHASES])[phase], "score": gain})

    kind = dict(df.dtypes)["series_id"]
    return map_groups(long, ["series_id", "event"], ["chunk", "step"], pick, f"series_id {kind}, event string, step long, score double")
