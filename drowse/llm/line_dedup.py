"""Near-duplicate lines by a segment-partition edit join.

Lines with a letter or a digit are compared, whatever their length; two are alike if they are equal or if their edit distance is at most
the budget of the shorter one: no edit below LEAST characters, one below 2 * LEAST, then 2 or a SHAREth of the characters, however many. A
line has one segment more than its class of lengths has edits, all of one size, so two alike lines share a whole segment, shifted by no more
than their edits allow. A class is the lengths of one budget, and from WIDE edits on a 16th more than its least length, so that a line's
keys stay in proportion to its characters. From FEW edits on a substring is named by the least hash of its parts of half its length:
equal substrings have equal names, and neighbours share one, so a line has few. A hash tells which segment it is of, so lines that have a
passage in common at different places do not meet. Each line leaves the hashes of its segments (with the budget) and of its substrings at which a shorter or equal
line's segments can stand. Lines that share a hash are verified on their whole length by a banded bit-parallel edit distance, many pairs
at once inside the group in words of 64 bits, and few pairs, or those of more than WIDE edits, each in one long integer: pairs are never emitted, only a line that has an earlier alike.

Which keys several lines have, and which lines have such a key, is found first, from pairs of hashes, and only those keys leave their lines.
Lines of a key are then parted by their lengths and by how often characters of 16 classes occur, which a few edits change little: a line
that no pair links to another goes no further, and its text is not moved.

Hot segments: a group of more than GROUP lines or CHARS characters is split by length, since alike lines differ by a SHAREth at most, and what is
still larger is worked as pairs of blocks. Groups are dealt in PASSES parts of the keys, so that only one part's lines are on disk at a time.

A line goes if an earlier one is equal or alike; earlier is by document id (null first), then by text hash, then by place. So the first
stays, and its shorter or longer forms too if they have no earlier alike. Each task leaves a line's hashes once however often it
occurs, and exact repeats are counted by hash, so a line that fills a third of the corpus is no hot key. Lines without a letter or a
digit (empty ones, rules, brackets) always stay.

A null text has no lines and stays null; an empty one has one empty line, which stays. Rows that repeat both id and text are the same
document and fare alike; rows that share an id but not a text are two documents. A very long text is as many rows as it has lines; a
very long line is one row. An empty table gives an empty result. All columns of the input pass, under any names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drowse.sources.shared import tidy

from .common import bitmap, content_key, discard, frames, marked, materialize, renamed, slices, table, whole_groups

#: The budget: LEAST characters for one edit, one for each SHARE characters from 2 * LEAST on; edits that a 64-bit word's band holds.
LEAST, SHARE, WIDE = 20, 32, 31
BLOCKS = 16  # blocks of segments whose keys differ, about: with one for each segment, keys of very long lines would outgrow their characters
FEW = 3  # edits from which a substring is named by the least hash of its parts of half its size
GROUP, CHARS = 1024, 1 << 22  # lines and characters of a block
RUN, FLUSH, RANGE = 1 << 18, 1 << 20, 1 << 24  # characters hashed at a time, keys sorted at a time, characters whose keys make a range
PAIRS, HELD = 4096, 1 << 18  # pairs verified at a time; those that may wait for it
SINGLE = 256  # pairs below which each goes alone
PASSES = 4  # parts of the keys whose lines are shuffled one after the other
WIDTH = 28  # a bitmap of keys or lines has 2 ** WIDTH bits, 32 MB
NAMED = 64  # pieces that a bitmap of lines is made in
STORED = {"compression": "zstd"}
PRIME = np.uint64(0xC2B2AE3D27D4EB4F)
DOC = ["id", "t1", "t2"]


def budget(length: int) -> int:
    return 0 if length < LEAST else 1 if length < 2 * LEAST else max(2, length // SHARE)


@lru_cache(maxsize=1)
def classes() -> list[tuple[int, int, int]]:
    """The greatest budget, and the least and greatest length of each class."""
    out, n = [(1, LEAST, 2 * LEAST - 1), (2, 2 * LEAST, 3 * SHARE - 1)], 3 * SHARE
    while n < 1 << 40:
        upto = n + (SHARE if n < SHARE * (WIDE + 1) else n // 16)
        out.append((budget(upto - 1), n, upto - 1))
        n = upto
    return out


@lru_cache(maxsize=64)
def _places(k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segments can stand in a line that is alike, and the number of the segment (of its block of segments from 2 * BLOCKS edits on).

    Of two alike lines, some segment i of the shorter one is whole and has exactly i edits before it, so at most k - i after it: it
    stands in the longer one shifted by -min(i, k - i) to i."""
    i = np.arange(k + 1)
    block = i // max(1, k // BLOCKS)
    low, high = i * size - np.minimum(i, k - i), i * size + i + 1
    low[1:] = np.where(block[1:] == block[:-1], np.maximum(low[1:], high[:-1]), low[1:])  # each place of a block once
    widths = high - low
    return np.repeat(low - np.cumsum(widths) + widths, widths) + np.arange(widths.sum()), np.repeat(block, widths).astype(np.uint64)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    n, base = 1 << n.bit_length(), 0xD6E8FEB86659FD93
    _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (base, pow(base, -1, 2**64))]


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of segments and of substrings that may be those of an alike line, and the number of the line of each."""
    by_length = np.argsort(np.array([len(x) for x in lines], np.int64), kind="stable")
    lines = [lines[i] for i in by_length.tolist()]  # so that the lines of a class are one run of characters
    lengths = np.array([len(x) for x in lines], np.int64)
    offsets = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) * PRIME
    codes ^= codes >> np.uint64(29)
    if len(codes) >= len(_POWERS[0]):
        _grow(len(codes) + 1)
    up, down = _POWERS
    sums = np.zeros(len(codes) + 1, np.uint64)
    codes *= up[: len(codes)]
    np.cumsum(codes, out=sums[1:])

    keys, names = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    longest = int(lengths.max(initial=0))
    for k, least, greatest in classes():
        if least > longest:
            break
        size = least // (k + 1)
        a, z = np.searchsorted(lengths, [least, greatest + k + 1]).tolist()
        if a == z:
            continue
        at, block = _places(k, size)
        part = size if k < FEW else (size + 1) // 2
        first, end = int(offsets[a]), int(offsets[z - 1] + lengths[z - 1]) - part + 1
        h = sums[first + part : end + part] - sums[first:end]  # prefix sums of a polynomial, moved to one power
        h *= down[first:end]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        if k >= FEW:  # a substring's name is the least hash of its parts, which its neighbours mostly share
            h = _least_of(h, size - part + 1)
        h = h.take((offsets[a:z, None] - first) + at, mode="clip")
        new = at <= lengths[a:z, None] - size
        if k >= FEW:
            new[:, 1:] &= (h[:, 1:] != h[:, :-1]) | (block[1:] != block[:-1]) | ~new[:, :-1]
        found = np.flatnonzero(new)
        owner = found // len(at)
        h, of = h.ravel()[found], block[found - owner * len(at)]
        h = (h ^ h >> np.uint64(32) ^ (of << np.uint64(32) | np.uint64(k)) * PRIME) * np.uint64(0x9E3779B97F4A7C15)
        keys.append((h ^ h >> np.uint64(29)).view(np.int64))
        names.append(by_length[a:z][owner])
    return np.concatenate(keys), np.concatenate(names)


def _least_of(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place on; fewer at the end."""
    out, have = x.copy(), 1
    while have < w:
        by = min(have, w - have)
        out[: len(out) - by] = np.minimum(out[: len(out) - by], out[by:])
        have += by
    return out


def within(a: list[str], b: list[str], edits: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its `edits`. Bit t of a column's vectors is the cell on diagonal t - k of a band of
    2k + 1 diagonals; they hold where values rise and fall along the column, and all pairs take a column at a time."""
    out = np.zeros(len(a), bool)
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    for i in np.flatnonzero((edits > WIDE) & (np.abs(n - m) <= edits)).tolist():
        out[i] = _banded_long(*_trimmed(a[i], b[i]), int(edits[i]))
    order = np.argsort(m, kind="stable")
    order = order[edits[order] <= WIDE]
    for part in (order[i : i + PAIRS] for i in range(0, len(order), PAIRS)):
        part = part[np.abs(n[part] - m[part]) <= edits[part]]
        if len(part) < SINGLE:  # a column costs many pairs no more than few
            out[part] = [_banded_long(*_trimmed(a[i], b[i]), k) for i, k in zip(part.tolist(), edits[part].tolist(), strict=True)]
        else:
            cut = [_trimmed(a[i], b[i]) for i in part]
            out[part] = _banded([x for x, _ in cut], [y for _, y in cut], edits[part].astype(np.int64))
    return out


def _grid(lines: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(lines), width), fill, np.uint32)
    for i, x in enumerate(lines):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), "<u4")
    return out


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Without their common beginning and end."""
    n = len(commonprefix((a, b)))
    a, b = a[n:][::-1], b[n:][::-1]
    n = len(commonprefix((a, b)))
    return a[n:], b[n:]


def _banded(a: list[str], b: list[str], edits: np.ndarray) -> np.ndarray:
    k = int(edits.max())
    n, m = (np.array([len(x) + k for x in side], np.int64) for side in (a, b))  # both begin with k equal characters, so the band starts inside the table
    pad, start = np.full((len(a), k), 0xFFFFFFFF, np.uint32), np.full((len(a), k), 0xFFFFFFFE, np.uint32)
    x = np.concatenate([pad, start, _grid(a, int(max(n.max(), m.max())) + k, 0xFFFFFFFF)], axis=1)
    y = np.concatenate([start, _grid(b, int(m.max()) - k, 0xFFFFFFFD)], axis=1)
    bits, one = np.uint64(1) << np.arange(2 * k + 1, dtype=np.uint64), np.uint64(1)
    full = np.uint64((1 << (2 * k + 1)) - 1)
    up, down = np.full(len(a), full >> np.uint64(k) << np.uint64(k), np.uint64), np.zeros(len(a), np.uint64)
    distance, out, live = np.full(len(a), k, np.int64), np.zeros(len(a), bool), np.arange(len(a))
    for j in range(y.shape[1]):
        same = ((x[:, j : j + 2 * k + 1] == y[:, j, None]) * bits).sum(1, dtype=np.uint64)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (~(diagonal | up) & full), diagonal & up
        # the distance follows the band's lowest diagonal down to the last row, then that row
        sinking = j + k < n
        bit = np.clip(n - 1 - j + k, 0, 2 * k).astype(np.uint64)
        distance += np.where(sinking, 1 - (diagonal >> np.uint64(2 * k)).astype(np.int64), (right >> bit & one).astype(np.int64) - (left >> bit & one).astype(np.int64))
        up, down = (left | ~((diagonal >> one) | right)) & full, (diagonal >> one) & right
        ended = m == j + 1
        out[live[ended]] = distance[ended] <= edits[ended]
        if ended.any() or j % 16 == 15:
            stay = ~ended & (distance - np.where(sinking, m - n + k, m - j - 1) <= edits)
            live, x, y, n, m, edits, distance, up, down = (v[stay] for v in (live, x, y, n, m, edits, distance, up, down))
            if not len(live):
                break
    return out


def _banded_long(a: str, b: str, k: int) -> bool:
    """As `_banded`, for one pair and a band of any width: its vectors are integers of 2k + 1 bits."""
    n, m, full = len(a) + k, len(b) + k, (1 << (2 * k + 1)) - 1
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    at = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") << 2 * k for c in set(b)}  # places of each character in k fillers, k equal characters and a
    start = ((1 << k) - 1) << k
    up, down, distance = full >> k << k, 0, k
    for j in range(m):
        same = ((start if j < k else at[b[j - k]]) >> j) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (~(diagonal | up) & full), diagonal & up
        if j + k < n:
            distance += 1 - (diagonal >> 2 * k & 1)
        else:
            bit = n - 1 - j + k
            distance += (right >> bit & 1) - (left >> bit & 1)
        up, down = (left | ~((diagonal >> 1) | right)) & full, (diagonal >> 1) & right
        if j % 64 == 63 and distance - (m - n + k if j + k < n else m - j - 1) > k:
            return False
    return distance <= k


def _counts(lines: list[str]) -> np.ndarray:
    """Characters of each line, counted in 32 classes: an edit changes at most two counts by one."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.int64) % 32
    of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(of * 32 + codes, minlength=32 * len(lines)).reshape(-1, 32).astype(np.int32)


def _too_far(a: np.ndarray, b: np.ndarray, lines: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs differ by more than `most` edits, told by the counts of what is before and behind a place of both: edits before it change the counts
    of as many characters from the beginning by two each at most, those behind it the counts of as many from the end."""
    out = np.zeros(len(a), bool)
    for x in np.unique(short := np.minimum([len(lines[i]) for i in a.tolist()], [len(lines[i]) for i in b.tolist()]) // 64):
        own = np.flatnonzero(short == x)
        used, at = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
        size, texts = max(1, int(x) * 16), [lines[i] for i in used.tolist()]  # a quarter of the shorter line, about
        left = [_counts([t[i * size : (i + 1) * size] for t in texts]) for i in range(3)]
        right = [_counts([t[len(t) - (i + 1) * size : len(t) - i * size] for t in texts]) for i in range(3)]
        left, right = np.cumsum(left, axis=0), np.cumsum(right, axis=0)
        i, j = at[: len(own)], at[len(own) :]
        for n in range(3):
            out[own] |= np.abs(left[n][i] - left[n][j]).sum(1) + np.abs(right[2 - n][i] - right[2 - n][j]).sum(1) > 2 * most[own]
    return out


def _smaller_keys(key: np.ndarray, group: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each line: which keys below its group's it has, of those that several lines of the group have."""
    line, all_ = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys)
    below = all_ < key[line]
    line, all_ = line[below], all_[below]
    order = np.lexsort((all_, group[line]))
    line, all_ = line[order], all_[order]
    of = group[line]
    new = np.r_[True, (all_[1:] != all_[:-1]) | (of[1:] != of[:-1])][: len(all_)]
    several = ~(new & np.r_[new[1:], True][: len(new)])
    line, of, new = line[several], of[several], new[several]
    number = np.cumsum(new)
    bit = number - number[np.searchsorted(of, of)]
    out = np.zeros((len(keys), int(bit.max(initial=0)) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (line, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def have_earlier(rows: pd.DataFrame, known: set[int]) -> np.ndarray:
    """Whether each line (h1, line, key, keys, part, cross, and group: a number) has an earlier alike in its group; in a pair of blocks, in the
    other block. Rows are in order by group, then place. Lines in `known` have one already. A pair is looked at in the group of the least
    key that it shares."""
    lines, group, part, cross = rows["line"].tolist(), rows["group"].to_numpy(), rows["part"].to_numpy(), rows["cross"].to_numpy()
    before = _smaller_keys(rows["key"].to_numpy(), group, rows["keys"].tolist())
    sizes, counts = np.array([len(x) for x in lines]), _counts(lines)
    edits, out = np.array([budget(n) for n in sizes.tolist()]), np.array([h in known for h in rows["h1"].tolist()])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        """Each line with the earlier one whose characters are most like its own, then with the others if it must."""
        if not found:
            return
        a, b, apart = (np.concatenate(side) for side in zip(*found, strict=True))
        found.clear()
        near = ~_too_far(a, b, lines, np.minimum(edits[a], edits[b]))
        a, b, apart = a[near], b[near], apart[near]
        order = np.lexsort((apart, b))
        a, b = a[order], b[order]
        turn = np.arange(len(b)) - np.searchsorted(b, b)
        at = 0
        while len(b):
            now = turn < 2**at
            hit = within([lines[i] for i in a[now]], [lines[i] for i in b[now]], np.minimum(edits[a[now]], edits[b[now]]))
            out[b[now][hit]] = True
            left = ~now & ~out[b]
            a, b, turn, at = a[left], b[left], turn[left], at + 1

    later = np.flatnonzero(~out)
    for d in range(1, len(lines)):  # each line with the d-th before it
        later = later[later >= d]
        later = later[(group[later] == group[later - d]) & ~out[later]]
        if not len(later):
            break
        b = later[~cross[later] | (part[later] != part[later - d])]
        a = b - d
        most = np.minimum(edits[a], edits[b])
        near = np.abs(sizes[a] - sizes[b]) <= most
        a, b, most = a[near], b[near], most[near]
        near = ~(before[a] & before[b]).any(1)
        a, b, most = a[near], b[near], most[near]
        apart = np.abs(counts[a] - counts[b]).sum(1)
        near = apart <= 2 * most
        if near.any():
            found.append((a[near], b[near], apart[near] / most[near]))
            if sum(len(x) for x, *_ in found) >= HELD:
                settle()
    settle()
    return out


def compared(line: Column) -> Column:
    return line.rlike(r"[\p{L}\p{N}]")


def line_hashes(docs: DataFrame) -> DataFrame:
    """id, t1, t2, pos, line, h1, h2 of each line that is compared; docs as `renamed`."""
    rows = docs.select("id", F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(compared(F.col("line"))).select("id", "t1", "t2", "pos", "line", *content_key("line"))


SECOND = xxhash.xxh64_intdigest("second", 42)  # the seed of a content key's second hash


def keys_of(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """Keys and the number of the line of each, and the lines and their h1; a line once a task. wanted: a bitmap by the first bits of h1."""
    seen: set[int] = set()
    for b in slices(batches):
        lines, names = [], []
        for t in b.column(0).to_pylist():
            for line in (t or "").split("\n"):
                if len(line) >= LEAST and (h := xxhash.xxh64_intdigest(line.encode(), 42)) not in seen:  # Spark's xxhash64
                    seen.add(h)
                    lines.append(line)
                    names.append(h)
        hashes = np.array(names, np.uint64)
        if wanted is not None:
            own = np.flatnonzero(_has(wanted, hashes))
            lines, hashes = [lines[i] for i in own.tolist()], hashes[own]
        ends, at = np.cumsum([0, *map(len, lines)]), 0
        while at < len(lines):  # runs of RUN characters, or of one line
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN, side="right")) - 1)
            keys, owner = line_keys(lines[at:to])
            yield keys, owner, lines[at:to], hashes[at:to]
            at = to


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes have their bit in a bitmap of 2 ** WIDTH bits by their first bits."""
    slot = (hashes >> np.uint64(64 - WIDTH)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _packed(pairs: np.ndarray) -> bytes:
    """Sorted pairs of a key and a line's name, 32 bits each: steps of the keys by their bytes, the highest of which are mostly 0, and the names."""
    keys = (pairs >> np.uint64(32)).astype(np.uint32)
    return np.diff(keys, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() + pairs.astype(np.uint32).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 8
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(32) | np.frombuffer(data, np.uint32, n, 4 * n)


def _distinct(sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.r_[True, sorted_[1:] != sorted_[:-1]][: len(sorted_)]]


def keys_twice(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of 2 ** WIDTH bits: by the first bits of a key, whether several lines have a key there, and by the first bits of a line's h1,
    whether a line there has such a key. Each task leaves pairs of a key and a line, sorted and split into ranges that follow the corpus' size;
    each range is merged and leaves its piece of the first bitmap and its bits of the pieces of the second."""
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    width = min(WIDTH - 3, max(0, math.ceil(math.log2(max(1, size / RANGE)))))
    bits = 32 + width

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for keys, owner, _, names in keys_of(batches):
            keys = keys.view(np.uint64) >> np.uint64(64 - bits)
            held.append(((keys >> np.uint64(32)).astype(np.uint16 if width <= 16 else np.uint32), keys << np.uint64(32) | (names >> np.uint64(32))[owner]))
            if sum(len(k) for k, _ in held) >= FLUSH:
                yield ranges(held)
                held = []
        if held:
            yield ranges(held)

    def ranges(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        of, pairs = (np.concatenate(side) for side in zip(*held, strict=True))
        order = np.argsort(of, kind="stable")
        of, pairs = of[order], pairs[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])[: len(of)].tolist()
        rows = [(int(of[a]), _packed(_distinct(np.sort(pairs[a:z])))) for a, z in zip(starts, [*starts[1:], len(of)], strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), pa.binary()], strict=True)], ["range", "pairs"])

    def merge(of: tuple, p: pd.DataFrame) -> pd.DataFrame:
        pairs = np.concatenate([_unpacked(x) for x in p["pairs"]])
        pairs.sort()
        pairs = _distinct(pairs)
        keys = (pairs >> np.uint64(32)).astype(np.uint32)
        again = keys[1:] == keys[:-1]
        pairs = pairs[np.r_[again, False] | np.r_[False, again]]
        piece = np.zeros(1 << (WIDTH - width), np.uint8)
        piece[(pairs >> np.uint64(32 + bits - WIDTH)).astype(np.int64)] = 1
        slots = _distinct(np.sort(pairs.astype(np.uint32) >> np.uint32(32 - WIDTH)))
        cuts = np.searchsorted(slots, np.arange(NAMED + 1) << (WIDTH - NAMED.bit_length() + 1)).tolist()
        rows = [(0, of[0], zlib.compress(np.packbits(piece).tobytes(), 1))]
        rows += [(1, i, slots[a:z].tobytes()) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < z]
        return pd.DataFrame(rows, columns=["kind", "part", "data"])

    def joined(of: tuple, p: pd.DataFrame) -> pd.DataFrame:
        if of[0] == 0:
            return p
        piece = np.zeros((1 << WIDTH) // NAMED, np.uint8)
        for x in p["data"]:
            piece[np.frombuffer(x, np.uint32) % len(piece)] = 1
        return pd.DataFrame({"kind": [1], "part": [of[1]], "data": [zlib.compress(np.packbits(piece).tobytes(), 1)]})

    out = np.zeros((1 << width, 1 << (WIDTH - width - 3)), np.uint8), np.zeros((NAMED, (1 << (WIDTH - 3)) // NAMED), np.uint8)
    schema = "kind int, part long, data binary"
    with tidy(docs.sparkSession):
        pieces = docs.select("text").mapInArrow(sort, "range long, pairs binary").groupBy("range").applyInPandas(merge, schema)
        rows = pieces.groupBy("kind", "part").applyInPandas(joined, schema).collect()  # twice 2 ** WIDTH bits in all
    for r in rows:
        out[r["kind"]][r["part"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out[0].ravel(), out[1].ravel()


def sketches(lines: list[str]) -> np.ndarray:
    """How often characters of 16 classes occur, modulo 256, as the bytes of two numbers: k edits change them by 2k at most in all, one less for each that
    changes the length."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4") & np.uint32(15)
    of = np.repeat(np.arange(len(lines)) * 16, [len(x) for x in lines])
    return np.bincount(of + codes, minlength=16 * len(lines)).astype(np.uint8).view(np.int64).reshape(-1, 2)


def line_keys_twice(docs: DataFrame) -> DataFrame:
    """key, h1, h2, size and the sketch s1, s2 (of the line) and line of keys that several lines may have; line with the first key of each line of a task only, else null."""
    bits = docs.sparkSession.sparkContext.broadcast(keys_twice(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, wanted = bits.value
        for keys, owner, lines, names in keys_of(batches, wanted):
            kept = _has(twice, keys.view(np.uint64))
            keys, owner = keys[kept], owner[kept]
            order = np.argsort(owner, kind="stable")
            keys, owner = keys[order], owner[order]
            first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
            second = {i: xxhash.xxh64_intdigest(lines[i].encode(), SECOND) for i in owner[first].tolist()}
            h2 = np.array([second[i] for i in owner.tolist()], np.uint64).view(np.int64)
            text = pa.array([lines[i] if f else None for i, f in zip(owner.tolist(), first.tolist(), strict=True)], pa.string())
            sizes = np.array([len(x) for x in lines], np.int32)[owner]
            sketch = sketches(lines)[owner]
            columns = [pa.array(x) for x in (keys, names[owner].view(np.int64), h2, sizes, sketch[:, 0], sketch[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, text], ["key", "h1", "h2", "size", "s1", "s2", "line"])

    return docs.select("text").mapInArrow(run, "key long, h1 long, h2 long, size int, s1 long, s2 long, line string")


def may_be_alike(group: np.ndarray, sizes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Rows, in order by group, that are linked: by pairs of a group whose lengths and sketches are near enough for the edits allowed. Gives the first row that
    each is linked to, itself if to none before it."""
    first, counts = np.arange(len(group)), sketch.view(np.uint8)
    edits = np.where(sizes < LEAST, 0, np.where(sizes < 2 * LEAST, 1, np.maximum(2, sizes // SHARE)))
    behind = np.searchsorted(group, group, side="right") - np.arange(len(group)) - 1
    left, d = np.flatnonzero(behind), 1
    while len(left):  # each with the d-th after it
        a = left[first[left] != first[left + d]]
        b = a + d
        apart, most = np.abs(sizes[a] - sizes[b]), np.minimum(edits[a], edits[b])
        near = apart <= most
        a, b, apart, most = a[near], b[near], apart[near], most[near]
        change = counts[a] - counts[b]
        near = np.minimum(change, -change).sum(1, dtype=np.int64) <= 2 * most - apart
        a, b = a[near], b[near]
        while len(a):
            x, y = first[a], first[b]
            np.minimum.at(first, np.maximum(x, y), np.minimum(x, y))
            while (first != (up := first[first])).any():
                first = up
            apart = first[a] != first[b]
            a, b = a[apart], b[apart]
        d += 1
        left = left[behind[left] >= d]
    return first


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def lines_met(found: DataFrame) -> DataFrame:
    """key, h1, h2, size, and n, chars and a hash of the lines that meet there: lines of a key are parted into those that pairs which may be alike link, each
    part with a key of its own, and those alone are left out. Lines of a hot key are all left, with n = 0 and perhaps more than once."""
    group, most = GROUP, CHARS
    names = ["key", "h1", "h2", "size", "n", "chars", "set"]

    def told(key: np.ndarray, h1: np.ndarray, h2: np.ndarray, size: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        more = more or (np.zeros(len(key), np.int32), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, h1, h2, size, *more)], names)

    def once(rows: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((rows[2], rows[1], rows[0]))
        rows = [x[order] for x in rows]
        new = np.ones(len(order), bool)
        new[1:] = reduce(np.logical_or, [x[1:] != x[:-1] for x in rows[:3]])
        return [x[new] for x in rows]

    def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        return np.cumsum(new) - 1, np.flatnonzero(new)

    def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = once(rows)
        of, starts = numbered(rows[0])
        hot = ((np.bincount(of) > group) | (np.add.reduceat(rows[3].astype(np.int64), starts) > most))[of]
        if hot.any():
            yield told(*[x[hot] for x in rows[:4]])
        rows = [x[~hot] for x in rows]
        first = may_be_alike(numbered(rows[0])[0], rows[3].astype(np.int64), np.stack(rows[4:], axis=1))
        linked = np.bincount(first, minlength=len(first))[first] > 1
        order = np.argsort(first[linked], kind="stable")
        key, h1, h2, size = (x[linked][order] for x in rows[:4])
        of, starts = numbered(first[linked][order])
        if not len(starts):
            return
        part = _mixed(h1[starts].view(np.uint64) ^ key[starts].view(np.uint64) * PRIME)
        lines = np.bitwise_xor.reduceat(_mixed(h1.view(np.uint64) ^ h2.view(np.uint64) * PRIME), starts)
        chars = np.add.reduceat(size.astype(np.int64), starts)
        yield told(part[of], h1, h2, size, np.bincount(of).astype(np.int32)[of], chars[of], lines[of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        hot = None  # a key whose lines go on as they come
        for b in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(rows[0]):
                continue
            if hot is not None:
                own = int(np.searchsorted(rows[0], hot, side="right"))
                if own:
                    yield told(*[x[:own] for x in rows[:4]])
                if own == len(rows[0]):
                    continue
                rows, hot = [x[own:] for x in rows], None
            if held is not None:
                rows = [np.concatenate(side) for side in zip(held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from whole([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > 8 * group:
                held = once(held)
                if len(held[0]) > group or int(held[3].sum(dtype=np.int64)) > most:
                    hot = held[0][0]
                    yield told(*held[:4])
                    held = None
        if held is not None:
            yield from whole(held)

    dealt = found.select("key", "h1", "h2", "size", "s1", "s2").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, h1 long, h2 long, size int, n int, chars long, set long")


def shared_keys(found: DataFrame) -> DataFrame:
    """key, h1, h2, and n and chars of the n lines that meet at a key because they may be alike; of keys at which the same lines meet, one. A key whose
    lines all have the same other key as their largest one is left out: its pairs meet there. found: of `line_keys_twice`."""
    met = materialize(lines_met(found), "shared-segments", **STORED)
    # each line of a set sees the same keys of it
    once = met.where("n > 0").groupBy("h1", "h2", "n", "chars", "set").agg(F.min("key").alias("key")).select("key", "h1", "h2", F.col("n").cast("long").alias("n"), "chars")
    some = met.where("n = 0").select("key", "h1", "h2", "size").distinct()
    sets = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"), F.bit_xor("h1").alias("x"), F.bit_xor(F.xxhash64("h1", F.lit(1))).alias("y"))
    hot = some.drop("size").join(sets.groupBy("n", "chars", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "chars"), "key")
    out = materialize(once.unionByName(hot), "shared-once", **STORED)
    discard(met)
    small = out.where(cold(F.col("n"), F.col("chars")))
    largest = small.groupBy("h1", "h2").agg(F.max(F.struct("n", "key")).alias("top")).select("h1", "h2", "top.key")
    tops = small.select("key", "h1", "h2").join(largest.withColumnRenamed("key", "top"), ["h1", "h2"])
    inside = tops.groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low = high AND low <> key").select("key")
    # named so that of the keys which two lines share, the one of most lines is the first: there a line meets most of its pairs at once
    name = F.shiftleft(F.lit(1023) - F.least(F.col("n"), F.lit(1023)), 53).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 53) - 1)))
    kept = materialize(out.join(inside, "key", "left_anti").withColumn("key", name), "shared-largest", **STORED)
    discard(out)
    return kept


def cold(n: Column, chars: Column) -> Column:
    """Whether lines that share a key are one group."""
    return (n <= GROUP) & (chars <= CHARS)


def groups(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """key, cell, lo, hi (blocks), part and the line's columns: all lines of a key, or of a hot one those of two neighbouring cells of
    lengths, in pairs of blocks. A line of a hot key is in its own cell's group and in that of the cell below it. Texts with the columns keys
    and hot have their other groups with them; `shared` then needs the hot keys only."""
    zero, small, held = F.lit(0), cold(F.col("n"), F.col("chars")), "hot" in texts.columns
    none = [zero.alias(c) for c in ("cell", "lo", "hi", "part")]
    if held:
        whole = texts.select(F.explode(F.array_except("keys", "hot")).alias("key"), *none, *[c for c in texts.columns if c != "hot"])
        texts = texts.drop("hot")
    else:
        whole = shared.where(small).select("key", "h1", "h2", *none)
    size = F.length("line")
    # lengths of alike lines differ by two up to 3 * SHARE characters, from there by a SHAREth: by one cell at most
    own = F.when(size < 3 * SHARE, F.floor(size / 3)).otherwise(SHARE + F.floor(F.log(size / (3 * SHARE)) / math.log((1 + 1 / SHARE) * (1 + 1e-9))))
    hot = shared.where(~small).join(texts.select("h1", "h2", own.cast("int").alias("own"), size.alias("size")), ["h1", "h2"])
    hot = hot.select("key", "h1", "h2", "size", F.explode(F.when(F.col("own") > 0, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))).alias("cell"))
    sizes = hot.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("lines"), F.sum("size").alias("chars")).where("lines > 1")
    hot = hot.join(sizes.select("key", "cell", F.ceil(F.greatest(F.col("lines") / GROUP, F.col("chars") / CHARS)).cast("int").alias("parts")), ["key", "cell"])
    hot = hot.withColumns({"part": F.pmod(F.xxhash64("h2"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(zero, F.col("parts") - 1))})
    hot = hot.select("key", "h1", "h2", "cell", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part")
    return whole.unionByName(hot.join(texts, ["h1", "h2"])) if held else whole.unionByName(hot).join(texts, ["h1", "h2"])


def judge(docs: DataFrame) -> DataFrame:
    """id, t1, t2, exact and near: places of the lines that go, for documents that lose any; docs as `renamed`."""
    lines = line_hashes(docs).drop("line")  # made twice: they are more than the texts
    place = F.struct(F.col("id").isNotNull().alias("has_id"), "id", "t1", "t2", "pos")
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "first-lines", **STORED)
    repeated = materialize(firsts.where("times > 1").select("h1", "h2", "first"), "repeated-lines", **STORED)
    found = materialize(line_keys_twice(docs), "segments", **STORED)
    shared = shared_keys(found)
    none = F.lit("0").cast(dict(docs.dtypes)["id"])
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(shared, "h1"))

    @F.pandas_udf("boolean")
    def met(h: pd.Series) -> pd.Series:
        return pd.Series(marked(bits.value, h.to_numpy(np.int64)))

    texts = found.where("line IS NOT NULL").where(met("h1")).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    large = ~cold(F.col("n"), F.col("chars"))
    keys = shared.groupBy("h1", "h2").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(large, F.col("key"))).alias("hot"))
    texts = texts.join(keys, ["h1", "h2"]).join(firsts.where(met("h1")), ["h1", "h2"])
    texts = texts.select("h1", "h2", "line", "keys", "hot", "first.has_id", F.coalesce("first.id", none).alias("id"), "first.t1", "first.t2", "first.pos")
    texts = materialize(texts, "shared-texts", **STORED)
    hot = materialize(shared.where(large), "hot-segments", **STORED)
    discard(found, firsts, shared)  # before the pairs are shuffled
    group = ["key", "cell", "lo", "hi"]
    order = [*group, "has_id", "id", "t1", "t2", "pos"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for rows in whole_groups(frames(batches, 2000), group):
            hit = have_earlier(rows.assign(cross=rows["lo"] != rows["hi"]), known)
            known.update(rows["h1"][hit].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][hit].to_numpy()) for c in ("h1", "h2")], ["h1", "h2"])

    pairs, near = groups(hot, texts), []
    for i in range(PASSES):  # the lines that travel with a key are the most that is on disk: a part of the keys at a time
        dealt = pairs.where(F.pmod(F.xxhash64("key"), F.lit(PASSES)) == i).repartition(*group).sortWithinPartitions(*order)
        near.append(materialize(dealt.mapInArrow(verify, "h1 long, h2 long").distinct(), "near-lines"))
    passes, near = near, reduce(DataFrame.union, near).distinct()
    first = F.struct("has_id", F.when(F.col("has_id"), F.col("id")).alias("id"), "t1", "t2", "pos").alias("first")
    verdicts = texts.join(near, ["h1", "h2"]).select("h1", "h2", first, F.lit(True).alias("near"))
    verdicts = verdicts.unionByName(repeated.join(near, ["h1", "h2"], "left_anti").withColumn("near", F.lit(False)))
    verdicts = materialize(verdicts, "line-verdicts")
    discard(repeated, texts, hot, *passes)
    gone = lines.join(verdicts, ["h1", "h2"]).withColumn("again", ~place.eqNullSafe(F.col("first"))).where("near OR again")
    gone = gone.groupBy("id", "t1", "t2", "pos").agg(F.max(~F.col("again") & F.col("near")).alias("near"))  # equal rows are one document
    gone = gone.groupBy("id", "t1", "t2").agg(F.collect_list(F.when(~F.col("near"), F.col("pos"))).alias("exact"), F.collect_list(F.when(F.col("near"), F.col("pos"))).alias("near"))
    gone = materialize(gone, "gone-lines")
    discard(verdicts)
    return gone


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", report: str | None = None) -> DataFrame:
    """docs with the text of the lines that stay; report: name of one more column, a struct of n_lines, n_exact and n_near (lines that went)."""
    gone = judge(renamed(docs, key, text)).withColumnsRenamed({"id": "gone_id", "t1": "g1", "t2": "g2"})
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), n_lines, *[c.alias(n) for c, n in zip(content_key(text), DOC[1:], strict=True)])
    own = own.join(gone, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    lines = F.split(F.col("row")[text], "\n", -1)
    lost = F.concat("exact", "near")
    # kept places by a set difference, so that a text of a million lines costs as many steps
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    new = F.when(F.size(lost) > 0, kept).otherwise(F.col("row")[text])
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    told = F.struct("n_lines", count("exact").alias("n_exact"), count("near").alias("n_near"))
    return own.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], *([told.alias(report)] if report else []))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report="lines")
    return out.select("doc_id", "lines.*", (F.col("lines.n_lines") - F.col("lines.n_exact") - F.col("lines.n_near")).alias("n_kept"))
