"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is its distinct shingles of WORDS words (lower case, letters and digits; a shorter text is one shingle). A shingle's weight is
(1 + log2 of its count) times its inverse document frequency, 1 for a shingle in all documents and 2 for one in a single document,
rounded to a step of 2 ** (1/4). Document frequencies are counted exactly over all documents, of all 64 bits of a shingle's hash: texts are
packed in blocks, each block leaves its sorted hashes with their counts, split into ranges, and each range is merged. A corpus whose
repeated shingles are HEAVY at most sends their table to the tasks; of a larger one, each range gives each block the frequencies of the
block's own shingles, and they meet the block by a shuffle, in PARTS one after the other. Weights are the same either way.

Consistent samples: for each hash k and shingle, r and c are Gamma(2, 1) and beta uniform; t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta) - r; the least ln a over the document is the sample, equal in two documents with a probability of
their weighted Jaccard similarity. As weights come in steps, ln a is a table by step, slot and hash; steps from TABLED on are rare
and computed. A shingle's hash gives its slot and a rotation of the hashes. ROWS samples make a band; documents that share one of BANDS
bands are candidates, whatever the band's size, if they agree in AGREE of all samples: a pair of the threshold's similarity shares no
band with a chance of 3e-5, and agrees in fewer with one of 1e-5. Candidates link if their weighted Jaccard similarity is
THRESHOLD or more, from their whole shingle sets. Classes are the components of the links.

Texts are shingled once, equal texts are one node. First each node meets the first one of each of its bands, so that large groups of near
copies become one component by few comparisons. Bands whose nodes are then still in different components are worked as pairs of blocks of
bounded size: nodes that have a candidate of another component there, by samples alone, and then links between those, verified inside
the block, candidates that agree most first. Pairs are never emitted, only links that join components.

Null and empty texts are equal texts: one class. Rows are told apart by id and text: rows that share an id but not a text are two
documents. A class is named by its smallest id; rows without an id belong to the class of their text, null if no member has an id. A very
long text is one row whose shingles are held by one task. Equal rows fare alike, in any order of the input. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drowse.sources.shared import tidy

from .common import bitmap, content_key, discard, frames, marked, materialize, only_wanted, renamed, slices, sorted_groups, table
from .graph import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
AGREE = 48  # of HASHES
HEAVY, RANGE, FLUSH = 1 << 20, 1 << 20, 1 << 20  # shingles: in the table, in a range that is merged, held before they are sorted
PACK, PACKED, PARTS = 1 << 18, 1 << 14, 4  # shingles, and texts, of a block of texts; parts of the blocks
BLOCK, ROW = 6_000_000, 1000  # a block holds BLOCK bytes of shingles, a text counts as ROW more
LEVELS, TABLED, SLOTS, CHUNK = 25, 8, 1 << 13, 4096  # LEVELS: a single document's shingle that occurs 2 ** 31 times
WORD = re.compile(r"\w+")
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n, out = max(1, len(h) - WORDS + 1), np.zeros(max(1, len(h) - WORDS + 1), np.uint64)
    for i in range(min(WORDS, len(h))):
        x = h[i : i + n] * PRIMES[i]
        out += x ^ (x >> np.uint64(29))
    out ^= out >> np.uint64(32)
    return np.unique(out * PRIMES[0], return_counts=True)


def shingled(docs: DataFrame) -> DataFrame:
    """Blocks of texts: block and part, docs and n (their texts and shingles), and by text sizes, id, h1 and h2 (arrays), shingles (64-bit hashes)
    and counts (32-bit) as bytes, one text after the other; docs as `renamed`."""
    names = ["block", "part", "docs", "n", "sizes", "id", "h1", "h2", "shingles", "counts"]

    def packed(number: int, held: list[tuple[pa.RecordBatch, list]]) -> pa.RecordBatch:
        both = [x for _, made in held for x in made]
        sizes = [len(h) for h, _ in both]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        keys = [one(pa.concat_arrays([b.column(c) for b, _ in held])) for c in ("id", "h1", "h2")]
        data = [pa.array([b"".join(x[i].tobytes() for x in both)], pa.binary()) for i in (0, 1)]
        first = [pa.array([x], kind) for x, kind in ((number, pa.int64()), (number % PARTS, pa.int32()), (len(sizes), pa.int32()), (sum(sizes), pa.int64()))]
        return pa.RecordBatch.from_arrays([*first, one(pa.array(sizes, pa.int32())), *keys, *data], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, rows = (TaskContext.get().partitionId() << 32) + TaskContext.get().partitionId() % PARTS, [], 0, 0
        for b in slices(batches, 100):
            made = [(h, c.astype(np.uint32)) for h, c in map(shingles, b.column("text").to_pylist())]
            held.append((b.select(["id", "h1", "h2"]), made))
            n, rows = n + sum(len(h) for h, _ in made), rows + len(made)
            if n >= PACK or rows >= PACKED:
                yield packed(number, held)
                number, held, n, rows = number + 1, [], 0, 0
        if held:
            yield packed(number, held)

    own, kind = docs.select("id", "h1", "h2", "text"), dict(docs.dtypes)["id"]
    schema = f"block long, part int, docs int, n long, sizes array<int>, id array<{kind}>, h1 array<long>, h2 array<long>, shingles binary, counts binary"
    return own.mapInArrow(run, schema)


@dataclass
class Rarity:
    """Document frequencies of the frequent shingles, by the first bits of their hashes; `least` for all others."""

    keys: np.ndarray
    df: np.ndarray
    bits: int
    least: int
    n: int

    def frequencies(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.least, np.int64)
        if len(self.keys):
            key = hashes >> np.uint64(64 - self.bits)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            out[there] = self.df[at[there]]
        return out

    def levels(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Step of each shingle's weight; step j weighs 2 ** (j / 4)."""
        idf = 1 + np.log((self.n + 1) / (self.frequencies(hashes) + 1)) / math.log(self.n + 2)
        return np.clip(np.rint(4 * np.log2(idf * (1 + np.log2(counts)))), 0, LEVELS - 1).astype(np.int64)


WEIGHT = 2 ** (np.arange(LEVELS) / 4)


def document_frequencies(texts: DataFrame) -> Rarity:
    """A table of the shingles of `shingled`, HEAVY at most: exact where `fits`, else those in less than the HEAVYth part of all occurrences count
    as one just below that."""
    n, total = sizes_of(texts)
    ranges, floor = ranges_of(total), max(2, -(-total // HEAVY))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column(0)[i].as_buffer(), np.uint64)
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield sorted_out(held)
                    held, size = [], 0
        if size:
            yield sorted_out(held)

    def sorted_out(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = in_ranges(np.concatenate(held), ranges)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, RANGED, strict=True)], ["range", "keys", "more", "times"])

    def merge(of: tuple, p: pd.DataFrame) -> pd.DataFrame:
        keys, df, _ = merged(p)
        kept = df >= floor
        return pd.DataFrame({"keys": [keys[kept].tobytes()], "df": [df[kept].tobytes()]})

    with tidy(texts.sparkSession):
        each = texts.select("shingles").mapInArrow(count, "range long, keys binary, more binary, times binary")
        rows = each.groupBy("range").applyInPandas(merge, "keys binary, df binary").where("length(df) > 0").collect()  # HEAVY shingles at most
    keys = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r["keys"], np.uint64) for r in rows]])
    df, order = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r["df"], np.int64) for r in rows]]), np.argsort(keys)
    return Rarity(keys[order], df[order], 64, floor - 1, n)


def block_frequencies(texts: DataFrame, total: int) -> list[DataFrame]:
    """block, part, keys and df (bytes): the shingles of each block of `shingled` that several texts have, and in how many. A block has a row for
    each range in which it has any. The ranges are worked in two halves, a table each, so that half of the shingles are shuffled at once."""
    ranges = ranges_of(total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            h = np.frombuffer(b.column("shingles")[0].as_buffer(), np.uint64)
            h = h[h >> np.uint64(63) == np.uint64(half)]
            if len(h):
                rows = [pa.array(c, kind) for c, kind in zip(in_ranges(h, ranges), RANGED, strict=True)]
                same = [pa.array(np.full(len(rows[0]), b.column(c)[0].as_py()), kind) for c, kind in (("block", pa.int64()), ("part", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, *rows], ["block", "part", "range", "keys", "more", "times"])

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        keys, df, place = merged(p)
        rows, at = [], 0
        for block, part, x in zip(p["block"], p["part"], p["keys"], strict=True):
            own = place[at : at + len(x) // 8]
            own, at = own[df[own] > 1], at + len(x) // 8
            if len(own):
                rows.append((block, part, keys[own].tobytes(), df[own].astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["block", "part", "keys", "df"])

    out = []
    for half in (0, 1):
        each = texts.select("block", "part", "shingles").mapInArrow(count, "block long, part int, range long, keys binary, more binary, times binary")
        out.append(materialize(each.groupBy("range").applyInPandas(merge, "block long, part int, keys binary, df binary"), "block-frequencies", by="part"))
    return out


def sizes_of(texts: DataFrame) -> tuple[int, int]:
    """Texts and shingles of `shingled`."""
    return tuple(texts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "n")]).first())


def fits(total: int) -> bool:
    """Whether HEAVY entries hold all shingles that occur twice."""
    return total <= 2 * HEAVY


def ranges_of(total: int) -> int:
    """First bits of a hash that name its range: ranges follow the number of shingles, so each holds about RANGE entries before they are merged."""
    return max(1, math.ceil(math.log2(max(1, total / RANGE))))


RANGED = [pa.int64(), *[pa.binary()] * 3]


def in_ranges(h: np.ndarray, ranges: int) -> list[tuple]:
    """By range: its number, its distinct hashes in order, which of them occur several times, and how often."""
    keys, n = np.unique(h, return_counts=True)
    of = (keys >> np.uint64(64 - ranges)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    rows = []
    for a, z in zip(starts, [*starts[1:], len(of)], strict=True):
        more = np.flatnonzero(n[a:z] > 1).astype(np.uint32)
        rows.append((int(of[a]), keys[a:z].tobytes(), more.tobytes(), n[a:z][more].astype(np.uint32).tobytes()))
    return list(zip(*rows, strict=True))


def merged(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the rows of a range, their sums of times, and the place of each entry of the rows among them."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in p["keys"]])
    n, at = np.ones(len(keys), np.int64), 0
    for x, more, times in zip(p["keys"], p["more"], p["times"], strict=True):
        n[at + np.frombuffer(more, np.uint32).astype(np.int64)] = np.frombuffer(times, np.uint32)
        at += len(x) // 8
    keys, place = np.unique(keys, return_inverse=True)
    df = np.zeros(len(keys), np.int64)
    np.add.at(df, place, n)
    return keys, df, place


@lru_cache(maxsize=1)
def _samples() -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """ln a by step below TABLED, slot and hash, the hashes twice over, as windows by rotation; and ln c, r and beta for the steps beyond."""
    g = np.random.Generator(np.random.PCG64(20240101))
    r, c, beta = g.gamma(2, 1, (SLOTS, HASHES)), g.gamma(2, 1, (SLOTS, HASHES)), g.random((SLOTS, HASHES))
    out = np.empty((TABLED, SLOTS, 2 * HASHES), np.float32)
    for j in range(TABLED):
        out[j, :, :HASHES] = _ln_a(np.log(WEIGHT[j]), np.log(c), r, beta)
    out[:, :, HASHES:] = out[:, :, :HASHES]
    return np.lib.stride_tricks.sliding_window_view(out, HASHES, axis=2), (np.log(c), r, beta)


def _ln_a(ln_w, ln_c: np.ndarray, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return (ln_c - r * (np.floor(ln_w / r + beta) - beta) - r).astype(np.float32)


def least_samples(j: np.ndarray, slot: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The least ln a of each hash over shingles of these steps, slots and rotations."""
    (table_, draws), low = _samples(), np.full(HASHES, np.inf, np.float32)
    few, many = np.flatnonzero(j < TABLED), np.flatnonzero(j >= TABLED)
    for at in (few[a : a + CHUNK] for a in range(0, len(few), CHUNK)):
        low = np.minimum(low, table_[j[at], slot[at], turn[at]].min(axis=0))
    for at in (many[a : a + CHUNK // 8] for a in range(0, len(many), CHUNK // 8)):
        where = slot[at, None], (turn[at, None] + np.arange(HASHES)) % HASHES
        low = np.minimum(low, _ln_a(np.log(WEIGHT[j[at]])[:, None], *[x[where] for x in draws]).min(axis=0))
    return low


def signature(h: np.ndarray, j: np.ndarray) -> tuple[np.ndarray | None, bytes | None]:
    """BANDS hashes of a document's samples, and one byte for each sample; none without words."""
    if not len(h):
        return None, None
    bits = least_samples(j, (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(20)) % np.uint64(HASHES)).astype(np.int64)).view(np.uint32)
    mixed = np.arange(BANDS, dtype=np.uint64) * PRIMES[4]
    for i in range(ROWS):
        mixed = (mixed ^ bits.astype(np.uint64).reshape(BANDS, ROWS)[:, i]) * PRIMES[i]
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64), (bits * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def node_of() -> Column:
    """The name of a text: its two content hashes."""
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("h1", "h2")])


WEIGHED = ["n", "id", "h1", "h2", "shingles", "levels", "bands", "sig"]


def weigh(b: pa.RecordBatch, rarity: Rarity) -> pa.RecordBatch:
    """The texts of a block, a row each, with the levels of their shingles, BANDS hashes and the samples' bytes."""
    sizes = b.column("sizes")[0].as_py()
    h, c = (np.frombuffer(b.column(x)[0].as_buffer(), kind) for x, kind in (("shingles", np.uint64), ("counts", np.uint32)))
    j, ends = rarity.levels(h, c), np.cumsum([0, *sizes])
    both, low = [signature(h[a:z], j[a:z]) for a, z in zip(ends, ends[1:], strict=False)], j.astype(np.uint8)
    told = [pa.array([x[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], pa.binary()) for x in (h, low)]
    made = [pa.array([x for x, _ in both], pa.list_(pa.int64())), pa.array([x for _, x in both], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), *[b.column(x)[0].values for x in ("id", "h1", "h2")], *told, *made], WEIGHED)


def weighed_texts(docs: DataFrame) -> DataFrame:
    """id, h1, h2, n, shingles and levels (bytes), bands (array) and sig of each row of docs; docs as `renamed`."""
    blocks = materialize(shingled(docs), "shingles", by="part")
    n, total = sizes_of(blocks)
    schema = f"n int, id {dict(docs.dtypes)['id']}, h1 long, h2 long, shingles binary, levels binary, bands array<long>, sig binary"
    if fits(total):
        rarity = docs.sparkSession.sparkContext.broadcast(document_frequencies(blocks))
        out = materialize(blocks.mapInArrow(lambda batches: (weigh(b, rarity.value) for b in slices(batches, 1)), schema), "weighed")
        discard(blocks)
        return out

    def meet(block: pa.Table, found: pa.Table) -> pa.Table:
        keys, df = (np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in found[c]]]) for c, kind in (("keys", np.uint64), ("df", np.uint32)))
        order = np.argsort(keys)
        return pa.Table.from_batches([weigh(b, Rarity(keys[order], df[order], 64, 1, n)) for b in block.to_batches()])

    halves, out = block_frequencies(blocks, total), []
    for part in range(PARTS):
        own, found = (x.where(F.col("part") == part) for x in (blocks, reduce(DataFrame.union, halves)))
        out.append(materialize(own.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(meet, schema), "weighed"))
        discard(blocks, *halves, part=part)
    discard(blocks, *halves)
    return reduce(DataFrame.union, out)


def signatures(texts: DataFrame) -> DataFrame:
    """node, n, bands (array) and sig of each distinct text of `weighed_texts` that has words."""
    return texts.where("n > 0").select(node_of().alias("node"), "n", "bands", "sig").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bands", "sig")])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def weighed(hashes: bytes, levels: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), WEIGHT[np.frombuffer(levels, np.uint8)]


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many samples signatures agree."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, HASHES) for s in (a, b))
    return pd.Series((x == y).sum(1), dtype="int32")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. sets: node, shingles and levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def of(node: str, hashes: bytes, levels: bytes) -> tuple[np.ndarray, np.ndarray]:
            if node not in held:
                if len(held) > 64:
                    held.clear()
                held[node] = weighed(hashes, levels)
            return held[node]

        for b in slices(batches, 200):
            both = zip(*[b.column(c).to_pylist() for c in ("a", "shingles_a", "levels_a", "b", "shingles_b", "levels_b")], strict=True)
            ok = [similarity(of(*r[:3]), of(*r[3:])) >= THRESHOLD - 1e-9 for r in both]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}"), F.col("levels").alias(f"levels_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a string, b string")


GROUP = ["band", "lo", "hi"]


def _candidates(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row of a group with its candidates of other components further down, and their agreement; in a pair of blocks those of the other
    block. A pair is looked at in the first band that it shares."""
    label, part, cross = pd.factorize(group["label"])[0], group["part"].to_numpy(), group["lo"].iloc[0] != group["hi"].iloc[0]
    sig, bands = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, HASHES), np.array(group["bands"].tolist(), np.int64)
    band = group["band"].iloc[0]
    for r in range(len(group) - 1):
        other = np.flatnonzero(label[r + 1 :] != label[r]) + r + 1
        if cross:
            other = other[part[other] != part[r]]
        same = (sig[other] == sig[r]).sum(1)
        other, same = other[same >= AGREE], same[same >= AGREE]
        if len(other):
            shared = bands[other] == bands[r]
            here = bands[r][shared.argmax(1)] == band
            yield r, other[here], same[here]


def open_rows(group: pd.DataFrame) -> np.ndarray:
    """Which rows have a candidate of another component in the group."""
    out = np.zeros(len(group), bool)
    for r, other, _ in _candidates(group):
        out[r] |= len(other) > 0
        out[other] = True
    return out


def block_links(group: pd.DataFrame) -> list[tuple[str, str]]:
    """Links of a group between different components. Once links have joined two components, no more of their pairs are looked at."""
    node, label = group["node"].tolist(), group["label"].tolist()
    raw = list(zip(group["shingles"], group["levels"], strict=True))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    parent = {k: k for k in label}
    out: list[tuple[str, str]] = []

    def root(k: str) -> str:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def of(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in held:
            held[i] = weighed(*raw[i])
        return held[i]

    for r, other, same in _candidates(group):
        for i in other[np.argsort(-same, kind="stable")].tolist():
            x, y = root(label[r]), root(label[i])
            if x != y and similarity(of(r), of(i)) >= THRESHOLD - 1e-9:
                parent[max(x, y)] = min(x, y)
                out.append((node[r], node[i]))
    return out


def rest(rows: DataFrame, nodes: DataFrame, label: DataFrame, sets) -> DataFrame:
    """Links a, b between components in bands that hold several. rows: node and band, of bands with several nodes; sets: wanted nodes ->
    their shingles. Blocks are dealt by hash, in as many parts as a band's shingles need."""
    labelled = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialize(labelled.join(nodes.select("node", "n"), "node"), "labelled-bands")
    size = F.sum(12 * F.col("n") + ROW).alias("size")
    several = labelled.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), size).where("least <> most")
    several = materialize(several.select("band", F.ceil(F.col("size") / BLOCK).alias("parts")), "open-bands")
    own = labelled.join(several, "band").join(nodes.select("node", "sig", "bands"), "node")
    own = own.withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))})
    own = own.select("band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "label", "sig", "bands")

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, GROUP):
            kept = open_rows(g)
            if kept.any():
                yield g[kept]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(frames(batches), GROUP):
            found = block_links(g)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["a", "b"])

    left = materialize(own.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(narrow, own.schema), "open-blocks")
    wanted = materialize(left.select("node").distinct(), "open-nodes")
    full = left.join(sets(wanted), "node").repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    out = materialize(full.mapInArrow(link, "a string, b string").distinct(), "links")
    discard(labelled, several, left, wanted)
    return out


def labels(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, h1 and h2 of each row, and node and label (of its class) of each text that is like another; docs as `renamed`."""
    sc = docs.sparkSession.sparkContext
    texts = weighed_texts(docs)
    nodes = materialize(signatures(texts), "signatures")

    rows = nodes.select("node", F.explode("bands").alias("band"))
    several = materialize(rows.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("band", "first"), "bands-of-several")
    bits = sc.broadcast(bitmap(several, "band"))
    has = F.pandas_udf(lambda k: pd.Series(marked(bits.value, k.to_numpy(np.int64))), "boolean")
    rows = materialize(rows.where(has("band")).join(several, "band"), "bands")
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    pairs = rows.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    agree = F.pandas_udf(agreement, "int")
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").where(agree("sig_a", "sig_b") >= AGREE).select("a", "b")
    pairs = materialize(pairs, "candidates")

    def sets(wanted: DataFrame) -> DataFrame:
        """Shingles and levels of wanted nodes. Copies of a text are dropped in the tasks that read them, before any shuffle."""
        ids = wanted.select(F.conv(F.substring("node", 1, 16), 16, -10).cast("long").alias("h1")).distinct()
        near = only_wanted(texts.select("h1", "h2", "shingles", "levels"), ids, "h1")
        return near.groupBy(node_of().alias("node")).agg(F.first("shingles").alias("shingles"), F.first("levels").alias("levels"))

    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "candidate-nodes")
    known = materialize(sets(wanted), "candidate-sets")
    links = materialize(verified(pairs, known), "links")
    label = components(links)
    more = rest(rows.select("node", "band"), nodes, label, sets)
    if not more.isEmpty():
        label = components(links.union(more))
    out = texts.select("id", "h1", "h2"), label
    discard(nodes, several, rows, pairs, wanted, known)
    return out


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, h1 and h2 (of its text), class_id (the smallest id of its class) and label (the class, as a text): one row for each row of docs."""
    rows, label = labels(renamed(docs, key, text))
    texts = rows.groupBy("h1", "h2").agg(F.min("id").alias("least")).withColumn("node", node_of())
    texts = materialize(texts.join(label, "node", "left").select("h1", "h2", "least", F.coalesce("label", "node").alias("label")), "texts-once")
    named = materialize(texts.groupBy("label").agg(F.min("least").alias("class_id")), "classes")
    out = rows.join(texts.select("h1", "h2", "label").join(named, "label"), ["h1", "h2"])
    return out.select(F.col("id").alias("doc"), "h1", "h2", "class_id", "label")


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, with all its columns: that with the smallest id, one without an id only where no member has one."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\0none"))
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "h1", "h2")).alias("best")
    kept = classes(docs, text, key).groupBy("label").agg(best).select(name(F.col("best.doc")).alias("k"), "best.h1", "best.h2")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name(F.col(key)).alias("k"), *content_key(text))
    once = own.join(materialize(kept, "kept"), ["k", "h1", "h2"], "left_semi").dropDuplicates(["k", "h1", "h2"])
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
