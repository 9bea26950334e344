"""Best-two-fit packing of token sequences.

Texts become token ids with an end id; longer ones are cut into pieces, the first of which takes the remainder. The packing plan
is made from the histogram of piece lengths alone, which has at most `capacity` entries however many pieces there are: fill a
bin greedily with the longest pieces that fit, then replace its smallest piece by the two unpacked ones that fill the expanded
gap best, and repeat that bin as often as the counts allow. Pieces are then numbered within their length, without a global sort:
a number within the task, plus the count of the tasks before it. Number and plan give each piece its sequence and offset.

A null or empty text is one piece holding the end id alone. A very long text is encoded in one call and leaves a piece for each
`capacity` ids. Pieces of one length are alike to the plan: which of them gets which place follows the order of tasks. Ids, null or not,
pass unchanged; repeated rows are packed as often as they occur. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, table

CAPACITY, END = 2048, 0
#: A text with this string goes to the tokenizers library itself, which reads it as one id.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoders(vocabulary: str):
    """The vocabulary file in `tokenizers`, and the same vocabulary in the faster `tiktoken`; both give the same ids."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(vocabulary)
    with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer.from_file(path), tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = "byte_bpe_50k.json") -> list[int]:
    exact, fast = _encoders(vocabulary)
    return exact.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


def cut(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32 of the ids as little-endian 32-bit numbers) of each piece, with the end id."""
    full = np.array([*ids, END], dtype="<u4")
    first = len(full) % capacity or capacity
    edges = [0, *range(first, len(full) + 1, capacity)]
    return [(a, b - a, zlib.crc32(full[a:b].tobytes())) for a, b in zip(edges, edges[1:], strict=False)]


def pieces_of(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """key, piece, start, length, ids_crc32, and task and number: the piece's number among those of its length in its task."""

    def start():
        task, seen = TaskContext.get().partitionId(), Counter()

        def run(texts: list[str | None]) -> tuple[list[int], list[pa.Array]]:
            rows, out = [], []
            for r, t in enumerate(texts):
                for i, (begin, length, crc) in enumerate(cut(token_ids(t or "", vocabulary), capacity)):
                    rows.append(r)
                    out.append((i, begin, length, crc, task, seen[length]))
                    seen[length] += 1
            columns = zip(*out, strict=True) if out else [[]] * len(KINDS)
            return rows, [pa.array(c, kind) for c, kind in zip(columns, KINDS, strict=True)]

        return run

    return map_texts(docs, key, text, start, {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "task": "int", "number": "long"})


KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), by best-two-fit over counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        own, gap, held = [], capacity, left.copy()
        while gap > 0:
            fits = np.flatnonzero(held[: gap + 1])
            if not len(fits):
                break
            own.append(int(fits[-1]))
            held[fits[-1]] -= 1
            gap -= int(fits[-1])
        if gap > 0:
            small, room = own[-1], gap + own[-1]
            have = np.flatnonzero(held[:room])
            best, lo, hi = (small, None), 0, len(have) - 1
            while lo <= hi:
                a, b = int(have[lo]), int(have[hi])
                if a + b > room or (lo == hi and held[a] < 2):
                    hi -= 1
                    continue
                if a + b > best[0]:
                    best = (a + b, (b, a))
                lo += 1
            if best[1]:
                own[-1:] = best[1]
        use = Counter(own)
        times = int(min(left[k] // n for k, n in use.items()))
        for k, n in use.items():
            left[k] -= n * times
        out.append((own, times))


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first numbers of the ranges, and the sequence of that number and the offset there."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for own, times in bins:
        at = 0
        for length in own:
            rows.setdefault(length, []).append((taken[length], sequence, at))
            taken[length] += times
            at += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    cuts = materialize(pieces_of(docs, text, key, capacity, vocabulary), "pieces")
    counts = cuts.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cuts.join(offsets, ["task", "length"]).select(F.col(key).alias("k"), "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, numbers = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                first, seq, at = where.value[int(length)]
                slot = np.searchsorted(first, numbers[mine], side="right") - 1
                sequence[mine], offset[mine] = seq[slot] + numbers[mine] - first[slot], at[slot]
            own = [b.column(c) for c in ("k", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], ["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(numbered.dtypes)["k"]
    return numbered.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("k", key)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
