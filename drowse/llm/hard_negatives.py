"""Hard negatives of anchors by a secondary sort: rows of another label whose score lies in a window below that of a positive.

Vectors lie in blocks of about BLOCK, anchors in blocks of about ANCHORS and slices of SLICE such blocks. For a slice, which is broadcast
and of bounded size, each task scans its vector blocks once and keeps, for each anchor, what may still be among the best of its blocks:
in a first pass the POSITIVES best rows of the same label, which name the windows; in a second one the NEGATIVES best rows of another
label in each window. So a task tells a bounded number of scores an anchor, however many vectors it has seen, and nothing is dropped
that could be in the result. Scores leave as packed keys (anchor's block and place, descending score, positives first, id): 25 bytes whose order as
bytes is the order wanted. `repartitionAndSortWithinPartitions` deals them by anchor and sorts them, on disk if need be, and one iterator walks the
sorted keys: a positive opens its window, a negative goes to every open window that it is in, and a window that is full or that the
scores have passed closes. It holds the open windows of one anchor, never an anchor's rows.

Rows with a null id or label, a null vector, or a null, NaN or infinite component take no part. Vectors of different sizes are compared over
zeros. A repeated row counts once, and of rows that share an id and differ, the one with the smallest label, then the smallest components. Ties go to the smaller id. An anchor without positives, and a positive whose window holds no row, give no rows; the window of a
negative positive score is empty. Scores are exact; one that needs more than 64 bits is an error. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import topk
from .common import materialize, table

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: A window holds scores from LOW to HIGH percent of the positive's.
LOW, HIGH = 30, 90
BLOCK, ANCHORS, SLICE = 4096, 1024, 8
KEY = struct.Struct(">QQBQ")
SIGN, MASK = 1 << 63, (1 << 64) - 1


def pack(anchor: int, score: int, positive: bool, vec: int) -> bytes:
    """(anchor, descending score, positives first, id) as bytes of that order. Signed numbers are moved to unsigned ones."""
    return KEY.pack(anchor + SIGN, MASK - (score + SIGN), not positive, vec + SIGN)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    a, s, negative, v = KEY.unpack(key)
    return a - SIGN, MASK - s - SIGN, not negative, v - SIGN


def _blocks(rows: DataFrame, per: int) -> DataFrame:
    """number, and ids, labels and values of each block of about `per` rows, as bytes. Blocks are dealt by a hash of the id, so that no label
    or length makes one greater than others."""
    parts = max(1, -(-rows.count() // per))

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id", kind="stable")
        dim = max(1, int(p["v"].map(len).max()))
        m = np.zeros((len(p), dim), np.int64)
        for i, v in enumerate(p["v"]):
            m[i, : len(v)] = v
        return pd.DataFrame({"number": [key[0]], "dim": [dim], "ids": [p["vec_id"].to_numpy(np.int64).tobytes()], "labels": [p["label"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

    return rows.withColumn("number", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).groupBy("number").applyInPandas(build, "number long, dim int, ids binary, labels binary, m binary")


class Best:
    """The k highest scores seen so far, and their ids, of each of n rows; ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def floor(self, i: int) -> int | None:
        """A score below this can't be among them any more."""
        return int(self.scores[i][-1]) if len(self.scores[i]) == self.k else None

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        low = self.floor(i)
        if low is not None:
            good = scores >= low
            scores, ids = scores[good], ids[good]
        if len(scores):
            scores, ids = np.concatenate([self.scores[i], scores]), np.concatenate([self.ids[i], ids])
            at = topk._best(scores, ids, self.k)
            self.scores[i], self.ids[i] = scores[at], ids[at]


def _scan(vectors: DataFrame, anchors: DataFrame, slice_: int, windows: bool) -> DataFrame:
    """(number and place in its block, id) of the anchor, score and id of what may be in the result, for the anchors of a slice: same-label rows,
    or with `windows` rows of another label in the windows of `held` (positive scores, 0 and up, of each anchor; -1 for none)."""
    per = NEGATIVES if windows else POSITIVES
    mine = anchors.where(F.col("slice") == slice_).select(*[F.col(c).alias(f"a_{c}") for c in ("number", "dim", "ids", "labels", "m", *(["held"] if windows else []))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, Best]] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["a_number"] not in state:
                    own, q = topk._open(r["a_ids"], r["a_m"], r["a_dim"])
                    held = np.frombuffer(r["a_held"], np.int64).reshape(len(own), POSITIVES) if windows else None
                    state[r["a_number"]] = own, q, np.frombuffer(r["a_labels"], np.int64), held, Best(len(own) * (POSITIVES if windows else 1), per)
                own, q, own_labels, held, best = state[r["a_number"]]
                ids, v = topk._open(r["ids"], r["m"], r["dim"])
                scores, labels = topk._products(q, v), np.frombuffer(r["labels"], np.int64)
                for i in range(len(own)):
                    if not windows:
                        at = np.flatnonzero((labels == own_labels[i]) & (ids != own[i]))
                        best.add(i, scores[i, at], ids[at])
                        continue
                    at = np.flatnonzero(labels != own_labels[i])
                    s, other = scores[i, at], ids[at]
                    for j, p in enumerate(held[i].tolist()):
                        if p >= 0:
                            inside = (s >= -(-LOW * p // 100)) & (s <= HIGH * p // 100)
                            best.add(i * POSITIVES + j, s[inside], other[inside])
        for number, (own, _, _, _, best) in state.items():
            for i, a in enumerate(own.tolist()):
                each = range(i * POSITIVES, (i + 1) * POSITIVES) if windows else (i,)
                found = {(int(s), int(v)) for j in each for s, v in zip(best.scores[j], best.ids[j], strict=True)}
                if found:
                    rows = zip(*((number, i, a, s, v) for s, v in found), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["number", "place", "anchor", "score", "vec"])

    return vectors.crossJoin(F.broadcast(mine)).mapInArrow(run, "number long, place long, anchor long, score long, vec long")  # SLICE blocks of ANCHORS anchors, for each block of vectors


def windows_of(keys: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys, each with its anchor's id. An open window is
    [positive, score, rows given]."""
    anchor, open_, last = None, [], None
    for key, anchor_id in keys:
        if key == last:  # told by two tasks' windows
            continue
        last = key
        a, score, positive, vec = unpack(key)
        if a != anchor:
            anchor, open_ = a, []
        if positive:
            open_.append([vec, score, 0])
            continue
        open_ = [w for w in open_ if w[2] < NEGATIVES and 100 * score >= LOW * w[1]]
        for w in open_:
            if 100 * score <= HIGH * w[1]:
                w[2] += 1
                yield anchor_id, w[0], w[2], vec, w[1], score


def mine(rows: DataFrame, anchors: Column, label: Column | str = "label", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows for which `anchors` holds."""
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    own = rows.where(topk.usable(vector)).select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), topk.integers(vector, SCALE).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    own = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"), F.max("asked").alias("asked")).select("vec_id", "row.label", "row.v", "asked")
    own = materialize(own, "scaled-vectors")
    vectors = materialize(_blocks(own.drop("asked"), BLOCK), "vector-blocks")
    asked = _blocks(own.where("asked").drop("asked"), ANCHORS).withColumn("slice", F.floor(F.col("number") / SLICE).cast("long"))
    asked = materialize(asked, "anchor-blocks")
    slices = [r["slice"] for r in asked.select("slice").distinct().orderBy("slice").collect()]  # one for SLICE * ANCHORS anchors
    if not slices:
        return spark.createDataFrame([], RESULT)
    near = _all_slices(vectors, asked, slices, False)
    order = Window.partitionBy("number", "place").orderBy(F.desc("score"), "vec")  # POSITIVES rows of each task
    positives = materialize(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= POSITIVES), "positives")
    held = materialize(_with_windows(asked, positives), "anchor-windows")
    found = _all_slices(vectors, held, slices, True)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = (b["number"].to_numpy() << 32) + b["place"].to_numpy()
            keys = [pack(*r) for r in zip(own.tolist(), b["score"].tolist(), b["positive"].tolist(), b["vec"].tolist(), strict=True)]
            yield pd.DataFrame({"key": keys, "anchor": b["anchor"]})

    cols = ("number", "place", "anchor", "score", "vec")
    told = positives.select(*cols, F.lit(True).alias("positive")).union(found.select(*cols, F.lit(False)))
    keys = told.mapInPandas(keyed, "key binary, anchor long").rdd.map(lambda r: (bytes(r[0]), r[1]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8]))
    return spark.createDataFrame(ordered.mapPartitions(windows_of, preservesPartitioning=True), RESULT)


RESULT = T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.LongType()) for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])


def _all_slices(vectors: DataFrame, anchors: DataFrame, slices: list[int], windows: bool) -> DataFrame:
    """All slices' scores, each slice by a job of its own whose rows are written before the next begins."""
    parts = [materialize(_scan(vectors, anchors, s, windows), "scores") for s in slices]
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p.written_to for p in parts])


def _with_windows(asked: DataFrame, positives: DataFrame) -> DataFrame:
    """The anchor blocks with `held`: the POSITIVES positive scores of each anchor, -1 where there are fewer, or for a score below 0."""

    def meet(of: tuple, block: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        held = np.full((len(block["ids"].iloc[0]) // 8 if len(block) else 0, POSITIVES), -1, np.int64)
        held[p["place"].to_numpy(), p["rank"].to_numpy() - 1] = np.maximum(p["score"].to_numpy(), -1)
        return block.assign(held=[held.tobytes()] * len(block))

    schema = f"{', '.join(f'{n} {k}' for n, k in asked.dtypes)}, held binary"
    return asked.groupBy("number").cogroup(positives.groupBy("number")).applyInPandas(meet, schema)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, moved)


ORACLE = f"""
WITH w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, e) AS n FROM w) WHERE n = 1),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_dot_product(a.e, v.e)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= {POSITIVES}),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT * FROM r WHERE rank <= {NEGATIVES}"""
