"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (and by size, so that a wide vector widens no others) into geometric buckets, and a bucket into blocks of
about BLOCK vectors, so that a bucket that holds most vectors is still many tasks. Queries come in blocks too. A first pass scores each
query against one block of the longest vectors: its k-th score is a floor for the query. The floor divided by |q| is the length that a
vector needs at least. Blocks of queries go only to buckets that reach the least need of their queries, which is known from the
bucket's number before anything is sent. In a block, the floor divided by |q| and the block's greatest length is a query's local cosine
threshold. Below STEEP the query is pruned by length: its products stop at the shortest vector that it needs. From STEEP on it is pruned by
coordinates: of the query's FOCUS greatest coordinates, each bounds that coordinate of a unit vector within the threshold's angle, and only
vectors inside all bounds are left. What is left is verified by products, exact in 64-bit integers or beyond.

Vectors that are null or have null, NaN or infinite components, and rows without an id, take no part. Vectors of different sizes
are compared over zeros. A repeated row counts once. Ties go to the smaller id. A component of 2 ** 53 or more after scaling, or a score
that 64 bits can't hold, is an error, not a wrong result. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, K, EVERY = 1024, 10, 100
BLOCK, QUERY_BLOCK = 4096, 1024
#: Local cosine threshold from which a query is pruned by coordinates, and by how many of them.
STEEP, FOCUS = 0.5, 3
SLACK = 1 + 1e-9
RATIO, WIDTHS = 1.1, 32  # of the lengths at a bucket's ends; sizes, by powers of two, that share a length


def integers(vector: str = "embedding", scale: int = SCALE) -> Column:
    high = lambda x: F.abs(x.cast("double")) >= 2.0**53 / scale
    told = F.lit("a vector's component is too great for exact products").cast("string")
    return F.when(F.exists(F.col(vector), high), F.raise_error(told).cast("array<long>")).otherwise(F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long")))


def usable(vector: str = "embedding") -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad)


def _split(df: DataFrame, per: int, by_length: bool) -> tuple[DataFrame, dict[int, int]]:
    """`df` with bucket and part, and the parts of each bucket: as many entries as a double has exponents, times a constant."""
    wide = F.ceil(F.log2(F.greatest(F.size("v"), F.lit(1))))
    length = F.coalesce(F.floor(F.log(RATIO, F.when(F.col("length") > 0, F.col("length")))), F.lit(-1))
    df = df.withColumn("bucket", (length if by_length else F.lit(0)).cast("long") * WIDTHS + wide)
    parts = {r["bucket"]: -(-r["count"] // max(1, min(per, (per << 10) >> r["bucket"] % WIDTHS))) for r in df.groupBy("bucket").count().collect()}
    number = F.get(F.array(*[F.lit(n) for n in parts.values()]), F.array_position(F.array(*[F.lit(k) for k in parts]), F.col("bucket")).cast("int") - 1) if parts else F.lit(1)
    return df.withColumn("part", F.pmod(F.xxhash64("vec_id"), number)), parts


def reach(bucket: int) -> float:
    """No vector of the bucket is longer."""
    return RATIO ** (bucket // WIDTHS + 1) * SLACK


def _blocks(df: DataFrame) -> DataFrame:
    """bucket, part, length (greatest), ids, size and values of each block, as bytes."""

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "vec_id"], ascending=[False, True])
        dim = int(p["v"].map(len).max())
        m = np.zeros((len(p), dim), np.int64)
        for i, v in enumerate(p["v"]):
            m[i, : len(v)] = v
        return pd.DataFrame({"bucket": [key[0]], "part": [key[1]], "length": [p["length"].max()], "dim": [dim], "ids": [p["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

    return df.groupBy("bucket", "part").applyInPandas(build, "bucket long, part long, length double, dim int, ids binary, m binary")


def _open(ids: bytes, m: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.int64).reshape(len(i), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: in doubles where no sum can pass 2**53, which is fast, else in integers, and in Python's where 64 bits may not do."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * n if n and a.size and b.size else 0.0
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("an inner product needs more than 64 bits")
    return exact.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, seen: dict[str, int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best here, leaving out what can't reach its floor. v: longest first. seen: counts the
    pairs that are left out by length and by coordinates, and those verified."""
    lengths, q_lengths = np.sqrt((v.astype(np.float64) ** 2).sum(1)), np.sqrt((q.astype(np.float64) ** 2).sum(1))
    seen = {} if seen is None else seen
    positive = floors > 0
    need = np.where(positive, floors / np.maximum(q_lengths, 1e-300), 0)
    long_enough = np.searchsorted(-lengths, -need / SLACK, side="right")
    local = np.where(positive, need / max(lengths[0], 1e-300), -1)
    seen["length"] = seen.get("length", 0) + int((len(ids) - long_enough).sum())

    def told(i: int, at: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, int, int]]:
        seen["verified"] = seen.get("verified", 0) + len(at)
        near = (scores >= floors[i]) & (ids[at] != q_ids[i])
        scores, at = scores[near], at[near]
        for j in _best(scores, ids[at], k):
            yield int(q_ids[i]), int(ids[at[j]]), int(scores[j])

    flat = np.flatnonzero((long_enough > 0) & (local < STEEP))
    flat = flat[np.argsort(long_enough[flat], kind="stable")]
    for part in (flat[a : a + 64] for a in range(0, len(flat), 64)):  # queries of like needs share a product
        scores = _products(q[part], v[: long_enough[part].max()])
        for row, i in enumerate(part):
            yield from told(i, np.arange(long_enough[i]), scores[row, : long_enough[i]])
    steep = np.flatnonzero((long_enough > 0) & (local >= STEEP))
    n = min(q.shape[1], v.shape[1])
    unit = v[:, :n] / np.maximum(lengths, 1e-300)[:, None] if len(steep) else None
    for i in steep:
        inside, angle = np.ones(long_enough[i], bool), np.arccos(min(1.0, local[i] / SLACK)) + 1e-7
        x = q[i, :n] / q_lengths[i]
        for f in np.argsort(-np.abs(x))[:FOCUS]:
            own = np.arccos(np.clip(x[f], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)), np.cos(max(0.0, own - angle))
            inside &= (unit[: long_enough[i], f] >= low) & (unit[: long_enough[i], f] <= high)
        at = np.flatnonzero(inside)
        seen["coordinates"] = seen.get("coordinates", 0) + int(long_enough[i] - len(at))
        if len(at):
            yield from told(i, at, _products(q[i : i + 1], v[at])[0])


def _useful_blocks(parts: dict[int, int], need: str) -> Column:
    """Array of (bucket, part) of the blocks whose vectors may be as long as `need`."""
    of = lambda bucket, n: F.when(F.col(need) > reach(bucket), F.array().cast("array<struct<bucket: long, part: long>>")).otherwise(_parts(bucket, n))
    return F.flatten(F.array(*[of(k, n) for k, n in (parts or {0: 1}).items()]))


def _parts(bucket: int, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.struct(F.lit(bucket).cast("long").alias("bucket"), i.alias("part")))


def top_k(vectors: DataFrame, queries: Column, k: int = K, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which `queries` holds, against all rows but their own."""
    kept = vectors.where(usable(vector) & F.col(key).isNotNull())
    own = kept.select(F.col(key).cast("long").alias("vec_id"), integers(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).distinct()
    own = own.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    split, parts = _split(own, BLOCK, True)
    blocks = materialize(_blocks(split), "vector-blocks")
    asked, _ = _split(own.where("asked"), QUERY_BLOCK, False)
    asked = _blocks(asked).select((F.col("part") * WIDTHS + F.col("bucket")).alias("q_part"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("dim").alias("q_dim"))
    top = max(parts, default=0)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q_ids, q = _open(r.q_ids, r.q_m, r.q_dim)
                floors = np.full(len(q), -np.inf)
                ids, v = _open(r.ids, r.m, int(r.dim)) if r.ids is not None else (np.empty(0, np.int64), np.empty((0, 1), np.int64))
                s = _products(q, v)
                for i in range(len(q)):
                    mine = s[i][ids != q_ids[i]]
                    if len(mine) >= k:
                        floors[i] = np.partition(mine, len(mine) - k)[len(mine) - k]
                need = np.where(floors > 0, floors / np.maximum(np.sqrt((q.astype(np.float64) ** 2).sum(1)), 1e-300), 0).min()
                yield pd.DataFrame({"q_part": [r.q_part], "q_ids": [r.q_ids], "q_m": [r.q_m], "q_dim": [r.q_dim], "floors": [floors.tobytes()], "need": [need]})

    longest = blocks.where((F.col("bucket") == top) & (F.col("part") == 0)).select("bucket", "ids", "m", "dim")
    probe = asked.withColumn("bucket", F.lit(top).cast("long")).join(longest, "bucket", "left")
    floors = materialize(probe.mapInPandas(first, "q_part long, q_ids binary, q_m binary, q_dim int, floors binary, need double"), "query-floors")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q_ids, q = _open(r.q_ids, r.q_m, r.q_dim)
                ids, v = _open(r.ids, r.m, r.dim)
                yield pd.DataFrame(search_block(q_ids, q, np.frombuffer(r.floors), ids, v, k), columns=["query_id", "vec_id", "score"])

    # by a shuffle: what a side takes in memory is a multiple of its files, and grows with queries and blocks
    pairs = floors.withColumn("at", F.explode(_useful_blocks(parts, "need"))).select("*", "at.*").join(blocks.select("bucket", "part", "ids", "m", "dim").hint("merge"), ["bucket", "part"])
    found = pairs.mapInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
