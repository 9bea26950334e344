"""What the corpus operators share: reading tables, the shared folder, row keys that stay exact, sorted group streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drowse.sources.shared import tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one;
    on a cluster that would be another folder on each machine, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """`df` written once to the shared folder and read back. It cuts the lineage, survives lost executors, and gives joins a
    table of known size, both sides of which adaptive execution can split when a key is hot. `by`: a column whose values get a folder each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.options(**options).parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame, **part: int) -> None:
    """Deletes tables of `materialize` that nothing reads any more, or that part of them (column=value)."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([df.written_to, *[f"{c}={v}" for c, v in part.items()]]))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(docs: DataFrame, key: str, text: str, start: Callable[[], Callable[[list[str | None]], tuple[list[int] | None, list[pa.Array]]]], fields: dict[str, str]) -> DataFrame:
    """`key` and the columns `fields` (name -> type). Each task calls `start` for a function that makes columns of a batch of texts: (row of
    each result, or None for one each, and the columns). The key never becomes a Python value: it passes as Arrow, so any id stays exact, beside nulls too."""
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for b in slices(batches):
            rows, columns = fn(b.column(1).to_pylist())
            k = b.column(0) if rows is None else b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([k, *columns], names)

    names = ["k", *fields]
    schema = ", ".join(f"{n} {kind}" for n, kind in fields.items())
    return own.mapInArrow(run, f"k {dict(own.dtypes)['k']}, {schema}").withColumnRenamed("k", key)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of `rows` rows at most: what a task makes of a batch beside it stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def frames(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pd.DataFrame]:
    return (b.to_pandas() for b in slices(batches, rows))


def renamed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text and content hashes h1, h2 of each row under names of our own, so no column of the input can clash. Rows are the same
    document only if both id and text are."""
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *content_key(text))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or as many underscores behind it as it takes to be no column of `df`."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def content_key(col: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: 128 bits name a text without moving it."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("second"), c).alias("h2")]


#: Bits of a `bitmap`: 8 MB whatever the number of keys.
BITS, BITS_A_CHUNK = 1 << 26, 1 << 18


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each of BITS hash slots that a key of the table falls in. A key without its bit is surely not in the table, so rows that
    nobody wants need not be shuffled; the fuller the bitmap, the fewer it spares, and an exact join always follows."""
    with tidy(keys.sparkSession):
        return _bitmap(keys, key)


def _bitmap(keys: DataFrame, key: str) -> np.ndarray:
    slots = keys.select(F.pmod(F.col(key), F.lit(BITS)).cast("long").alias("slot")).distinct().withColumn("chunk", F.floor(F.col("slot") / BITS_A_CHUNK).cast("int"))

    def build(of: tuple, p: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BITS_A_CHUNK, np.uint8)
        bits[p["slot"].to_numpy() % BITS_A_CHUNK] = 1
        return pd.DataFrame({"chunk": [of[0]], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((BITS // BITS_A_CHUNK, BITS_A_CHUNK // 8), np.uint8)
    for r in slots.groupBy("chunk").applyInPandas(build, "chunk int, bits binary").collect():  # at most BITS / BITS_A_CHUNK rows
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys have their bit."""
    slot = (keys.view(np.uint64) & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def only_wanted(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose 64-bit key is in `wanted`: first by the bitmap of wanted keys, without a shuffle, then by an exact semi-join."""
    bits = df.sparkSession.sparkContext.broadcast(bitmap(wanted, key))

    @F.pandas_udf("boolean")
    def has(k: pd.Series) -> pd.Series:
        return pd.Series(marked(bits.value, k.to_numpy(np.int64)))

    return df.where(has(F.col(key))).join(wanted, key, "left_semi")


def sorted_groups(batches: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches whose rows are sorted by `key`; a group may span batches, one group is held at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        values = batch[key]
        new = np.zeros(len(batch), bool)
        for k in key:
            v = values[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        new[0] = not held or tuple(held[-1][key].iloc[-1]) != tuple(values.iloc[0])
        starts = [*new.nonzero()[0].tolist(), len(batch)]
        if starts[0] > 0 or starts[0] == len(batch):
            held.append(batch.iloc[: starts[0]])
        for a, b in zip(starts, starts[1:], strict=False):
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [batch.iloc[a:b]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def whole_groups(batches: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Many whole groups at a time, numbered in column `group`, from batches whose rows are sorted by `key`."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if batch.empty:
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(rows), bool)
        for k in key:  # in its own type: a shifted column of 64-bit keys would be compared as doubles
            v = rows[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        number = new.cumsum()
        last = number == number[-1]
        held = rows[last]
        if not last.all():
            yield rows[~last].assign(group=number[~last])
    if held is not None:
        yield held.assign(group=0)
