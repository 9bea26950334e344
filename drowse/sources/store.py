"""A store of tables that are bucketed alike, so that merging them by their keys shuffles nothing.

A table is a folder of Parquet files, one for each bucket of the keys, and beside it `_spec`, a row that names keys, buckets and schema.
Spark plans reads of it as bucketed: joins and groupings by the keys, and windows over them, need no exchange (of a chain of
full joins, whose keys are computed, only the first). Keys of (series_id, step)
spread a long series over all buckets. Tables that are to be merged need the same keys and number of buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEYS = ("series_id", "step")


def _name() -> str:
    return f"store_{uuid.uuid4().hex}"


def write_store(df: DataFrame, path: str, keys: Sequence[str] = KEYS, buckets: int = 64) -> None:
    """Writes `df`, in place of what is there. One shuffle brings each bucket to one task, which sorts it by the keys."""
    spark, name = df.sparkSession, _name()
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: they are not the catalog's
    spec = json.dumps({"keys": list(keys), "buckets": buckets, "schema": df.schema.jsonValue()})
    spark.createDataFrame([(spec,)], "spec string").coalesce(1).write.mode("overwrite").json(f"{path}/_spec")


def read_store(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table at `path`, which may have been written by another session, with its buckets known to Spark."""
    spec = json.loads(spark.read.schema("spec string").json(f"{path}/_spec").first()["spec"])
    name, quoted = _name(), [f"`{k}`" for k in spec["keys"]]
    schema = T.StructType.fromJson(spec["schema"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(quoted)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {spec['buckets']} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    return out.select(*columns) if columns else out
