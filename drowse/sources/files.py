"""Series, event and fold tables from files, and detections and features to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drowse.operators.blocks import free, numbered, scan

SERIES = "series_id string, step long, timestamp string, anglez float, enmo float"
EVENTS = "series_id string, night int, event string, step double, timestamp string"
OFFSET_TIME = "yyyy-MM-dd'T'HH:mm:ssZ"


def read_series(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only `columns` reach the scan; timestamps with offsets become one UTC instant."""
    df = spark.read.schema(SERIES).parquet(path)
    df = df.select(*columns) if columns else df
    return df.withColumn("timestamp", F.to_timestamp("timestamp", OFFSET_TIME)) if "timestamp" in df.columns else df


def read_events(spark: SparkSession, path: str, drop_null: bool = True) -> DataFrame:
    df = spark.read.schema(EVENTS).csv(path, header=True)
    df = df.withColumns({"timestamp": F.to_timestamp("timestamp", OFFSET_TIME), "step": F.col("step").cast("long")})
    return df.where(F.col("step").isNotNull()) if drop_null else df


def explode_folds(folds: DataFrame) -> DataFrame:
    """fold, role, series_id from one row per fold with train_series_ids and valid_series_ids."""
    part = lambda role: folds.select("fold", F.lit(role).alias("role"), F.explode(f"{role}_series_ids").alias("series_id"))
    return part("train").unionByName(part("valid"))


def explode_periodicity(df: DataFrame, values: str = "periodicity") -> DataFrame:
    """series_id, step, value from arrays whose index is the step."""
    return df.select("series_id", F.posexplode(values).alias("step", values))


def write_features(df: DataFrame, path: str) -> None:
    df.repartition("series_id").sortWithinPartitions("series_id", "step").write.mode("overwrite").parquet(path)


def with_row_id(df: DataFrame, order: tuple[str, ...] = ("series_id", "step")) -> DataFrame:
    """Consecutive row_id in global order: places within series, in blocks, after the counts of the series before, which are a scan over one row
    a series. No task has all rows, all series, or a long series."""
    key, *rest = order
    own, before = free(df, "_own"), free(df, "_before")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    ahead = scan(sizes, [], key, {before: F.col("_size")}).select(F.col(key).alias("_series"), (F.col(before) - F.col("_size")).alias(before))
    placed = numbered(df, [key], rest, own).join(ahead, F.col(key).eqNullSafe(F.col("_series")))
    return placed.select(*df.columns, (F.col(before) + F.col(own)).alias("row_id"))


def write_detections(df: DataFrame, path: str) -> None:
    out = with_row_id(df)
    out.write.mode("overwrite").parquet(f"{path}/parquet")
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
