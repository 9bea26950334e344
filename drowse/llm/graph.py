"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component, for every node in a link. Without links, no rows.

    Each round takes the smallest label among neighbours and then the label's own label, so paths shorten by half; it ends when no
    label changes. Rounds are written to the shared folder: lineage stays short, joins see tables of known size, and a round that the
    next one has replaced is deleted.
    """
    both = materialize(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct(), "links-both-ways")
    labels = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("seen"))
        new = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        low = F.coalesce(F.least("low", "root"), "low")
        new = materialize(new.join(jump, "low", "left").select("node", low.alias("label"), (low < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        if not moved:
            discard(both)
            return new.drop("moved")
        labels = new
