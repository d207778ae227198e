"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    Each step takes the smallest label among a node's neighbours and then that label's own
    label, so a chain of n nodes takes about log n steps. No row of the graph leaves the
    executors; the driver sees only how many labels changed. No edges: no rows.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")))
    while True:
        known = labels.select("id", "component")
        near = both.join(known.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("component").alias("near"))
        step = known.join(near, known["id"] == near["u"], "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("best"))
        up = known.select(F.col("id").alias("best"), F.col("component").alias("jump"))
        moved = cut(step.join(up, "best", "left").select("id", "was", F.least("best", F.coalesce("jump", "best")).alias("component")))
        done = moved.filter("was != component").isEmpty()
        discard(labels)
        labels = moved
        if done:
            discard(both)
            return labels
