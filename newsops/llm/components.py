"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches.

    Every round takes the least label among a node's neighbours and then that label's own label, so
    the distance covered doubles; the loop ends when nothing changes.
    """
    ways = scratch.keep(
        f"{name}-ways", links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = scratch.keep(name, ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select(
        "node", F.least("node", "other").alias("component")
    ))
    while True:
        near = ways.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("near")
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        ahead = labels.select(F.col("node").alias("step"), F.col("component").alias("jump"))
        moved = lower.join(ahead, "step").select("node", "old", F.least("step", "jump").alias("component"))
        labels = scratch.keep(name, moved)
        if not labels.where("component <> old").take(1):
            scratch.drop(f"{name}-ways")
            return labels.select("node", "component")
        labels = labels.select("node", "component")
