"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so
    paths shorten by half or more. A node with very many links is one row of labels and many rows of
    links; minima are taken before rows are exchanged, so no task gathers its neighbours.
    Nothing but a count comes to the driver.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node != other")
    both = store(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = stored = store(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        step = store(step, "labels")
        discard(stored)
        jump = step.join(step.select(F.col("node").alias("component"), F.col("component").alias("onward")), "component", "left")
        labels = stored = store(jump.select("node", "was", F.least("component", F.coalesce("onward", "component")).alias("component")), "labels")
        discard(step)
        if labels.where("component != was").isEmpty():
            discard(both)
            return labels.select("node", "component")
        labels = labels.select("node", "component")
