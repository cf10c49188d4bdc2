"""Connected components of links, as DataFrame steps; nothing of them reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm._store import Workspace


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for the ends of links (u, v): the least node that links lead to.

    Each round takes the least label among a node and its neighbours and then
    the label's own label, so chains halve. Rounds are written to the shared
    folder; labels fall until none changes. A label that very many nodes have is
    a hot key of the joins, which adaptive execution splits: the other side has one row for it.
    """
    both = links.select("u", "v").where("u <> v").distinct()
    both = work.save(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{name}-links")
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
    labels = work.save(labels, f"{name}-0")
    k = 0
    while True:
        # A node's own label travels with those of its neighbours, so one aggregation gives the least.
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v")
        near = near.select(F.col("u").alias("node"), "c", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", F.col("component").alias("c"), F.col("component").alias("was"))
        step = work.save(near.union(own).groupBy("node").agg(F.min("c").alias("to"), F.max("was").alias("was")), f"{name}-step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        k += 1
        following = work.save(
            step.join(jump, "to").select("node", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("was")).alias("moved")), f"{name}-{k}"
        )
        moved = following.where("moved").limit(1).count()
        work.drop(f"{name}-{k - 1}")
        labels = following.select("node", "component")
        if not moved:
            work.drop(f"{name}-links")
            work.drop(f"{name}-step")
            return labels
