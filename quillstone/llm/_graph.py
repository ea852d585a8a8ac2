"""Connected components by least label, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every node of edges (a, b); label is the least id that is reachable.

    Each round takes the least label among a node and its neighbours, then the label's own label (pointer jumping), so that
    chains halve. Least labels are combined before each shuffle, so a hub costs one row a task.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b"))
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        least = labels.join(near, "id", "left").select("id", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        least = scratch.keep(least)
        jump = least.select(F.col("id").alias("next"), F.col("next").alias("label"))
        after = scratch.keep(least.join(jump, "next", "left").select("id", F.coalesce("label", "next").alias("label"), "was"))
        moved = not after.filter("label <> was").isEmpty()
        scratch.drop(least, labels)
        labels = after
        if not moved:
            scratch.drop(both)
            return labels.select("id", "label")
