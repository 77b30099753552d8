"""Connected components by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.stage import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node reachable.

    Each round a node takes the least label among itself and its neighbours,
    then the label of its label; rounds end when no label moves.  A hub with
    very many neighbours is an aggregation with partial sums, and the joins are
    on one row per node, so no task holds a hub's list.  Null ends are left out;
    without links there are no rows.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct()
    both = written(ends.union(ends.select("b", "a")).withColumnsRenamed({"a": "node", "b": "other"}), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("further"))
        moved = written(hooked.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("further", "new")).alias("label")), "labels")
        discard(labels)
        labels = moved
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return labels.select("node", "label")
