"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): the smallest node that is reachable.

    Every round hooks each label to the smallest one next to it, then shortens chains, so
    labels' count falls at least by half in most rounds; edges within one component are
    dropped. State is written to the shared folder each round. A hot node costs one row a
    task, as the smallest neighbour is found by a partial aggregate."""
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    left = edges.select("a", "b").where("a <> b")
    left = stored(left.distinct(), "edges")
    while not left.isEmpty():
        # each component's smallest neighbour (or itself), and that one's: a forest of falling labels
        both = left.union(left.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new"))
        hook = stored(hook, "hook")
        while True:  # follow the hooks to their ends
            further = hook.alias("x").join(hook.alias("y"), F.col("x.new") == F.col("y.old"), "left").select("x.old", F.coalesce("y.new", "x.new").alias("new"), (F.coalesce("y.new", "x.new") != F.col("x.new")).alias("moved"))
            further = stored(further, "hook")
            hook = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        at = F.coalesce("new", "component")
        labels = stored(labels.join(hook, labels["component"] == hook["old"], "left").select("node", at.alias("component")), "labels")
        a, b = hook.withColumnsRenamed({"old": "a", "new": "a2"}), hook.withColumnsRenamed({"old": "b", "new": "b2"})
        left = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b").distinct()
        left = stored(left, "edges")
    return labels
