"""Connected components by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> Saved:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round hooks every label to the smallest neighbouring label and then jumps pointers, so the rounds grow with
    the logarithm of the longest path. Each round's labels are a table in the shared folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = Saved(both.union(edges.select("b", "a")).distinct(), "edges")
    labels = Saved(both.df.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.df.join(labels.df.withColumnsRenamed({"node": "other", "component": "m"}), "other").groupBy("node").agg(F.min("m").alias("m"))
        # a label and the node it names both take the smallest label seen beside them
        hooked = labels.df.join(near, "node").select("node", "component", F.least("component", "m").alias("m"))
        roots = hooked.groupBy("component").agg(F.min("m").alias("r")).withColumnsRenamed({"component": "node"})
        mid = hooked.join(roots, "node", "left").select("node", "component", F.least("m", F.coalesce("r", "m")).alias("label"))
        jump = mid.select(F.col("node").alias("label"), F.col("label").alias("next"))
        fresh = mid.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("component"), (F.coalesce("next", "label") != F.col("component")).alias("moved"))
        saved = Saved(fresh, "labels")
        labels.drop()
        labels = saved
        if labels.df.where("moved").isEmpty():
            break
        labels.df = labels.df.select("node", "component")
    else:
        raise RuntimeError("components did not settle")
    both.drop()
    labels.df = labels.df.select("node", "component")
    return labels
