"""Connected components of a graph of any size, by hooking and pointer jumping over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b); the component is its smallest node.

    Each round gives a node the least label around it, gives that label to the node that its own label names too, and
    takes a label's own label, so whole trees of labels are joined at once and long chains take about the logarithm of
    their length. Labels only fall, so it ends. Every round is a written table: lost executors cost at most one round.
    No edges, or such from nodes to themselves only, give no rows.
    """
    # Written before it is used twice: edges that are worked out anew may be others that join the same nodes, and then
    # the two directions would not match.
    edges = written(edges.select("a", "b").where("a <> b"), "pairs")
    both = written(edges.union(edges.selectExpr("b AS a", "a AS b")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("component")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("around"))
        near = written(labels.join(around, labels["node"] == around["a"]).select("node", "component", "around"), "around")
        hooks = near.where("around < component").groupBy(F.col("component").alias("root")).agg(F.min("around").alias("hooked"))
        far = labels.select(F.col("node").alias("step"), F.col("component").alias("beyond"))
        after = near.join(hooks, near["node"] == hooks["root"], "left").join(far, near["component"] == far["step"], "left")
        after = written(after.select("node", F.least("component", "around", "hooked", "beyond").alias("component"), F.col("component").alias("was")), "labels")
        changed = after.where(F.col("component") != F.col("was")).limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
