"""Connected components by contraction, for graphs of any size.

Every node that has a smaller neighbour hooks onto the least; chains are shortened until
each node knows its root; edges move to the roots, and the rest is the same problem on a
smaller graph. A hub with a third of all edges is one key of joins that adaptive execution
splits and of sums that are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.scratch import Scratch


def _roots(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root, from node and parent, a smaller node."""
    now = hooks
    while True:
        above = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        now = scratch.saved(
            now.join(above, "parent", "left").select(
                "node",
                F.coalesce("above", "parent").alias("parent"),
                F.col("above").isNotNull().alias("moved"),
            )
        )
        if now.filter("moved").isEmpty():
            return now.select("node", F.col("parent").alias("root"))
        now = now.select("node", "parent")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root, the least node of its component, of all nodes but the roots.

    ``edges`` has two columns of nodes; loops and repeats do no harm. No edges, no rows.
    """
    a, b = (F.col(c) for c in edges.columns)
    left = edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    left = scratch.saved(left.distinct())
    done = None
    while not left.isEmpty():
        hooks = scratch.saved(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        roots = _roots(hooks, scratch)
        if done is None:
            done = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            moved = done.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            done = scratch.saved(moved.unionByName(roots))
        lows = roots.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        # All nodes with a smaller neighbour have a root; a node that is only ever the smaller one is one.
        highs = roots.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        at_roots = (
            left.join(highs, "hi")
            .join(lows, "lo", "left")
            .select(F.col("hi_root").alias("x"), F.coalesce("lo_root", "lo").alias("y"))
            .filter("x != y")
        )
        left = scratch.saved(at_roots.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    if done is None:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return done
