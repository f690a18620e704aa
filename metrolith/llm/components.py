"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b): nodes have one label if and
    only if they are connected. Labels are names of nodes, not always the least.

    Each round hooks every node to its least neighbour, jumps once more, and
    contracts the edges; a star is done in one round, a path in a logarithmic
    number. Hot nodes are aggregated before the shuffle. Loops are dropped, so
    a node that occurs in loops only has no row.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    total = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "hooks")
        jump = written(hook.alias("u").join(hook.alias("v"), F.col("u.p") == F.col("v.a")).select(F.col("u.a").alias("a"), F.col("v.p").alias("c")), "jumps")
        if total is None:
            total = jump.select(F.col("a").alias("node"), F.col("c").alias("label"))
        else:
            total = total.join(jump, total["label"] == jump["a"], "left").select("node", F.coalesce("c", "label").alias("label"))
        at_a, at_b = jump.select("a", F.col("c").alias("x")), jump.select(F.col("a").alias("b"), F.col("c").alias("y"))
        left = written(left.join(at_a, "a").join(at_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return written(total, "components")
