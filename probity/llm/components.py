"""Connected components by contraction: every node goes to its least neighbour until no edge is left.

Each round maps a node to the least of itself and its neighbours and carries the edges over. Node ids are dealt without
regard to edges, so chains of falling ids are short and the nodes at least halve in a round or two. Groups are only ever
reduced by `min`, so a hub with any number of edges is one row per task. Each round's map is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, root) for each node of an edge; nodes of one component share a root."""
    live = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("up")))
        maps.append(up)
        left, right = up.select(F.col("id").alias("a"), F.col("up").alias("x")), up.select(F.col("id").alias("b"), F.col("up").alias("y"))
        moved = live.join(left, "a").join(right, "b").where("x <> y")
        live = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    # from the last round back: a node's root is that of the node it went to
    roots = maps[-1].select("id", F.col("up").alias("root"))
    for up in reversed(maps[:-1]):
        above = roots.select(F.col("id").alias("up"), "root")
        roots = up.join(above, "up", "left").select("id", F.coalesce("root", "up").alias("root"))
    return materialise(roots)
