"""Connected components of an edge table by randomised contraction.

Every round moves each node to the neighbour that comes first in a fresh
pseudo-random order (or leaves it, if it is first itself), renames the edges and
drops loops; the number of nodes falls by a constant share per round whatever the
shape of the graph.  What the rounds renamed is put together from the last, smallest
round backwards, so that all nodes are written once, not once a round.  Only a
minimum per node is kept when grouping, so a hub never gathers its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; nodes of a component share a root.

    Cases: no edges give no rows; loops, repeated and reversed edges are allowed;
    edges with a NULL end are ignored.
    """
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    links = stored(links.distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes, renamed = stored(nodes, "nodes"), []
    links, turn = links.where("a <> b"), 0
    while not links.isEmpty():
        turn += 1
        both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        best = both.groupBy("a").agg(F.min(_order("b", turn)).alias("near"))
        first = F.col("near") < _order("a", turn)
        near = stored(best.select(F.col("a").alias("old"), F.when(first, F.col("near.id")).otherwise(F.col("a")).alias("new")), "near")
        left = links.join(near, links.a == near.old).select(F.col("new").alias("a"), "b")
        moved = left.join(near, left.b == near.old).select("a", F.col("new").alias("b")).where("a <> b")
        done, links = links, stored(moved.distinct(), "links")
        forget(done)
        renamed.append(near)
    last = None
    for near in reversed(renamed):
        if last is not None:
            later = last.select(F.col("old").alias("new"), F.col("new").alias("root"))
            step, near = near, stored(near.join(later, "new", "left").select("old", F.coalesce("root", "new").alias("new")), "roots")
            forget(step, last)
        last = near
    if last is None:
        return nodes.select("node", F.col("node").alias("root"))
    roots = stored(nodes.join(last, nodes.node == last.old, "left").select("node", F.coalesce("new", "node").alias("root")), "roots")
    forget(nodes, last, links)
    return roots


def _order(column: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.col(column), F.lit(turn)).alias("place"), F.col(column).alias("id"))
