"""Connected components of an edge table, without collecting any of it.

Alternating large and small stars: every round relinks each node to the least
neighbour it knows, and the table ends as stars around each component's least
node.  Minima are plain aggregates (partial sums before the shuffle); the join
back is between two written tables, so that adaptive execution can split a
centre of a huge star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _relink(arcs: DataFrame, large: bool) -> DataFrame:
    least = written(_least(arcs), "least")
    met = arcs.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
    if large:
        pairs = met.where("v > u").select("v", F.col("m").alias("w"))
    else:
        # a node links to the least of its smaller neighbours, and so do they
        pairs = met.where("v != m").select("v", F.col("m").alias("w")).unionByName(least.select(F.col("u").alias("v"), F.col("m").alias("w")))
    return written(pairs.where("v != w").distinct(), "stars")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of BIGINT nodes, in any order, repeats and loops allowed ->
    ``(node, root)`` for every node of an edge to another node; ``root`` is the least
    node of its component.  Rows with a null end are no edges.  No edges: no rows."""
    stars = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return stars.select(F.col("v").alias("node"), F.col("w").alias("root")).unionByName(
                stars.select(F.col("w").alias("node"), F.col("w").alias("root")).distinct()
            )
        seen = state
        both = stars.select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(stars.select(F.col("w").alias("u"), "v"))
        stars = _relink(both, large=True)
        stars = _relink(stars.select(F.col("v").alias("u"), F.col("w").alias("v")), large=False)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
