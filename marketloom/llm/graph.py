"""Connected components of an edge table by contraction, without collecting any edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.settings import cut_lineage


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``(node, component)`` for every node with a link; component is its smallest reachable node.

    ``edges`` has long columns ``a`` and ``b``; loops, repeats and nulls are ignored. Each round
    points every node at its smallest neighbour, follows that pointer once more, and replaces
    edges by edges between the pointers; parallel edges merge, so the edge table shrinks until
    it is empty. Rounds are written to the shared folder. An empty edge table gives no rows.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    left = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (a != b).alias("_far"))
    live = cut_lineage(left.where("_far").select("lo", "hi").distinct(), purpose)
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(live.select("lo", "hi"))
        near = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        further = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = cut_lineage(near.join(further, "p").select("u", F.col("q").alias("p")), purpose)
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = parent.select(F.col("u").alias("component"), "p")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        low = parent.select(F.col("u").alias("lo"), F.col("p").alias("_a"))
        high = parent.select(F.col("u").alias("hi"), F.col("p").alias("_b"))
        live = live.join(low, "lo").join(high, "hi").where("_a != _b")
        live = cut_lineage(live.select(F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi")).distinct(), purpose)
    if labels is None:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    return cut_lineage(labels, purpose)
