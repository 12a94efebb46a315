"""Connected components of a graph given by its links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbox.llm.common import discard, join_checked, materialize


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of a link (a, b); the component is its smallest node.

    Each round first links larger neighbours of a node to its smallest neighbour, then
    smaller ones; trees flatten to stars in about log(diameter) rounds. A node of very high
    degree is met in aggregations that combine before the shuffle. The smallest neighbours
    are a table of their own, broadcast if it is small; else the join reads its sides straight
    from shuffles, so that AQE can split the node's rows. A round's tables go once the next
    one's are written.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = join_checked(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        # small star: what is left points down only, so each node links its smaller neighbours
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = join_checked(large, lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "links")
        for used in (edges, least, large, lower):
            discard(used)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
