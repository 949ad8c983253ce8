"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayloom.lineage import stored


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of the nodes in ``edges`` (``a, b``); a component is named by its least node.

    Large stars and small stars in turn: each edge moves to the least
    neighbour of one of its ends until every component is a star.  The number
    of rounds grows with the logarithm of the longest path.  Minima are
    aggregated before they are shuffled, so a node with very many edges is no
    more than a skewed join.  Loops and repeated edges make no difference; edges
    with a null end are ignored; no edges give no rows.
    """
    known = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    links = stored(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    loops, links = links.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")), links.filter("a > b")
    before = _state(links)
    for _ in range(most_rounds):
        both = _ends(links)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = moved.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        links = stored(small, "links")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
