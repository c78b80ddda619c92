"""Connected components of an edge table, by alternating large and small stars.

Each round needs, for each node, only the smallest neighbour: an aggregation
combined on the map side, so a node with a third of all edges is one partial
row per task. The join that hands the minimum back is one that AQE may split.
No edge or component reaches the driver; it sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.store import BROADCAST_ROWS, discard, materialise


def _stars(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step over edges (a > b), of which there are at most ``rows``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("_m"))
    if large:
        least = least.withColumn("_m", F.least("a", "_m"))
    joined = both.join(F.broadcast(least) if 2 * rows <= BROADCAST_ROWS else least.hint("merge"), "a")
    if large:  # every larger neighbour, to the smallest one: never more edges than before
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        return out.where("a > b")
    # The node and its smaller neighbours, to the smallest one.
    out = joined.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return out.unionByName(least.select("a", F.col("_m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest id that a node reaches.

    Nodes without an edge to another node are not returned. Every round is a
    stored table, so a lost executor repeats one round at most. The smallest
    neighbours are broadcast where the counted edges bound their number, and
    met by a sort-merge join beyond.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = materialise(now, "edges")
    tally = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.agg(*tally).first()
    while seen[0]:
        larger = materialise(_stars(now, True, seen[0]), "edges")
        after = materialise(_stars(larger, False, seen[0]), "edges")
        # Done when a round changes nothing: then every edge leads from a node to its component's smallest.
        state = after.agg(*tally).first()
        discard(now)
        discard(larger)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
