"""Connected components of a link table, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) of every node in a link; links between a node and itself may be left out.

    Each round replaces a node's links by one to its least smaller neighbour p, links its other smaller neighbours to p, and
    moves every link's smaller end to that end's own p. Rounds grow with the logarithm of a component's diameter; each round's
    links are written to the shared checkpoint folder. Only counts come to the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges, seen = cut(edges), None
    while True:
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen or not told[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = tuple(told)
        parents = edges.groupBy("u").agg(F.min("v").alias("p"))
        hooked = edges.join(parents, "u").select(F.explode(F.array(F.struct("u", F.col("p").alias("v")), F.struct(F.col("v").alias("u"), F.col("p").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        above = parents.select(F.col("u").alias("x"), F.col("p").alias("q"))
        jumped = hooked.join(above, hooked.v == above.x, "left").select("u", F.coalesce("q", "v").alias("v"))
        edges = cut(jumped.distinct())
