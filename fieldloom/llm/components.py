"""Connected components of a link table by alternating large-star and small-star steps.

Every step is joins and aggregations over edges; the driver only sees one row of counts. Steps are written
to the shared folder, so a lost executor repeats at most one of them. The number of steps grows with the
logarithm of the longest chain; a step is deleted once the next is committed. Nodes of very many links, such as the root of a
large component, are joined by broadcast, so their links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, join_groups, tidy


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("size"))
    return join_groups(both.filter("v > u"), least, ["u"], "size", total=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Here u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    moved = join_groups(edges, least, ["u"], "size", total=n).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


@tidy
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node in a link, root being the smallest node that it reaches; a written table."""
    steps = Steps(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = steps.stored(now, "links")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = state(now)
    while last[0]:
        larger = steps.stored(_large_star(now, last[0]), "links")
        steps.drop(now)
        now = steps.stored(_small_star(larger, last[0]), "links")
        steps.drop(larger)
        if (new := state(now)) == last:
            break
        last = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
