"""Connected components of a graph whose links stay distributed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gableframe.scratch import settle


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _hung_on_least(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller_hung_on_least(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = least.select("u", F.col("m").alias("v"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable.

    links has two long columns u and v. Stars are hung over in rounds, a number that grows with the
    logarithm of the longest path; the links of each round are written to the shared folder, so
    that neither lineage nor driver holds the graph. A hub's rows are joined to one row of its own,
    which the adaptive planner splits. Links with a null end, and loops, are left out.
    """
    links = settle(links.where("u != v").select("u", "v").distinct(), "links")
    before = _signature(links)
    while before[0]:
        links = settle(_smaller_hung_on_least(_hung_on_least(links)), "links")
        now = _signature(links)
        if now == before:
            break
        before = now
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
