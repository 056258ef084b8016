"""Connected components of a table of links, by alternating star contraction.

Every round is a few equi joins and pre-aggregated groupings; each round's links are written to the shared folder,
so a lost executor costs at most one round. Nothing is collected but whether all of them are stars.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.tables import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Point every smaller neighbour of a node, and the node, at the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def _all_stars(links: DataFrame) -> bool:
    """Whether each node that points at a smaller one does so once and is pointed at by none; then nothing is left to contract."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.agg(F.max(F.when(F.col("down") > 0, F.col("down") + F.col("up")))).first()[0] in (None, 1)


def components(links: DataFrame) -> DataFrame:
    """`node, component` for every node of `links(a, b)`; the component is its smallest node.

    Links in both directions, repeated links and links of a node with itself may occur; a null end links nothing. A node
    that has only itself is not returned. No links give no rows.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    ends = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(ends.distinct(), "links")
    while not _all_stars(current):
        current = stored(_small_star(_large_star(current)).distinct(), "links")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct().toDF("node", "component")
    )
