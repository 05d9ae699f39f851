"""Connected components of a link table by alternating star rounds.

Every round is two grouped minima and two joins, so no component is ever gathered
in one place. Tables between rounds lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, saved


def _downhill(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least node around it; links stay downhill and may repeat."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return found.agg(F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0))), F.lit(False))).first()[0] is False


def components(links: DataFrame) -> DataFrame:
    """node, component for every node in `links` (a, b); a component's id is its least node.

    Links may repeat, point either way or to themselves; a node that is linked to
    nothing else has no row. Without links there are no rows.
    """
    edges = saved(_downhill(links), "links")
    while not _stars(edges):
        after = saved(_small_star(_large_star(edges)).distinct(), "links")
        discard(edges)
        edges = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
