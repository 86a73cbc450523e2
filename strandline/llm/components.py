"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop_stored, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component): the smallest node reachable. Nodes without a link to another are left out.

    Every round is written to the shared folder, so the lineage stays short and lost executors cost one round. The result
    is a stored table as well.
    """
    now = stored(links.where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        if not state[0]:
            break
        new = stored(_small_star(_large_star(now)), "links")
        drop_stored(now)
        now = new
    out = stored(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct()), "components")
    drop_stored(now)
    return out
