"""Connected components of a table of links, by alternating star contractions.

Each round is two aggregations and two joins; a node with very many links is pre-aggregated before the shuffle and
its join is left to adaptive skew handling. Links, components and labels stay distributed; the driver sees counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import table_cut


def star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (u > v): neighbours move to the least neighbour."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def labels(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not the least of its component itself."""
    now = table_cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(limit):
        now = table_cut(star(star(now, True), False))
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
