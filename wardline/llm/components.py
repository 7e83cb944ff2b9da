"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import keep


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` has (high, low) with high > low. Each node hands the lowest node it knows to its neighbours.

    The lowest neighbour is found by a partial aggregate and joined back, so a node with very many neighbours is
    not gathered in one task: its rows are an ordinary, splittable side of a join.
    """
    known = links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    if large:
        known = known.unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
    least = known.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    told = known.join(least, "node")
    if large:
        out = told.where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))
    else:
        out = told.select(F.col("other").alias("high"), F.col("least").alias("low")).unionByName(
            least.select(F.col("node").alias("high"), F.col("least").alias("low"))
        )
    return out.where("high > low").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node of its component.

    The number of rounds grows with the logarithm of the longest path. Every round is written to the shared
    folder, so a lost executor costs the current round only.
    """
    clean = links.where(F.col(left) != F.col(right))
    now = keep(clean.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low")).distinct())
    mark = None
    while True:
        now = keep(_star(_star(now, large=True), large=False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )
