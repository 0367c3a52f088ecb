"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is the least node of its component.

    Rounds go on until the edges are stars, which takes a number of rounds of the
    order of the logarithm of a component's diameter.  Keys meet only in sums and
    joins, never in one collected group; the large side of a join is split when skewed.
    """
    low, high = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now = written(edges.select(low, high).where("lo < hi").distinct(), name)
    while not _stars(now):
        both = now.selectExpr("lo u", "hi v").unionByName(now.selectExpr("hi u", "lo v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = written(large, name)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct()
        now = written(small, name)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one root at most and no root has one itself."""
    roles = edges.selectExpr("hi node", "1 below", "0 above").unionByName(edges.selectExpr("lo node", "0 below", "1 above"))
    worst = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return worst.where("below > 1 or below = 1 and above = 1").isEmpty()
