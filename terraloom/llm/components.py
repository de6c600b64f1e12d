"""Connected components of a graph given as a table of links, by alternating large and small stars.

Every round is two grouped minima and two joins, written to the shared folder so that lineage stays short; a checksum of the
links tells when nothing moves any more. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import forget, written


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) of any direction -> (node, root): root is the smallest node of the component; roots themselves are not listed."""
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, mark = None, _sum(now)
    while mark != before:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        before, mark = mark, _sum(new)
        forget(now)
        forget(large)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
