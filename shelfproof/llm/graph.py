"""Connected components of a large edge table, by alternating large and small stars.

Every round links each vertex's larger neighbours to its smallest one, then each
vertex's smaller neighbours to the smallest of them, until nothing changes.  Rounds are written tables,
so a lost executor costs a round's part, and only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfproof.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every vertex of edges ``a``, ``b`` (long); the root is the smallest vertex reached."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where(F.col("a") != F.col("b")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where(F.col("b") > F.col("a")).alias("l").join(least.alias("r"), F.col("l.a") == F.col("r.a"))
                 .select(F.col("l.b").alias("a"), F.col("r.m").alias("b")))
        large = stored(large.union(least.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))).distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.alias("l").join(least.alias("r"), F.col("l.a") == F.col("r.a"))
                 .where(F.col("l.b") != F.col("r.m")).select(F.col("l.b").alias("a"), F.col("r.m").alias("b")))
        now = stored(small.union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
        new = tuple(now.agg(F.count("a"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct().toDF("node", "root"))
