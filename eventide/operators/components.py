"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.session import stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b): every node of ``edges`` (long columns a, b) that isn't its component's least, with that least node.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes.  Each round aggregates map-side,
    joins on the node (a star's centre is a skewed join, which AQE splits) and is written to the shared folder, so
    lineage stays short.  Loops and repeated edges are allowed; no edges give no rows.
    """
    now = stage(edges.where("a != b").select("a", "b").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        now = stage(_small_star(_large_star(now).distinct()).distinct())
        last, seen = seen, mark(now)
        if tuple(last) == tuple(seen):
            break
    return now
