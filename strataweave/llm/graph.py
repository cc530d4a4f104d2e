"""Connected components of an edge table, by alternating large and small stars.

Every round reads and writes tables in the shared folder; nothing of the graph
goes through the driver but two sums a round.  A centre of very many edges is
only ever reduced to its smallest neighbour (a map-side minimum) and joined
back, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on rows (a, b); returns distinct rows with a > b."""
    both = edges.select("a", "b") if not large else edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:  # larger neighbours move to the smallest one of all
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours and the node itself move to the smallest one
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; only nodes of an edge are listed.

    ``edges`` has columns a and b of one integer type; loops and repeated rows
    are allowed, null ends are dropped.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    mark = None
    while True:
        after = written(_star(_star(now, True), False), "edges")
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if tuple(told) == mark:
            break
        mark = tuple(told)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
