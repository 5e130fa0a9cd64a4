"""Connected components as Spark jobs: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b), both bigint; label is the smallest node reached.

    Each round hangs larger neighbours and then smaller ones on the smallest node known, in
    two joins and two grouped minima, and is cut. Rounds grow with the logarithm of the
    longest path. Nothing but a count and a checksum reaches the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        # Large star: every larger neighbour of u hangs on the smallest of u and its neighbours.
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours hang on the smallest of these.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").where("a <> b").distinct())
    stars = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return stars.union(now.select("b", "b").distinct().toDF("node", "label"))
