"""Connected components by alternating stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest id that can be reached.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest neighbour, until nothing changes:
    O(log n) rounds in practice. A node's smallest neighbour is an aggregate that is joined back, so no neighbourhood is gathered
    in one place, and adaptive execution splits hubs. Each round's edges are a stored table; two numbers reach the driver.
    """
    tree = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = tree.select("u", "v").union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        tree = stored(small.select("e.*").where("u <> v").distinct(), "edges")
        now = tree.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    # every tree is a star now
    return tree.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        tree.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
