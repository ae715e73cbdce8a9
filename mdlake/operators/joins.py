"""Equi-joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_ROWS = 1_000_000  # rows of one key that one task may join
LISTED = 1000  # hot keys that a plan may name
TRACKED = 100_000  # items of a sketch of frequent keys


def hot_keys(df: DataFrame, key: str, target: int = TARGET_ROWS) -> DataFrame:
    """(key, slices) of keys with more than ``target`` rows: as many slices as keep each below it, on average."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > target).select(key, F.ceil(F.col("n") / target).cast("int").alias("slices"))


class Hot:
    """Keys with many rows, and the slices each is spread over, from a table (key, slices) that was made once.

    Up to LISTED keys are a map in the plan. Without any, nothing is added to a join.
    """

    def __init__(self, table: DataFrame):
        rows = table.limit(LISTED + 1).collect()
        self.table = table
        self.few = {r.key: r.slices for r in rows} if len(rows) <= LISTED else None

    def slices(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with the number of slices of each row's key as ``name``."""
        if self.few is None:
            hot = self.table.select(F.col("key").alias(key), F.col("slices").alias(name))
            return df.join(hot, key, "left").withColumn(name, F.coalesce(name, F.lit(1)))
        pairs = [F.lit(x) for pair in self.few.items() for x in pair]
        known = F.try_element_at(F.create_map(*pairs), F.col(key)) if pairs else F.lit(None).cast("int")
        return df.withColumn(name, F.coalesce(known, F.lit(1)))


def frequent(keys: DataFrame, least: int, tracked: int = TRACKED) -> DataFrame:
    """(key, n) of keys with more than ``least`` rows in ``keys`` (key), from a sketch of ``tracked`` items that partitions merge.

    Nothing is grouped by key: what travels is one sketch per partition. ``n`` is at most 3.5 rows in ``tracked`` above the
    number of rows, and keys with up to twice that error may be missing.
    """
    found = keys.where("key IS NOT NULL").agg(F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("s"))
    found = found.select(F.explode(F.expr(f"approx_top_k_estimate(s, {tracked})")).alias("f"))
    return found.select(F.col("f.item").alias("key"), F.col("f.count").alias("n")).where(F.col("n") > least)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_by: str,
    target: int = TARGET_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """``left.join(right, key, how)`` for a ``left`` with hot keys.

    Rows of a hot key are spread over its slices by a hash of ``spread_by``; only the matching ``right`` rows are copied, once
    per slice of their key. All other rows meet in a plain shuffle join. ``how`` is inner, left, left_semi or left_anti.
    ``hot`` are keys that are known already; without it the keys of ``left`` are counted here. A list that is too long for a map grows
    with the data divided by ``target``; it is no hint, so Spark broadcasts it only while it is small and otherwise joins it by
    sorting, where adaptive execution splits its partitions.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat copied right rows")
    if hot is None:
        hot = Hot(hot_keys(left, key, target).withColumnRenamed(key, "key"))
    if hot.few == {}:
        return left.join(right, key, how)
    spread = hot.slices(left, key, "_slices").withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.col("_slices")).cast("int")).drop("_slices")
    copied = hot.slices(right, key, "_slices").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return spread.join(copied, [key, "_slice"], how).drop("_slice")
