"""Naming intermediate results so that they are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once per row.

    A plain projection may be substituted into every predicate and generator
    above it: ``explode`` alone adds a filter that repeats its argument. A
    one-row generator is not, so costly text extraction goes through here.
    """
    return df.select("*", F.stack(F.lit(1), *columns.values()).alias(*columns))
