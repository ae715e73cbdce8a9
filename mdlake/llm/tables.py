"""Tables of a folder, and small helpers that several operators share."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


class Covered:
    """Which parts of a text spans cover, asked in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1  # the last one that starts before ``end``
        return at >= 0 and self.ends[at] > start


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
