"""Where results go: JSON lines, checklists, reader tables. All writes are distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mdlake.operators.checks import label


def findings_json(found: DataFrame) -> DataFrame:
    """One JSON object per finding; other than ASCII is kept as it is."""
    return found.select(F.to_json(F.struct("file", "check", "detail")).alias("json"))


def findings_report(found: DataFrame) -> DataFrame:
    """Checklist items under their check's heading."""
    item = F.concat(F.lit("- [ ] `"), "file", F.lit("` — "), "detail")
    return found.select("check", label().alias("label"), item.alias("item")).orderBy("check", "item")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_counted(rows: DataFrame, path: str, **counts: Column) -> dict[str, int]:
    """Writes the rows and returns aggregates over them that are collected while they are written, so that one job gives both."""
    seen = Observation()
    rows.observe(seen, *(c.alias(n) for n, c in counts.items())).write.mode("overwrite").parquet(path)
    return seen.get


def write_lines(rows: DataFrame, path: str) -> None:
    """A one-column text result, e.g. of padded_rows."""
    rows.write.mode("overwrite").text(path)


def reader_bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """(collection, json): the records of all collections of the reader."""
    out = None
    for name, rows in tables.items():
        one = rows.select(F.lit(name).alias("collection"), F.to_json(F.struct("*")).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per collection."""
    for name, rows in tables.items():
        write_json(rows, f"{path}/{name}")
