"""Page queries: a summary of matching pages or their open risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.lake import Lake
from mdlake.operators import extract, filters, projections, sinks
from mdlake.operators.aggregates import page_count, risk_totals
from mdlake.sources import documents


def summary(lake: Lake, **conditions) -> DataFrame:
    return projections.page_summary(filters.matching(lake.pages_of("query"), **conditions))


def _risks(lake: Lake, **conditions) -> DataFrame:
    """Open risk rows of matching pages, from the stored ones; texts are not read."""
    rows = documents.drop_excluded(lake.open_rows, "query")
    if any(v not in (None, "") for v in conditions.values()):
        rows = rows.join(filters.matching(lake.pages_of("query"), **conditions).select("path"), "path", "left_semi")
    return extract.query_risks(rows)


def risks(lake: Lake, **conditions) -> DataFrame:
    return _risks(lake, **conditions).drop("pos")


def write_summary(lake: Lake, path: str, **conditions) -> dict[str, int]:
    """Writes the summary and returns its number of pages, in one job."""
    return sinks.write_counted(summary(lake, **conditions), path, n_pages=F.count(F.lit(1)))


def write_risks(lake: Lake, path: str, **conditions) -> dict[str, int]:
    """Writes the open risks and returns their number and that of their pages, in one job: each page has one first row."""
    first = F.count_if(F.col("pos") == 0)
    return sinks.write_counted(_risks(lake, **conditions), path, n_rows=F.count(F.lit(1)), n_pages=first)


def summary_count(lake: Lake, **conditions) -> DataFrame:
    return page_count(filters.matching(lake.pages_of("query"), **conditions))


def risks_count(lake: Lake, **conditions) -> DataFrame:
    return risk_totals(risks(lake, **conditions))
