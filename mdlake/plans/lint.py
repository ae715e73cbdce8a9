"""The structural check of a corpus, as findings, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mdlake.lake import Lake
from mdlake.operators import checks, sinks


def findings(lake: Lake) -> DataFrame:
    """All nine checks, computed anew."""
    return lake.checked()


def by_check(lake: Lake) -> DataFrame:
    return checks.by_check(lake.findings)


def totals(lake: Lake) -> DataFrame:
    return checks.totals(lake.findings)


def as_json(lake: Lake) -> DataFrame:
    return sinks.findings_json(lake.findings)


def report(lake: Lake) -> DataFrame:
    return sinks.findings_report(lake.findings)
