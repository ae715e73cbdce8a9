"""The six collections a reader shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.lake import Lake
from mdlake.operators import extract, projections


def collections(lake: Lake) -> dict[str, DataFrame]:
    pages = lake.texts
    risks = extract.open_risks(lake.risk_rows)
    return {
        "pages": projections.page_record(pages),
        "edges": lake.edges,
        "log": lake.change_log.select("date", "action", "detail"),
        "risks": risks.select(
            F.col("path").alias("page"), "page_title", "status_symbol", "risk", "likelihood", "impact", "mitigation", "status"
        ),
        "open_qs": extract.open_questions(pages).select(F.col("path").alias("page"), "page_title", "question"),
        "search": projections.search_docs(pages),
    }
