"""Tables extracted from page texts: all row-local, none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.conventions import (
    ACTION_REQUIRED, HANDLED, HEADING, LISTED_REFS, NOT_ADDRESSED, OPEN_QUESTION, RISK_CELL, RISK_NOTE, SOURCE_REF,
)
from mdlake.functions.columns import once
from mdlake.functions.risk_tables import cell, open_table_rows, register_rows
from mdlake.operators.filters import has_marker


def heading_list(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)))


def headings(pages: DataFrame) -> DataFrame:
    """Distinct headings of levels 1 to 3, in order of first appearance."""
    return once(pages, found=heading_list(F.col("text"))).select("path", F.posexplode("found").alias("pos", "heading"))


def risk_rows(pages: DataFrame) -> DataFrame:
    """Every row of every risk register."""
    names = ("risk", "likelihood", "impact", "mitigation", "status")
    found = once(pages, rows=register_rows(F.col("body"))).select("path", "title", F.posexplode("rows").alias("pos", "c"))
    return found.select("path", F.col("title").alias("page_title"), "pos", *[cell(F.col("c"), i).alias(n) for i, n in enumerate(names)])


def _is_open(status: Column) -> Column:
    return has_marker(status, ACTION_REQUIRED, NOT_ADDRESSED, leading=True)


def open_risks(rows: DataFrame) -> DataFrame:
    """Those of ``risk_rows`` whose status starts with an open marker."""
    status = F.col("status")
    symbol = F.when(F.startswith(status, F.lit(ACTION_REQUIRED)), ACTION_REQUIRED).when(
        F.startswith(status, F.lit(NOT_ADDRESSED)), NOT_ADDRESSED
    )
    return rows.where(_is_open(status)).withColumn("status_symbol", symbol)


def open_rows(pages: DataFrame) -> DataFrame:
    """(path, pos, risk, likelihood, impact, status): open rows of any table with Risk and Likelihood columns, in or out of a register.

    Made once per corpus; query and lint read their rows from it.
    """
    rows = open_table_rows(F.col("text"), ACTION_REQUIRED, NOT_ADDRESSED)
    c = F.col("c")
    found = once(pages, rows=rows).select("path", F.posexplode("rows").alias("pos", "c"))
    return found.select("path", "pos", *[cell(c, i).alias(n) for n, i in (("risk", 0), ("likelihood", 1), ("impact", 2), ("status", 4))])


def query_risks(rows: DataFrame) -> DataFrame:
    """:func:`open_rows` as query shows them."""
    return rows.select(F.col("path").alias("file"), "pos", F.substring("risk", 1, RISK_CELL).alias("risk"), "likelihood", "impact", "status")


def lint_risks(rows: DataFrame) -> DataFrame:
    """Those of :func:`open_rows` that lint reports: not yet addressed, cut to a note's length."""
    return rows.where(has_marker(F.col("status"), NOT_ADDRESSED)).select("path", F.substring("risk", 1, RISK_NOTE).alias("risk"))


def open_risks_query(pages: DataFrame) -> DataFrame:
    """Open rows of any table with Risk and Likelihood columns."""
    return query_risks(open_rows(pages))


def open_risk_notes(text: Column) -> Column:
    """First cells of rows not yet addressed, cut to a note's length."""
    return F.transform(open_table_rows(text, NOT_ADDRESSED), lambda c: F.substring(cell(c, 0), 1, RISK_NOTE))


def open_risks_lint(pages: DataFrame) -> DataFrame:
    """(path, risk) of rows not yet addressed in any table with Risk and Likelihood columns."""
    return once(pages, notes=open_risk_notes(F.col("text"))).select("path", F.explode("notes").alias("risk"))


def open_questions(pages: DataFrame) -> DataFrame:
    found = once(pages, found=F.regexp_extract_all("body", F.lit(OPEN_QUESTION), F.lit(1)))
    return found.select("path", F.col("title").alias("page_title"), F.posexplode("found").alias("seq", "question"))


def raw_links(pages: DataFrame) -> DataFrame:
    """(src, target) of every link to a markdown file, targets relative to the root."""
    return pages.select(F.col("path").alias("src"), F.explode("links").alias("target"))


def mentions(pages: DataFrame, strip_dot_slash: bool = True) -> DataFrame:
    """(referrer, path) of the pages' own back-link lists."""
    ref = F.translate("raw", "\\", "/")
    if strip_dot_slash:
        ref = F.regexp_replace(ref, r"^\./", "")
    return pages.select("path", F.explode("mentioned_in").alias("raw")).select(ref.alias("referrer"), "path")


def source_ref_list(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(SOURCE_REF), F.lit(0))))


def preview(refs: Column) -> Column:
    """The first three and an ellipsis if there are more."""
    return F.concat(
        F.array_join(F.slice(refs, F.lit(1), F.lit(LISTED_REFS)), ", "),
        F.when(F.size(refs) > LISTED_REFS, "…").otherwise("")
    )


def source_refs(pages: DataFrame) -> DataFrame:
    """(path, n_refs, preview) of pages that name files under ``sources/``."""
    listed = once(pages.where(F.contains("text", F.lit("sources/"))), refs=source_ref_list(F.col("text")))
    return listed.where(F.size("refs") > 0).select("path", F.size("refs").alias("n_refs"), preview(F.col("refs")).alias("preview"))


def page_tags(pages: DataFrame) -> DataFrame:
    return pages.select("path", F.explode("tags").alias("tag"))


def risk_status_mix(rows: DataFrame) -> DataFrame:
    """Per page of :func:`risk_rows`: rows by status marker."""

    def n(marker: str) -> Column:
        return F.count_if(has_marker(F.col("status"), marker, leading=True))

    kinds = {"action_required": ACTION_REQUIRED, "not_addressed": NOT_ADDRESSED, "handled": HANDLED}
    counted = rows.groupBy("path").agg(F.count("*").alias("n"), *[n(marker).alias(name) for name, marker in kinds.items()])
    known = F.col("action_required") + F.col("not_addressed") + F.col("handled")
    return counted.select("path", *kinds, (F.col("n") - known).alias("other"))
