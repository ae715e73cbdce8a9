"""Filters over the page table. An empty condition is no condition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.conventions import ENTITY_TYPES, KEBAB_NAME
from mdlake.functions.dates import days_since
from mdlake.functions.text import basename, contains_ci, or_empty


def by_status(pages: DataFrame, status: str | None) -> DataFrame:
    return pages.where(F.lower(or_empty(F.col("status"))) == status.lower()) if status else pages


def by_category(pages: DataFrame, part: str | None) -> DataFrame:
    return pages.where(contains_ci(or_empty(F.col("category")), part)) if part else pages


def by_type(pages: DataFrame, page_type: str | None) -> DataFrame:
    return pages.where(F.col("page_type") == page_type.lower()) if page_type else pages


def by_tag(pages: DataFrame, tag: str | None) -> DataFrame:
    return pages.where(F.array_contains(F.transform("tags", F.lower), tag.lower())) if tag else pages


def stale(pages: DataFrame, days: int | None, as_of: dt.date | str) -> DataFrame:
    """Not reviewed for ``days`` or more; 0 is a condition too."""
    return pages if days is None else pages.where(days_since(F.col("last_reviewed"), as_of) >= days)


def matching(
    pages: DataFrame,
    status: str | None = None,
    category: str | None = None,
    page_type: str | None = None,
    tag: str | None = None,
    stale_days: int | None = None,
    as_of: dt.date | str | None = None,
) -> DataFrame:
    """All given conditions at once."""
    kept = by_tag(by_type(by_category(by_status(pages, status), category), page_type), tag)
    return stale(kept, stale_days, as_of or dt.date.today())


def has_marker(status: Column, *markers: str, leading: bool = False) -> Column:
    """Does a risk status hold (or, if ``leading``, start with) one of the markers?"""
    test = F.startswith if leading else F.contains
    hit = F.lit(False)
    for marker in markers:
        hit = hit | test(status, F.lit(marker))
    return hit


def visible_nodes(
    pages: DataFrame, types: list[str] | None = None, text: str | None = None, tags: list[str] | None = None
) -> DataFrame:
    """Pages of the given types that hold the text in title or path and carry any of the tags."""
    kept = pages if types is None else pages.where(F.col("page_type").isin(*types))
    if text:
        kept = kept.where(contains_ci(F.col("title"), text) | contains_ci(F.col("path"), text))
    if tags:
        kept = kept.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return kept


def entity_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_type").isin(*ENTITY_TYPES))


def misnamed(pages: DataFrame) -> DataFrame:
    """(path, reason): names that are not kebab-case, entities outside ``entities/``."""
    entity = F.col("page_type").isin(*ENTITY_TYPES)
    reasons = F.array(
        F.when(~basename(F.col("path")).rlike(KEBAB_NAME), "not_kebab_case"),
        F.when(entity & ~F.startswith("path", F.lit("entities/")), "entity_outside_entities"),
    )
    return pages.select("path", F.explode(F.array_compact(reasons)).alias("reason"))
