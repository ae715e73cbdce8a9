"""Counts and groups over pages and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.conventions import ENTITY_TYPES, OPEN_QUESTION
from mdlake.functions.text import path_order
from mdlake.operators.extract import page_tags
from mdlake.operators.filters import entity_pages
from mdlake.operators.projections import provenance


def _category():
    return F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Uncategorized")).alias("category")


def pages_by_category(pages: DataFrame) -> DataFrame:
    """Pages ordered by category name, then path: one range-partitioned sort.

    Rows stay flat; a category with a third of all pages is no single row or task.
    """
    rows = pages.select(_category(), "path", "title", "status", provenance().alias("provenance"))
    return rows.orderBy("category", path_order(F.col("path")))


def category_tree(pages: DataFrame) -> DataFrame:
    """Pages ordered by category name, then title in locale order."""
    rows = pages.select(_category(), "title", "path")
    return rows.orderBy("category", F.collate("title", "UNICODE"), path_order(F.col("path")))


def category_sizes(pages: DataFrame) -> DataFrame:
    return pages.groupBy(_category()).agg(F.count("*").alias("n_pages"))


def page_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("n_pages"))


def risk_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("n_pages"))


def inbound_degree(edges: DataFrame, pages: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("inbound"))
    return pages.select("path").join(counts, "path", "left").select("path", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def total_degree(edges: DataFrame, pages: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path"))
    counts = ends.groupBy("path").agg(F.count("*").alias("degree"))
    return pages.select("path").join(counts, "path", "left").select("path", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_stats(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages, links and pages without inbound links, in one aggregation."""
    degrees = inbound_degree(edges, pages)
    return degrees.agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum("inbound"), F.lit(0)).alias("links"),
        F.count_if(F.col("inbound") == 0).alias("orphans"),
    )


def entity_mentions(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Entity and concept pages by inbound links, most linked first."""
    named = entity_pages(pages).select("path", "title", "page_type")
    counts = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("mentions"))
    ranked = named.join(counts, "path", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    return ranked.orderBy(F.desc("mentions"), path_order(F.col("path")))


def distinct_types(pages: DataFrame) -> DataFrame:
    return pages.select("page_type").distinct()


def distinct_tags(pages: DataFrame) -> DataFrame:
    return page_tags(pages).select("tag").distinct().orderBy("tag")


def view_counts(pages: DataFrame, open_risks: DataFrame) -> DataFrame:
    """(view, n) of the open risks, open questions and entities."""
    counts = pages.agg(
        F.sum(F.size(F.regexp_extract_all("body", F.lit(OPEN_QUESTION), F.lit(1)))).alias("open_questions"),
        F.count_if(F.col("page_type").isin(*ENTITY_TYPES)).alias("entities"),
    )
    risks = open_risks.agg(F.count("*").alias("n")).select(F.lit("risks").alias("view"), "n")
    return risks.unionByName(counts.unpivot([], counts.columns, "view", "n").select("view", F.coalesce("n", F.lit(0)).alias("n")))
