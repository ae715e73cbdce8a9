"""The link graph: links and back-link lists resolved against the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.operators.extract import mentions, raw_links
from mdlake.operators.joins import TARGET_ROWS, Hot, frequent, skew_join


def link_ends(pages: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """(key, slices) of pages that are an end of many links or back-links, as a name in other pages' lists or by their own lists.

    One pass over slim columns of the page table; nothing is grouped by page but the few that are frequent.
    """
    listed = F.transform("mentioned_in", lambda x: F.translate(x, "\\", "/"))
    bare = F.transform(listed, lambda x: F.regexp_replace(x, r"^\./", ""))
    named = pages.select(F.explode(F.concat("links", bare, F.array_except(listed, bare))).alias("key"))
    own = pages.select(F.col("path").alias("key"), (F.size("links") + F.size("mentioned_in")).cast("bigint").alias("n"))
    often = frequent(named, target // 4).union(own.where(F.col("n") > target // 4)).groupBy("key").agg(F.sum("n").alias("n"))
    return often.where(F.col("n") > target).select("key", F.ceil(F.col("n") / target).cast("int").alias("slices"))


def resolved_links(pages: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Distinct (src, dst) of links to existing other pages."""
    links = raw_links(pages).where("src <> target").distinct()
    known = pages.select(F.col("path").alias("target"))
    return skew_join(links, known, "target", "left_semi", "src", hot=hot).select("src", F.col("target").alias("dst"))


def resolved_mentions(pages: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Distinct (src, dst) from back-link lists: referrer to page."""
    listed = mentions(pages).where("referrer <> path").distinct()
    known = pages.select(F.col("path").alias("referrer"))
    return skew_join(listed, known, "referrer", "left_semi", "path", hot=hot).select(
        F.col("referrer").alias("src"), F.col("path").alias("dst")
    )


def edges(pages: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Distinct directed edges; both kinds are resolved in one join on the far end."""
    links = raw_links(pages).select(F.col("src").alias("near"), F.col("target").alias("far"), F.lit(True).alias("out"))
    back = mentions(pages).select(F.col("path").alias("near"), F.col("referrer").alias("far"), F.lit(False).alias("out"))
    ends = links.unionByName(back).where("near <> far").distinct()
    known = pages.select(F.col("path").alias("far"))
    found = skew_join(ends, known, "far", "left_semi", "near", hot=hot)
    return found.select(
        F.when(F.col("out"), F.col("near")).otherwise(F.col("far")).alias("src"),
        F.when(F.col("out"), F.col("far")).otherwise(F.col("near")).alias("dst"),
    ).distinct()


def mention_titles(edges_df: DataFrame, pages: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Both neighbour lists of every page with titles; the path where there is no title."""
    ends = edges_df.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("path"), F.lit("mentions").alias("direction"), F.col("dst").alias("other")),
                F.struct(F.col("dst").alias("path"), F.lit("mentioned_by").alias("direction"), F.col("src").alias("other")),
            )
        )
    )
    titles = pages.select(F.col("path").alias("other"), "title")
    named = skew_join(ends, titles, "other", "left", "path", hot=hot)
    return named.select("path", "direction", "other", F.coalesce("title", "other").alias("title"))


def keep_between(edges_df: DataFrame, nodes: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Edges whose two ends are in ``nodes(path)``."""
    ids = nodes.select("path")
    inner = skew_join(edges_df, ids.withColumnRenamed("path", "dst"), "dst", "left_semi", "src", hot=hot)
    return skew_join(inner, ids.withColumnRenamed("path", "src"), "src", "left_semi", "dst", hot=hot).select("src", "dst")


def shared_entities(edges_df: DataFrame, pages: DataFrame, hot: Hot | None = None) -> DataFrame:
    """(entity, page, n_pages) of entities that two or more pages link to.

    The pages of one entity are to be read together when looking for
    contradictions. Listing them grows with the edges; listing pairs would grow
    with the square of the largest group.
    """
    counts = edges_df.groupBy("dst").agg(F.count("*").alias("n_pages")).where("n_pages >= 2")
    named = pages.where(F.col("page_type").isin("entity", "concept")).select(F.col("path").alias("dst"))
    shared = counts.join(named, "dst", "left_semi")
    return skew_join(edges_df, shared, "dst", "inner", "src", hot=hot).select(
        F.col("dst").alias("entity"), F.col("src").alias("page"), "n_pages"
    )
