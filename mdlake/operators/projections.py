"""Column shapes of the page table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.conventions import BLURB, LABEL_KEPT, LABEL_LIMIT, TITLE_CELL
from mdlake.functions.dates import age_text, date_text
from mdlake.functions.text import cut, or_empty


def provenance() -> Column:
    """'source' for pages derived from a source file, else 'synthesized'."""
    return F.when(or_empty(F.col("source")) != "", "source").otherwise("synthesized")


def page_summary(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("path").alias("file"),
        F.substring(or_empty(F.col("fm").getItem("title")), 1, TITLE_CELL).alias("title"),
        or_empty(F.col("category")).alias("category"),
        or_empty(F.col("status")).alias("status"),
        date_text(F.col("last_reviewed"), F.col("last_reviewed_raw")).alias("last_reviewed"),
    )


def page_record(pages: DataFrame) -> DataFrame:
    """The reader's view of a page: no nulls, dates as text."""
    plain = ("category", "status", "owner", "source")
    return pages.select(
        "path", "title", F.col("page_type").alias("type"),
        *[or_empty(F.col(c)).alias(c) for c in plain],
        "tags",
        or_empty(F.col("created_raw")).alias("created"),
        or_empty(F.col("last_reviewed_raw")).alias("last_reviewed"),
        "body",
    )


def review_age(pages: DataFrame, as_of: dt.date | str) -> DataFrame:
    return pages.select("path", age_text(F.col("last_reviewed"), as_of).alias("reviewed"))


# A paragraph is a run of text lines that are no heading, list, table or quote. Fenced blocks are cut out before.
_FENCED = r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\z)"
_OPENING = r"(?s)(?:\A|\n)(?![ \t]*(?:#|>|\||[-*+] |\d+[.)] |\n))[ \t]*([^\n]+.*)"
_PARAGRAPH_END = r"\n(?=[ \t]*(?:#|>|\||[-*+] |\n|\z))"

# From the first tag, emphasis, code, link or image on. An underscore inside a word is text.
_INLINE = r"(?s)(?:<|\*|`|!?\[[^\]]*\]\(|(?<![\p{L}\p{N}])_).*$"


def page_blurb(pages: DataFrame, limit: int = BLURB) -> DataFrame:
    """The start of a page's first paragraph, up to the first inline mark-up."""
    opened = F.regexp_extract(F.regexp_replace("body", _FENCED, "\n"), _OPENING, 1)
    first = F.get(F.split(opened, _PARAGRAPH_END, 2), F.lit(0))
    return pages.select("path", F.substring(F.regexp_replace(first, _INLINE, ""), 1, limit).alias("blurb"))


def labels(pages: DataFrame) -> DataFrame:
    return pages.select("path", cut(F.col("title"), LABEL_LIMIT, LABEL_KEPT).alias("label"))


def search_docs(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("path").alias("id"), "title", or_empty(F.col("category")).alias("category"), "tags", "body"
    )


def column_widths(rows: DataFrame) -> DataFrame:
    """One row: the longest value or header of each column."""
    return rows.agg(
        *[
            F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c))), F.lit(0))).alias(c)
            for c in rows.columns
        ]
    )


def padded_rows(rows: DataFrame) -> DataFrame:
    """Each row as a line of a markdown table with aligned columns."""
    widths = column_widths(rows)
    cells = [F.rpad(F.col(c), widths.select(c).scalar(), " ") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
