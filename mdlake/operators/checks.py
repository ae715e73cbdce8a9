"""Integrity checks. Each yields (file, check, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.conventions import (
    CHECK_DETAILS, CHECK_LABELS, ENTITY_SECTIONS, ENTITY_TYPES, REQUIRED_FIELDS, USE_CASE_SECTIONS,
)
from mdlake.functions.columns import once
from mdlake.functions.text import or_empty
from mdlake.operators.extract import heading_list, lint_risks, mentions, open_risk_notes, preview, source_ref_list
from mdlake.operators.joins import Hot, skew_join


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _detail(check: str, *values: Column) -> Column:
    return F.format_string(CHECK_DETAILS[check], *values)


def is_entity() -> Column:
    return F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False))


def is_meta() -> Column:
    """Free-form pages; ``type: meta`` alone is enough here."""
    by_category = F.contains(F.lower(or_empty(F.col("category"))), F.lit("meta"))
    return by_category | (or_empty(F.col("type")) == "meta")


def _has_source() -> Column:
    return or_empty(F.col("source")) != ""


# Page-local checks as arrays of details.

def missing_fields() -> Column:
    gaps = F.filter(_texts(REQUIRED_FIELDS), lambda f: F.coalesce(F.col("fm")[f], F.lit("")) == "")
    return F.transform(gaps, lambda f: _detail("frontmatter", f))


def missing_sections() -> Column:
    def gaps(kind: str, required: tuple[str, ...]) -> Column:
        # a list of one gives the headings a name, so they are extracted once;
        # a line feed cannot occur inside a heading
        seen = F.array(F.lower(F.array_join(heading_list(F.col("text")), "\n")))
        absent = F.flatten(
            F.transform(seen, lambda h: F.filter(_texts(required), lambda s: ~F.contains(h, F.lower(s))))
        )
        return F.transform(absent, lambda s: _detail("missing_section", F.lit(kind), s))

    return F.when(is_entity(), gaps("entity", ENTITY_SECTIONS)).when(~is_meta(), gaps("use-case", USE_CASE_SECTIONS))


def likely_missing_source() -> Column:
    candidate = ~_has_source() & ~is_entity() & ~is_meta() & F.contains("text", F.lit("sources/"))
    # transform over a list of one gives the reference list a name
    notes = F.transform(
        F.array(source_ref_list(F.col("text"))),
        lambda refs: F.when(F.size(refs) > 0, _detail("likely_missing_source", preview(refs))),
    )
    return F.when(candidate, F.array_compact(notes))


def open_risk_details() -> Column:
    return F.transform(open_risk_notes(F.col("text")), lambda r: _detail("open_risk", r))


LOCAL = {
    "frontmatter": missing_fields,
    "likely_missing_source": likely_missing_source,
    "missing_section": missing_sections,
    "open_risk": open_risk_details,
}


def local_check(pages: DataFrame, check: str) -> DataFrame:
    """One page-local check."""
    found = once(pages, details=LOCAL[check]())
    return found.select(F.col("path").alias("file"), F.lit(check).alias("check"), F.explode("details").alias("detail"))


def with_details(pages: DataFrame) -> DataFrame:
    """Pages with ``details``, an array of (check, detail) of all page-local checks, from one pass over the texts."""
    none = F.array().cast("array<string>")

    def tagged(check: str) -> Column:
        return F.transform(
            F.coalesce(LOCAL[check](), none), lambda d: F.struct(F.lit(check).alias("check"), d.alias("detail"))
        )

    return once(pages, details=F.concat(*[tagged(check) for check in LOCAL]))


def local_details(checked: DataFrame) -> DataFrame:
    """The findings in ``details``."""
    return checked.select(F.col("path").alias("file"), F.explode("details").alias("f")).select("file", "f.*")


def local_findings(pages: DataFrame) -> DataFrame:
    """All page-local checks in one pass over the texts."""
    return local_details(with_details(pages))


# Checks against other tables: slim columns only, no text.

def open_risk(open_rows: DataFrame) -> DataFrame:
    """One finding per row of :func:`extract.open_rows` that is not yet addressed."""
    return lint_risks(open_rows).select(
        F.col("path").alias("file"), F.lit("open_risk").alias("check"), _detail("open_risk", F.col("risk")).alias("detail")
    )


def source_missing(pages: DataFrame, source_files: DataFrame, hot: Hot | None = None) -> DataFrame:
    named = pages.where(_has_source()).select("path", "source", "source_name")
    lost = skew_join(named, source_files.withColumnRenamed("name", "source_name"), "source_name", "left_anti", "path", hot=hot)
    return lost.select(
        F.col("path").alias("file"), F.lit("source_missing").alias("check"),
        _detail("source_missing", F.col("source")).alias("detail"),
    )


def mentioned_in_missing(pages: DataFrame, strip_dot_slash: bool = False, hot: Hot | None = None) -> DataFrame:
    """Back-links to nowhere. A leading ``./`` is part of the name unless stripped."""
    refs = mentions(pages.where(is_entity()), strip_dot_slash)
    lost = skew_join(refs, pages.select(F.col("path").alias("referrer")), "referrer", "left_anti", "path", hot=hot)
    return lost.select(
        F.col("path").alias("file"), F.lit("mentioned_in_missing").alias("check"),
        _detail("mentioned_in_missing", F.col("referrer")).alias("detail"),
    )


def not_in_index(pages: DataFrame, index_entries: DataFrame) -> DataFrame:
    lost = pages.select("path").join(index_entries.select(F.col("entry").alias("path")), "path", "left_anti")
    return lost.select(
        F.col("path").alias("file"), F.lit("not_in_index").alias("check"), F.lit(CHECK_DETAILS["not_in_index"]).alias("detail")
    )


def orphan_source(pages: DataFrame, source_files: DataFrame) -> DataFrame:
    used = pages.where(_has_source()).select(F.col("source_name").alias("name")).distinct()
    return source_files.join(used, "name", "left_anti").select(
        F.concat(F.lit("sources/"), "name").alias("file"), F.lit("orphan_source").alias("check"),
        F.lit(CHECK_DETAILS["orphan_source"]).alias("detail"),
    )


def index_dead_link(pages: DataFrame, index_entries: DataFrame, manifest: DataFrame) -> DataFrame:
    entry = index_entries.select(F.translate("entry", "\\", "/").alias("path"))
    lost = entry.join(pages.select("path"), "path", "left_anti").join(manifest.select("path"), "path", "left_anti")
    return lost.select(
        F.lit("index.md").alias("file"), F.lit("index_dead_link").alias("check"),
        _detail("index_dead_link", F.col("path")).alias("detail"),
    )


def findings(
    pages: DataFrame, source_files: DataFrame, index_entries: DataFrame, manifest: DataFrame, hot_pages: Hot | None = None, hot_sources: Hot | None = None,
    local: DataFrame | None = None,
) -> DataFrame:
    """All nine checks: one pass over the texts and five joins over slim columns. ``local`` are the page-local findings, if ``pages`` come without text."""
    parts = [
        local_findings(pages) if local is None else local,
        source_missing(pages, source_files, hot_sources),
        mentioned_in_missing(pages, hot=hot_pages),
        not_in_index(pages, index_entries),
        orphan_source(pages, source_files),
        index_dead_link(pages, index_entries, manifest),
    ]
    return reduce(DataFrame.unionByName, parts)


def label() -> Column:
    """Heading of a check; an unknown check is its own heading."""
    names = F.create_map(*[F.lit(x) for pair in CHECK_LABELS.items() for x in pair])
    return F.coalesce(names[F.col("check")], F.col("check"))


def by_check(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count("*").alias("n_findings")).select("check", label().alias("label"), "n_findings")


def totals(found: DataFrame) -> DataFrame:
    risk = F.count_if(F.col("check") == "open_risk")
    return found.agg(
        F.count("*").alias("total"), risk.alias("open_risks"), (F.count("*") - risk).alias("structural")
    )
