"""Upkeep reports: sources against pages and against their origin, the log's form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.functions.columns import once
from mdlake.operators.extract import heading_list
from mdlake.operators.joins import TARGET_ROWS, Hot, frequent, skew_join
from mdlake.session import stored
from mdlake.sources.companions import header_field, log_fields, source_body, source_headers


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def _shingles(text: Column, size: int) -> Column:
    """Distinct hashes of all runs of ``size`` words; a shorter text is one shingle."""
    # a list of one gives the word list a name inside the lambda
    runs = F.transform(
        F.array(_words(text)),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))),
            lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(size)), " ")),
        ),
    )
    return F.array_distinct(F.flatten(runs))


SLOTS = 1 << 20


def _slot() -> Column:
    return F.pmod(F.xxhash64("name"), F.lit(SLOTS)).cast("int")


def source_digests(source_docs: DataFrame) -> DataFrame:
    """(name, was): the digest of the text below the header block, of sources that have a URL. Made once per corpus."""
    has_url = header_field(F.col("text"), "url").isNotNull()
    return source_docs.where(has_url).select("name", F.sha2(source_body(F.col("text")), 256).alias("was"))


def source_drift(source_docs: DataFrame, refetched: DataFrame, below: float = 0.8, size: int = 5, digests: DataFrame | None = None) -> DataFrame:
    """(name, similarity) of sources with a URL whose text today differs substantially.

    ``refetched(name, text)`` is what the URLs return now. Unchanged texts are told by their digest, which for saved ones may be known
    already (``digests``, as of :func:`source_digests`); only the others are compared, by hashes of their word shingles, so no text travels.
    """
    saved = source_docs.select("name", source_body(F.col("text")).alias("saved"))
    fresh = refetched.select("name", F.col("text").alias("fresh"))
    # names and digests meet first
    digests = (source_digests(source_docs) if digests is None else digests).join(fresh.select("name", F.sha2("fresh", 256).alias("now")), "name")
    names = stored(digests.where("was <> now").select("name"), "changed-names")
    # at most SLOTS numbers: texts that cannot have changed are left where they are, the rest meet by name
    slots = F.broadcast(names.select(_slot().alias("slot")).distinct())

    def travelling(texts: DataFrame) -> DataFrame:
        return texts.withColumn("slot", _slot()).join(slots, "slot", "left_semi").drop("slot")

    def hashed(texts: DataFrame, text: str, name: str) -> DataFrame:
        return once(travelling(texts), set=_shingles(F.col(text), size)).select("name", F.col("set").alias(name))

    sets = hashed(saved, "saved", "a").join(names, "name", "left_semi").join(hashed(fresh, "fresh", "b"), "name")
    sets = once(sets, common=F.size(F.array_intersect("a", "b")))
    measured = sets.withColumn("similarity", F.col("common") / (F.size("a") + F.size("b") - F.col("common")))
    return measured.where(F.col("similarity") < below).select("name", F.round("similarity", 6).alias("similarity"))


def shared_sources(pages: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """(key, slices) of sources that many pages name."""
    often = frequent(pages.select(F.col("source_name").alias("key")), target)
    return often.select("key", F.ceil(F.col("n") / target).cast("int").alias("slices"))


def _derived(pages: DataFrame, sources: DataFrame, hot: Hot | None, *columns: Column) -> DataFrame:
    """Pages next to the source they name; one source may feed many pages."""
    named = pages.where("source_name IS NOT NULL").select("path", "source_name", *columns)
    return skew_join(named, sources, "source_name", "inner", "path", hot=hot)


def section_coverage(pages: DataFrame, source_docs: DataFrame, hot: Hot | None = None) -> DataFrame:
    """(path, source_name, heading): headings of a source that its page lacks."""

    def keys(text: Column) -> Column:
        return F.transform(heading_list(text), lambda h: F.lower(F.trim(h)))

    there = source_docs.select(F.col("name").alias("source_name"), keys(F.col("text")).alias("wanted"))
    both = _derived(pages, there, hot, keys(F.col("body")).alias("present"))
    lacking = once(both, lacking=F.array_except("wanted", "present"))
    return lacking.select("path", "source_name", F.explode("lacking").alias("heading"))


def coverage_ratio(pages: DataFrame, source_docs: DataFrame, below: float | None = None, hot: Hot | None = None) -> DataFrame:
    """(path, source_name, ratio): page length over source length."""
    there = source_docs.select(F.col("name").alias("source_name"), F.length(source_body(F.col("text"))).alias("n_source"))
    both = _derived(pages, there, hot, F.length("body").alias("n_page"))
    ratio = F.try_divide(F.col("n_page").cast("double"), F.col("n_source").cast("double"))
    out = both.select("path", "source_name", ratio.alias("ratio"))
    return out if below is None else out.where(F.col("ratio") < below)


def header_violations(source_docs: DataFrame) -> DataFrame:
    """(name, missing) of sources without a full header block; the URL is optional."""
    headers = source_headers(source_docs)
    missing = F.array_compact(
        F.array(
            F.when(F.col("source_type").isNull(), "source_type"),
            F.when(F.col("fetched").isNull(), "fetched"),
        )
    )
    return headers.select("name", F.explode(missing).alias("missing"))


def log_violations(log_lines: DataFrame) -> DataFrame:
    """(line_no, line, reason): headings that are no entry, impossible dates, no init entry."""
    fields = log_fields(log_lines)
    reason = (
        F.when(F.startswith("line", F.lit("##")) & F.col("date").isNull(), "no_entry")
        .when(F.col("date").isNotNull() & F.col("log_date").isNull(), "impossible_date")
    )
    bad = fields.select("line_no", "line", reason.alias("reason")).where("reason IS NOT NULL")
    inits = fields.agg(F.count_if(F.col("action") == "init").alias("n")).where("n = 0")
    return bad.unionByName(
        inits.select(F.lit(None).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit("no_init_entry").alias("reason"))
    )
