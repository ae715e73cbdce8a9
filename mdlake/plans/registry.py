"""Every operator as a query over the corpus derived from a table folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake import corpus
from mdlake.conventions import ACTION_REQUIRED, NOT_ADDRESSED
from mdlake.functions.text import path_order, title_from_path
from mdlake.lake import Lake, derived
from mdlake.operators import aggregates as agg
from mdlake.operators import checks, edges, extract, filters, graph, maintenance, search, sinks
from mdlake.operators import projections as prj
from mdlake.plans import lint, reader
from mdlake.plans import query as page_query
from mdlake.session import shared_dir
from mdlake.sources import companions, documents
from mdlake.sources import pages as page_source
from mdlake.streaming import log_stream as streaming

AS_OF = corpus.AS_OF
SEED = "parts/part-1.md"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
    """Register ``fn(lake)`` under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(derived(spark, sf_dir))
    return fn


def _tags() -> Column:
    return F.array_join("tags", ",").alias("tags")


# Sources


@query
def scan_documents(lake):
    docs = documents.documents_of(lake.docs)
    return docs.select("path", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def scan_excluded(lake):
    return documents.drop_excluded(lake.docs).select("path")


def _fields(read: DataFrame) -> DataFrame:
    return read.select("path", F.explode("fm").alias("field", "value")).where("field NOT IN ('tags', 'mentioned_in')")


@query
def frontmatter(lake):
    return _fields(page_source.frontmatter(documents.drop_excluded(lake.docs), "native"))


@query
def body_split(lake):
    return page_source.body_split(lake.docs).select("path", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@query
def page_table(lake):
    """Parsed from the documents, not from the stored page table."""
    table = page_source.page_table(lake.docs, yaml="native")
    return table.select(
        "path", "title", "page_type", "type", "category", "status", "owner", "source", "source_name", _tags(),
        F.array_join("mentioned_in", ",").alias("mentioned_in"), "created", "last_reviewed",
        F.length("body").alias("n_body"),
    )


@query
def rejected_pages(lake):
    return page_source.rejected_pages(lake.docs, yaml="native")


@query
def source_files(lake):
    return companions.source_files(lake.manifest)


@query
def index_entries(lake):
    return companions.index_entries(lake.index_table)


@query
def change_log(lake):
    return lake.change_log


@query
def source_headers(lake):
    return companions.source_headers(lake.sources)


@query
def page_lines(lake):
    return documents.page_lines(lake.docs)


@query
def manifest(lake):
    return lake.manifest


def _streamed(lake: Lake, stream: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    spark = lake.docs.sparkSession
    base = f"{shared_dir(spark)}/mdlake/log-{uuid.uuid4().hex}"
    lake.log_lines.select("line").write.text(f"{base}/segments")
    streaming.run_once(stream(spark, f"{base}/segments"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("date", "action", "detail")


@query
def log_stream(lake):
    return _streamed(lake, streaming.log_stream)


@query
def log_stream_rejected(lake):
    return _streamed(lake, streaming.rejected_stream)


# Projections


@query
def page_summary(lake):
    return page_query.summary(lake)


@query
def page_record(lake):
    return prj.page_record(lake.texts).withColumn("tags", _tags()).withColumn("body", F.md5("body"))


@query
def title_fallback(lake):
    return lake.pages.select("path", title_from_path(F.col("path")).alias("title"))


@query
def page_type(lake):
    return lake.pages.select("path", "page_type", checks.is_meta().alias("lint_exempt_meta"))


@query
def provenance(lake):
    return lake.pages.select("path", prj.provenance().alias("provenance"))


@query
def review_age(lake):
    return prj.review_age(lake.pages, AS_OF)


@query
def page_blurb(lake):
    return prj.page_blurb(lake.texts)


@query
def format_date(lake):
    return prj.page_summary(lake.pages).select("file", "last_reviewed")


@query
def label_truncate(lake):
    return prj.labels(lake.pages)


@query
def column_widths(lake):
    return prj.column_widths(page_query.summary(lake))


@query
def table_lines(lake):
    return prj.padded_rows(page_query.summary(lake))


@query
def search_docs(lake):
    return prj.search_docs(lake.texts).withColumn("tags", _tags()).withColumn("body", F.md5("body"))


# Filters


@query
def filter_status(lake):
    return filters.by_status(lake.pages, "draft").select("path")


@query
def filter_category(lake):
    return filters.by_category(lake.pages, "brand#1").select("path")


@query
def filter_type(lake):
    return filters.by_type(lake.pages, "Meta").select("path")


@query
def filter_tag(lake):
    return filters.by_tag(lake.pages, "Widget").select("path")


@query
def filter_stale(lake):
    return filters.stale(lake.pages, 250, AS_OF).select("path")


@query
def filter_all(lake):
    return page_query.summary(
        lake, status="Draft", category="brand", page_type="use-case", tag="small", stale_days=200, as_of=AS_OF
    )


@query
def open_status(lake):
    rows = lake.risk_rows
    marks = (ACTION_REQUIRED, NOT_ADDRESSED)
    status = F.col("status")
    return rows.select(
        "path", "pos", filters.has_marker(status, *marks).alias("holds"),
        filters.has_marker(status, *marks, leading=True).alias("leads"),
    )


_VISIBLE = {"types": ["use-case", "entity"], "text": "1", "tags": ["small", "widget", "supplier"]}


@query
def visible_nodes(lake):
    return filters.visible_nodes(lake.pages, **_VISIBLE).select("path")


@query
def entity_pages(lake):
    return filters.entity_pages(lake.pages).select("path", "page_type")


@query
def filename_convention(lake):
    return filters.misnamed(lake.pages)


# Extraction


@query
def headings(lake):
    return extract.headings(lake.texts)


@query
def risk_rows(lake):
    return lake.risk_rows


@query
def open_risks(lake):
    return extract.open_risks(lake.risk_rows)


@query
def open_risks_query(lake):
    return page_query.risks(lake)


@query
def open_risks_lint(lake):
    return extract.lint_risks(documents.drop_excluded(lake.open_rows, "lint"))


@query
def open_questions(lake):
    return extract.open_questions(lake.texts)


@query
def raw_links(lake):
    return extract.raw_links(lake.pages)


@query
def mentions(lake):
    return extract.mentions(lake.pages)


@query
def source_refs(lake):
    return extract.source_refs(lake.texts)


@query
def page_tags(lake):
    return extract.page_tags(lake.pages)


@query
def risk_status_mix(lake):
    return extract.risk_status_mix(lake.risk_rows)


@query
def risks_sorted(lake):
    rows = extract.open_risks(lake.risk_rows).select("page_title", "risk", "likelihood", "impact", "status", "path", "pos")
    return rows.orderBy("likelihood", "risk", path_order(F.col("path")), "pos")


# Edges and graph


@query
def resolved_links(lake):
    return edges.resolved_links(lake.pages, lake.hot_pages)


@query
def resolved_mentions(lake):
    return edges.resolved_mentions(lake.pages, lake.hot_pages)


@query
def edges_(lake):
    return edges.edges(lake.pages, lake.hot_pages)


QUERIES["edges"] = QUERIES.pop("edges_")


@query
def edge_list(lake):
    return lake.edges.orderBy("src", "dst")


@query
def mention_titles(lake):
    return edges.mention_titles(lake.edges, lake.pages, lake.hot_pages)


@query
def visible_edges(lake):
    return graph.visible_subgraph(lake.edges, lake.pages, lake.hot_pages, **_VISIBLE)


@query
def visible_subgraph(lake):
    return graph.visible_subgraph(lake.edges, lake.pages, lake.hot_pages, types=["use-case", "entity"], tags=["widget", "nation"])


@query
def shared_entity_groups(lake):
    return edges.shared_entities(lake.edges, lake.pages, lake.hot_pages)


@query
def inbound_degree(lake):
    return agg.inbound_degree(lake.edges, lake.pages)


@query
def total_degree(lake):
    return agg.total_degree(lake.edges, lake.pages)


@query
def graph_stats(lake):
    return agg.graph_stats(lake.edges, lake.pages)


@query
def graph_nodes(lake):
    return graph.graph_nodes(lake.edges, lake.pages).withColumn("tags", _tags())


@query
def orphan_pages(lake):
    return graph.orphan_pages(lake.edges, lake.pages)


@query
def node_weight(lake):
    return graph.node_weight(lake.edges, lake.pages).withColumn("weight", F.round("weight", 6))


@query
def entity_mentions(lake):
    return agg.entity_mentions(lake.edges, lake.pages)


def _ball(lake: Lake) -> DataFrame:
    return graph.k_hop(lake.links, lake.pages.where(F.col("path") == SEED).select("path"), hops=2, hot=lake.hot_pages)


@query
def k_hop(lake):
    return _ball(lake)


@query
def k_hop_many(lake):
    seeds = filters.entity_pages(lake.pages)
    return graph.reach_counts(graph.k_hop_many(lake.links, seeds, 2, lake.hot_pages)[1])


@query
def edge_highlight(lake):
    return graph.edge_highlight(lake.edges, _ball(lake), SEED, lake.hot_pages)


# Checks


for _name in checks.LOCAL:
    QUERIES[f"check_{_name}"] = lambda spark, sf_dir, name=_name: checks.local_check(derived(spark, sf_dir).texts_of("lint"), name)


@query
def check_open_risk(lake):
    return checks.open_risk(documents.drop_excluded(lake.open_rows, "lint"))


@query
def check_source_missing(lake):
    return checks.source_missing(lake.pages_of("lint"), lake.source_files, lake.hot_sources)


@query
def check_mentioned_in_missing(lake):
    return checks.mentioned_in_missing(lake.pages_of("lint"), hot=lake.hot_pages)


@query
def check_mentioned_in_missing_stripped(lake):
    return checks.mentioned_in_missing(lake.pages_of("lint"), strip_dot_slash=True, hot=lake.hot_pages)


@query
def check_not_in_index(lake):
    return checks.not_in_index(lake.pages_of("lint"), lake.index_entries)


@query
def check_orphan_source(lake):
    return checks.orphan_source(lake.pages_of("lint"), lake.source_files)


@query
def check_index_dead_link(lake):
    return checks.index_dead_link(lake.pages_of("lint"), lake.index_entries, lake.manifest)


@query
def findings(lake):
    return lint.findings(lake)


@query
def findings_by_check(lake):
    return lint.by_check(lake)


@query
def findings_totals(lake):
    return lint.totals(lake)


@query
def findings_json(lake):
    return lint.as_json(lake)


@query
def findings_report(lake):
    return lint.report(lake)


# Aggregates and order


@query
def page_count(lake):
    return page_query.summary_count(lake, status="Draft")


@query
def risk_totals(lake):
    return page_query.risks_count(lake)


@query
def pages_by_category(lake):
    return agg.pages_by_category(lake.pages)


@query
def category_tree(lake):
    return agg.category_tree(lake.pages)


@query
def category_sizes(lake):
    return agg.category_sizes(lake.pages)


@query
def distinct_types(lake):
    return agg.distinct_types(lake.pages)


@query
def distinct_tags(lake):
    return agg.distinct_tags(lake.pages)


@query
def view_counts(lake):
    return agg.view_counts(lake.texts, extract.open_risks(lake.risk_rows))


@query
def order_by_path(lake):
    return lake.pages.select("path").orderBy(path_order(F.col("path")))


@query
def recent_changes(lake):
    return companions.recent_changes(lake.change_log)


@query
def reader_bundle(lake):
    return sinks.reader_bundle(reader.collections(lake))


# Search


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", F.round("score", 4))


def _indexed(lake: Lake, asked: str, **kinds: bool) -> tuple[search.Index, str]:
    """An index that serves one query, and the query."""
    return search.build_index(prj.search_docs(lake.texts), (asked,), **kinds), asked


_EXACT = {"prefix": False, "fuzzy": False}
_PREFIX = {"prefix": True, "fuzzy": False}
_FUZZY = {"prefix": False, "fuzzy": True}


@query
def tokens(lake):
    return search.tokens(prj.search_docs(lake.texts))


@query
def inverted_index(lake):
    return search.inverted_index(prj.search_docs(lake.texts))


@query
def search_exact(lake):
    return _rounded(search.search(*_indexed(lake, "small widget", **_EXACT), **_EXACT))


@query
def search_prefix(lake):
    return _rounded(search.search(*_indexed(lake, "widg presu prereq", **_PREFIX), **_PREFIX))


@query
def search_fuzzy(lake):
    return _rounded(search.search(*_indexed(lake, "widgit prerequisit", **_FUZZY), **_FUZZY))


@query
def search_ranked(lake):
    return _rounded(search.best(*_indexed(lake, "smal widgit brand")).hits)


@query
def search_topk(lake):
    return _rounded(search.best(*_indexed(lake, "red widget", **_EXACT), **_EXACT).hits)


@query
def search_hits(lake):
    return _rounded(search.search_hits(search.best(*_indexed(lake, "blue bolt economy")).hits, lake.pages))


# Upkeep


@query
def source_drift(lake):
    fresh = corpus.refetched(lake.docs.sparkSession, lake.origin)
    return maintenance.source_drift(lake.sources, fresh, digests=lake.source_digests)


@query
def section_coverage(lake):
    return maintenance.section_coverage(lake.texts, lake.sources, lake.hot_sources)


@query
def coverage_ratio(lake):
    return maintenance.coverage_ratio(lake.texts, lake.sources, hot=lake.hot_sources).withColumn("ratio", F.round("ratio", 6))


@query
def header_violations(lake):
    return maintenance.header_violations(lake.sources)


@query
def log_violations(lake):
    return maintenance.log_violations(lake.log_lines)
