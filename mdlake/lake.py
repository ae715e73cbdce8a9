"""The tables all operators share, written once per corpus.

Parsing touches every byte of the corpus; most of what follows needs a few
columns. So the fields and links of all pages are written once into a slim Parquet
table, which operators scan with column pruning and pushed filters. Texts are never
written again: what needs them parses the documents as it reads them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from mdlake import corpus
from mdlake.operators import checks, edges, extract, graph, maintenance, projections, search
from mdlake.operators.joins import Hot
from mdlake.session import stored
from mdlake.sources import companions, documents, pages


@dataclass
class Lake:
    """A corpus as tables; the derived ones are written on first use."""

    docs: DataFrame
    manifest: DataFrame
    index_lines: DataFrame
    log_lines: DataFrame
    yaml: str = "auto"
    origin: str | None = None  # the folder a derived corpus comes from
    source_docs: DataFrame | None = None  # the documents below sources/, where they come as a table of their own

    @cached_property
    def _all_texts(self) -> DataFrame:
        """Parsed under the widest profile, each time it is read."""
        return pages.page_table(self.docs, "query", self.yaml)

    @cached_property
    def _all_pages(self) -> DataFrame:
        """Without text and body, parsed once."""
        return stored(self._all_texts.drop("text", "body"), "pages")

    @cached_property
    def _all_checked(self) -> DataFrame:
        """The details of the page-local checks, found in the pass that writes the fields and links where no other query has written these before."""
        checked = checks.with_details(self._all_texts)
        if "_all_pages" in self.__dict__:
            return stored(checked.select("path", "details"), "page-checks")
        both = stored(checked.drop("text", "body"), "pages")
        self._all_pages = both.drop("details")
        return both.select("path", "details")

    def pages_of(self, profile: str) -> DataFrame:
        """The pages as query, lint or reader see them; they differ in the folders they leave out. Fields and links only."""
        return documents.drop_excluded(self._all_pages, profile)

    def texts_of(self, profile: str) -> DataFrame:
        """The same pages with text and body."""
        return documents.drop_excluded(self._all_texts, profile)

    @property
    def pages(self) -> DataFrame:
        """The reader's pages: fields and links."""
        return self.pages_of("reader")

    @property
    def texts(self) -> DataFrame:
        """The reader's pages with text and body."""
        return self.texts_of("reader")

    @cached_property
    def hot_pages(self) -> Hot:
        """Pages that many links meet: every join on a page's path spreads these."""
        return Hot(stored(edges.link_ends(self._all_pages), "hot-pages"))

    @cached_property
    def hot_sources(self) -> Hot:
        """Sources that many pages name."""
        return Hot(stored(maintenance.shared_sources(self._all_pages), "hot-sources"))

    @cached_property
    def risk_rows(self) -> DataFrame:
        return stored(extract.risk_rows(self.texts), "risk-rows")

    @cached_property
    def open_rows(self) -> DataFrame:
        """Open rows of all tables with Risk and Likelihood columns."""
        return stored(extract.open_rows(self._all_texts), "open-rows")

    @cached_property
    def links(self) -> DataFrame:
        """The edges in both directions."""
        return stored(graph.both_ways(self.edges), "links")

    @cached_property
    def sources(self) -> DataFrame:
        """The source files on their own."""
        return companions.sources(self.docs if self.source_docs is None else self.source_docs)

    @cached_property
    def source_digests(self) -> DataFrame:
        """The digests of saved sources that have a URL."""
        return stored(maintenance.source_digests(self.sources), "source-digests")

    @cached_property
    def source_files(self) -> DataFrame:
        return stored(companions.source_files(self.manifest), "source-files")

    @cached_property
    def index_table(self) -> DataFrame:
        """The lines of the index, which are read several times."""
        return stored(self.index_lines, "index")

    @cached_property
    def index_entries(self) -> DataFrame:
        return stored(companions.index_entries(self.index_table), "index-entries")

    @cached_property
    def edges(self) -> DataFrame:
        return stored(edges.edges(self.pages, self.hot_pages), "edges")

    @cached_property
    def findings(self) -> DataFrame:
        """All findings; reports, counts and exports read them from here."""
        return stored(self.checked(), "findings")

    def checked(self) -> DataFrame:
        """All findings, joined anew."""
        local = checks.local_details(documents.drop_excluded(self._all_checked, "lint"))
        return checks.findings(
            self.pages_of("lint"), self.source_files, self.index_entries, self.manifest, self.hot_pages, self.hot_sources, local
        )

    @cached_property
    def search_index(self) -> search.Index:
        return search.build_index(projections.search_docs(self.texts))

    @cached_property
    def change_log(self) -> DataFrame:
        return companions.change_log(self.log_lines)


def open_folder(spark: SparkSession, root: str, yaml: str = "auto") -> Lake:
    """A folder of markdown files as a lake."""
    return Lake(
        docs=documents.scan_documents(spark, root),
        manifest=documents.manifest(spark, root),
        index_lines=documents.read_root_lines(spark, root, "index.md"),
        log_lines=documents.read_root_lines(spark, root, "log.md"),
        yaml=yaml,
    )


_DERIVED: dict[tuple[str, str], Lake] = {}


def derived(spark: SparkSession, sf_dir: str) -> Lake:
    """The corpus derived from the tables in ``sf_dir``, once per application.

    Every text of the corpus follows from a row of the tables, so nothing is written until a query needs one of the shared tables.
    """
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _DERIVED:
        docs = corpus.docs(spark, sf_dir)
        _DERIVED[key] = Lake(
            docs=docs,
            manifest=corpus.manifest(spark, sf_dir, docs),
            index_lines=corpus.index_lines(spark, sf_dir),
            log_lines=corpus.log_lines(spark, sf_dir),
            yaml="native",
            origin=str(sf_dir),
            source_docs=corpus.source_docs(spark, sf_dir),
        )
    return _DERIVED[key]
