"""The files beside the pages: index, change log, source folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdlake.conventions import BREAK, INDEX_LINK, LOG_ENTRY, SOURCE_FILE, SOURCE_HEADER
from mdlake.functions.columns import once
from mdlake.functions.dates import day
from mdlake.functions.text import basename

_FIRST_PLAIN_LINE = r"(?md)^(?!>)"
CHUNK = 65536  # lines per window partition


def _in_sources() -> Column:
    # the plain prefix reaches the Parquet scan, the pattern does not
    return F.startswith("path", F.lit("sources/")) & F.col("path").rlike(SOURCE_FILE)


def source_files(manifest: DataFrame) -> DataFrame:
    """Names of the regular, visible files directly below ``sources/``."""
    return (
        manifest.where(_in_sources()).select(basename(F.col("path")).alias("name")).distinct()
    )


def without_comments(lines: DataFrame) -> DataFrame:
    """A line table with ``<!-- … -->`` removed, also across lines.

    What a line does to the state "inside a comment" follows from its marks: it sets it, or, by an odd number of marks like
    ``<!-->`` that open outside and close inside, turns it over. The state is carried within chunks of CHUNK
    lines and, over one row per chunk, between them; so a file of any length
    is spread over many tasks. An opening mark that is never closed is text.
    ``joined`` tells whether the line break before a line went with a comment.
    """
    line, end = F.col("line"), F.col("last_close")
    closes = F.contains(line, F.lit("-->"))
    marks = F.regexp_extract_all("line", F.lit("(<!--->|<!-->|<!--|-->)"), F.lit(1))

    def behind(state: bool) -> Column:
        return F.aggregate("marks", F.lit(state), lambda s, m: F.when(m == "-->", False).when(m == "<!--", True).otherwise(~s))

    chunks = W.partitionBy("path", "chunk").orderBy("line_no")
    marked = once(lines.withColumn("chunk", F.floor(F.col("line_no") / CHUNK)), marks=marks)
    marked = once(marked, outside=behind(False), inside=behind(True))
    marked = marked.select(
        "path", "line_no", "line", "chunk", F.when(F.col("outside") == F.col("inside"), F.col("outside")).alias("sets"),
        (F.col("outside") & ~F.col("inside")).cast("int").alias("turns"),
    )
    marked = marked.withColumn("turned", F.sum("turns").over(chunks.rowsBetween(W.unboundedPreceding, 0)))
    last_set = F.when(F.col("sets").isNotNull(), F.col("line_no"))
    by_chunk = marked.groupBy("path", "chunk").agg(
        F.max_by("sets", last_set).alias("sets"), F.max_by("turned", last_set).alias("turned_at"), F.max("turned").alias("turns"),
        F.max(F.when(closes, F.col("line_no"))).alias("last_close"),
    )

    def state(sets: str, turned: str, window, start: Column) -> Column:
        """The state before a row: what was set last, turned over as often as came after that."""
        set_before = F.last(sets, ignorenulls=True).over(window)
        turned_then = F.last(F.when(F.col(sets).isNotNull(), F.col(turned)), ignorenulls=True).over(window)
        odd = (F.coalesce(F.max(turned).over(window), F.lit(0)) - F.coalesce(turned_then, F.lit(0))) % 2 == 1
        return F.coalesce(set_before, start) != odd

    # one row per chunk
    whole_file = W.partitionBy("path")
    so_far = whole_file.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    after_set = F.col("turns") - F.coalesce("turned_at", F.lit(0))  # turns behind a chunk's last setting line, or all
    by_chunk = by_chunk.select("path", "chunk", "last_close", (F.col("sets") != (after_set % 2 == 1)).alias("sets"), F.when(F.col("sets").isNull(), after_set).otherwise(0).alias("turns"))
    by_chunk = by_chunk.withColumn("turned", F.sum("turns").over(whole_file.orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)))
    spans = by_chunk.select(
        "path", "chunk", state("sets", "turned", so_far, F.lit(False)).alias("enters_inside"), F.max("last_close").over(whole_file).alias("last_close")
    )
    placed = marked.join(spans, ["path", "chunk"])

    inside = state("sets", "turned", chunks.rowsBetween(W.unboundedPreceding, -1), F.col("enters_inside"))
    # behind the last closing mark of the file nothing is a comment
    within = F.coalesce(F.col("line_no") <= end, F.lit(False))
    resumed = F.when(closes, F.substring(line, F.locate("-->", line) + 3, F.length(line))).otherwise("")
    visible = F.when(within & F.col("inside"), resumed).otherwise(line)
    closed = F.regexp_replace(visible, "<!--.*?-->", "")
    cut = F.when(F.col("line_no") < end, F.regexp_replace(closed, "<!--.*$", "")).otherwise(closed)
    joined = within & F.col("inside")  # the line break before this line is part of a comment
    return placed.withColumn("inside", inside).select("path", "line_no", cut.alias("line"), joined.alias("joined"))


def index_entries(lines: DataFrame) -> DataFrame:
    """Distinct root-relative targets of ``](./….md)`` links outside comments, also of links that span lines.

    A link ends at the next closing bracket, so only lines with one decide whether a link is open: what stands behind the last
    one in a line is open or not, and a line without one opens a link or leaves things as they are. That is carried like the state of comments.
    A link that spans lines is put together from its own lines alone, and a closing line is searched behind its end only.
    """
    text = without_comments(lines).withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    line = F.col("line")
    closes, opens = F.contains(line, F.lit(")")), F.contains(line, F.lit("](./"))
    tail_opens = F.contains(F.substring_index(line, ")", -1), F.lit("](./"))
    text = text.withColumn("sets", F.when(closes, tail_opens).when(opens, True)).withColumn("closed_at", F.when(closes, F.col("line_no")))
    before = W.partitionBy("path", "chunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    # one row per chunk
    chunks = text.groupBy("path", "chunk").agg(
        F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("line_no"))).alias("sets"), F.max("closed_at").alias("closed_at"),
        F.min("line_no").alias("low"),
    )
    earlier = W.partitionBy("path").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    enters = chunks.select(
        "path", "chunk", F.last("sets", ignorenulls=True).over(earlier).alias("enters_open"), F.coalesce(F.max("closed_at").over(earlier), F.min("low").over(W.partitionBy("path"))).alias("entered_at"),
    )
    open_ = F.coalesce(F.last("sets", ignorenulls=True).over(before), "enters_open", F.lit(False))
    start = F.coalesce(F.max("closed_at").over(before), "entered_at")
    state = text.join(enters, ["path", "chunk"]).withColumns({"open": open_, "start": start})

    own = F.when(~F.col("open"), line).when(closes, F.substring(line, F.locate(")", line) + 1, F.length(line)))
    within = once(state.where(opens & own.isNotNull()), found=F.regexp_extract_all(own, F.lit(INDEX_LINK), F.lit(1)))
    within = within.select(F.explode("found").alias("entry"))

    ends = state.where(F.col("open") & closes & F.endswith(F.substring_index(line, ")", 1), F.lit(".md")))
    spans = ends.select("path", F.col("start").alias("first"), F.col("line_no").alias("last"))
    pieces = text.select("path", "line_no", "line", "joined").join(spans.select("path", "first", "last", F.explode(F.sequence("first", "last")).alias("line_no")), ["path", "line_no"])
    part = (
        F.when(F.col("line_no") == F.col("last"), F.concat(F.substring_index(line, ")", 1), F.lit(")")))
        .when((F.col("line_no") == F.col("first")) & closes, F.substring_index(line, ")", -1)).otherwise(line)
    )
    piece = F.concat(F.when(F.col("joined"), "").otherwise("\n"), part)
    whole = pieces.groupBy("path", "last").agg(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("pieces"))
    across = F.regexp_extract_all(F.array_join(F.col("pieces.piece"), ""), F.lit(INDEX_LINK), F.lit(1))
    return within.union(once(whole, found=across).select(F.explode("found").alias("entry"))).distinct()


def log_fields(lines: DataFrame) -> DataFrame:
    """Every line of a log with the fields of an entry, NULL where it is none."""
    one_line = lines.select("line_no", F.posexplode(F.split("line", f"[{BREAK}]", -1)).alias("part", "line"))
    # one match per line: its groups come out as three lines
    groups = F.split(F.regexp_replace("line", LOG_ENTRY, "$1\n$2\n$3"), "\n", -1)
    fields = once(one_line, entry=F.when(F.startswith("line", F.lit("##")), groups))
    is_entry = F.size("entry") == 3
    date, action, detail = (F.when(is_entry, F.get("entry", F.lit(i))) for i in (0, 1, 2))
    return fields.select(
        "line_no", "part", "line", date.alias("date"), date.try_cast("date").alias("log_date"),
        action.alias("action"), detail.alias("detail"),
    )


def change_log(lines: DataFrame) -> DataFrame:
    """Log entries; see :func:`recent_changes` for their order."""
    return log_fields(lines).where("date IS NOT NULL").select(
        "line_no", "part", "date", "log_date", "action", "detail"
    )


def recent_changes(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest day first, entries of one day in file order."""
    ordered = log.orderBy(F.desc("date"), "line_no", "part")
    return ordered if limit is None else ordered.limit(limit)


def sources(docs: DataFrame) -> DataFrame:
    """(name, text) of the markdown files directly below ``sources/``."""
    return docs.where(_in_sources()).select(basename(F.col("path")).alias("name"), "text")


def _header_and_body(text: Column) -> Column:
    """A text cut where its leading quote block ends, however long that is."""
    return F.when(F.startswith(text, F.lit(">")), F.split(text, _FIRST_PLAIN_LINE, 2)).otherwise(F.array(F.lit(""), text))


def header_field(text: Column, name: str) -> Column:
    """A field of the quote block at the top of a source, NULL if it is not given."""
    top = F.get(_header_and_body(text), F.lit(0))
    return F.nullif(F.trim(F.regexp_extract(top, SOURCE_HEADER[name], 1)), F.lit(""))


def source_headers(source_docs: DataFrame) -> DataFrame:
    """Source type, URL and fetch date of every source."""
    text = F.col("text")
    return source_docs.select(
        "name",
        header_field(text, "source_type").alias("source_type"),
        header_field(text, "url").alias("url"),
        day(header_field(text, "fetched")).alias("fetched"),
    )


def source_body(text: Column) -> Column:
    """A source's text behind its header block."""
    return F.regexp_replace(F.coalesce(F.get(_header_and_body(text), F.lit(1)), F.lit("")), r"\A\n+", "")
