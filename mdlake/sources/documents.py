"""Where documents come from: a folder of markdown files or a (path, text) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdlake.conventions import EXCLUDED_DIRS, EXCLUDED_FILES
from mdlake.functions.columns import once
from mdlake.functions.text import basename, lf, lines
from mdlake.sources.folder import is_known, read_folder


def _relative(file_path: Column, root: str) -> Column:
    """File URI to the path below ``root``."""
    bare = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    prefix = bare.rstrip("/") + "/"
    decoded = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.substring(decoded, F.locate(prefix, decoded) + len(prefix), F.length(decoded))


def scan_documents(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """Every markdown file below ``root`` as (path, text), one row per file, also those whose name starts with '_' or '.'.

    Where ``root`` is in a store that only Spark can open, its reader is used, which leaves such names out. Corpora of many small
    files should be compacted once with :func:`compact`.
    """
    if is_known(root):
        return read_folder(spark, root, glob).select("path", lf(F.col("text")).alias("text"))
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(
        _relative(F.col("_metadata.file_path"), root).alias("path"), lf(F.col("value")).alias("text")
    )


def documents_of(table: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Any table with a path and a text column as documents."""
    return table.select(F.col(path).alias("path"), lf(F.col(text)).alias("text"))


def compact(docs: DataFrame, out: str) -> None:
    """Write documents as Parquet so that later runs do not open one file per page."""
    docs.write.mode("overwrite").parquet(out)


def drop_excluded(docs: DataFrame, profile: str = "reader") -> DataFrame:
    """Leave out control files and folders; ``profile`` is query, lint or reader."""
    first = F.substring_index(F.col("path"), "/", 1)
    return docs.where(
        ~first.isin(*EXCLUDED_DIRS[profile]) & ~basename(F.col("path")).isin(*EXCLUDED_FILES)
    )


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of every file below ``root``; contents are not read. Hidden names are as in :func:`scan_documents`."""
    if is_known(root):
        return read_folder(spark, root, content=False).drop("text")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        _relative(F.col("path"), root).alias("path"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
    )


def page_lines(docs: DataFrame) -> DataFrame:
    """One row per line, numbered from 0 within its document."""
    return once(docs, all_lines=lines(F.col("text"))).select("path", F.posexplode("all_lines").alias("pos", "line"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Documents as a line table (path, line_no, line)."""
    return page_lines(docs).select("path", F.col("pos").cast("bigint").alias("line_no"), "line")


def read_root_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Line table of ``root/name``, empty if there is no such file."""
    return read_lines(spark, root, name).where(F.col("path") == name)


def read_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Line table of large, splittable files such as an index or a log.

    The file is read in splits. Lines are numbered per split and shifted by the
    number of lines in the splits before, so no task sees a whole file.
    """
    raw = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=glob).select(
        _relative(F.col("_metadata.file_path"), root).alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    shift = splits.select(
        "path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    # one row per 128 MB split: a petabyte of log is eight million rows
    return raw.join(shift, ["path", "split"]).select(
        "path", (F.col("seq") - F.col("first") + F.col("shift")).alias("line_no"), "line"
    )
