"""String expressions with the corpus' text semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdlake.conventions import BREAK, BLANK, SPACE

# The members of SPACE one by one, for the trim functions.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Remove Unicode white space on both sides (Spark's trim knows only U+0020)."""
    return F.btrim(col, F.lit(SPACES))


def lf(col: Column) -> Column:
    """CRLF and CR to LF; documents without a carriage return are not rewritten."""
    return F.when(F.contains(col, F.lit("\r")), F.regexp_replace(col, r"\r\n?", "\n")).otherwise(col)


def one_break(col: Column) -> Column:
    """Every line separator to LF; texts that know only LF are not rewritten."""
    rare = BREAK.removeprefix(r"\n")
    return F.when(col.rlike(f"[{rare}]"), F.regexp_replace(col, rf"\r\n|[{rare}]", "\n")).otherwise(col)


def lines(col: Column) -> Column:
    """Lines of a text; a final line end does not start another line."""
    text = one_break(col)
    closed = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(closed, "\n", -1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def title_from_path(path: Column) -> Column:
    """``a/some-page.md`` to ``Some Page``; every run of letters gets a capital."""
    stem = F.replace(F.regexp_replace(basename(path), r"\.md$", ""), F.lit("-"), F.lit(" "))
    runs = F.regexp_extract_all(stem, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def path_order(path: Column) -> Column:
    """Sort key that compares paths component by component."""
    return F.split(path, "/", -1)


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def contains_ci(col: Column, needle: str) -> Column:
    return F.contains(F.lower(col), F.lit(needle.lower()))


def cut(col: Column, limit: int, keep: int) -> Column:
    """Texts over ``limit`` characters become their first ``keep`` and an ellipsis."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, keep), F.lit("…"))).otherwise(col)


__all__ = ["BLANK", "SPACE", "SPACES", "basename", "contains_ci", "cut", "lf", "lines", "one_break", "or_empty", "path_order", "strip", "title_from_path"]
