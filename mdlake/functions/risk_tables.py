"""Risk-register rows of one document as an array expression.

A table lives inside one document, so nothing here needs an exchange: the text is
cut at the lines that open a table and only these pieces are split into rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdlake.conventions import BLANK, BREAK
from mdlake.functions.text import one_break, strip

# From the first register on; only what follows is split. The multi-line anchor
# knows the common line ends, the second branch the rare ones.
_REGISTER_LINE = rf"[{BLANK}]*##[^{BREAK}]*risk register(?s:.*)"
_FIRST_REGISTER = rf"(?im)^{_REGISTER_LINE}|[\x0b\x0c\x1c-\x1e]{_REGISTER_LINE}"

_SECTION = rf"\n(?=[{BLANK}]*##)"
_REGISTER = r"(?i)^[^\n]*risk register"
_AFTER_DASHES = rf"\n[{BLANK}]*\|[^\n]*---[^\n]*\n((?s:.*))"
_TABLE = r"\n(?=[^\n]*Risk)(?=[^\n]*Likelihood)(?=[^\n]*\|)"
_BEHIND_TABLE = rf"(?s)\n(?![{BLANK}]*\|).*"
_AFTER_SEPARATOR = rf"\n[{BLANK}]*+\|[|\-{BLANK}]*+\n((?s:.*))"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|", -1), strip)


def cell(cells: Column, i: int) -> Column:
    return F.coalesce(F.get(cells, F.lit(i)), F.lit(""))


def _rows(table_text: Column) -> Column:
    rows = F.transform(
        F.filter(F.split(table_text, "\n", -1), lambda s: F.startswith(strip(s), F.lit("|"))),
        _cells,
    )
    return F.filter(rows, lambda c: F.size(c) >= 5)


def _pieces(tail: Column, opening: str) -> Column:
    """A text that starts with an opening line, cut before each opening line."""
    return F.filter(F.split(F.concat(F.lit("\n"), one_break(tail)), opening, -1), lambda s: s != "")


def _from_line_of(text: Column, word: str) -> Column:
    """The text from the line that first holds ``word`` on, found without a pattern."""
    at = F.locate(word, text)
    line_head = F.substring_index(F.substring(text, F.lit(1), at - 1), "\n", -1)
    return F.concat(line_head, F.substring(text, at, F.length(text)))


def register_rows(body: Column) -> Column:
    """All rows of sections headed 'Risk Register', open or not."""
    tail = F.regexp_extract(body, _FIRST_REGISTER, 0)
    registers = F.filter(_pieces(tail, _SECTION), lambda s: s.rlike(_REGISTER))

    def rows_of(section: Column) -> Column:
        found = _rows(F.regexp_extract(section, _AFTER_DASHES, 1))
        # a line with three dashes counts as a separator wherever it stands
        return F.filter(
            found,
            lambda c: ~F.contains(F.array_join(c, "|"), F.lit("---")) & (F.lower(cell(c, 0)) != "risk"),
        )

    return F.flatten(F.transform(registers, rows_of))


def open_table_rows(text: Column, *markers: str) -> Column:
    """Rows of any table headed by 'Risk' and 'Likelihood' whose status holds a marker."""

    def rows_of(piece: Column) -> Column:
        table = F.regexp_replace(piece, _BEHIND_TABLE, "")
        return _rows(F.regexp_extract(table, _AFTER_SEPARATOR, 1))

    def is_open(c: Column) -> Column:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(cell(c, 4), F.lit(marker))
        return hit

    def is_header(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)  # the first piece opens with any line that holds Likelihood
        return F.contains(line, F.lit("Risk")) & F.contains(line, F.lit("Likelihood")) & F.contains(line, F.lit("|"))

    tables = F.filter(_pieces(_from_line_of(text, "Likelihood"), _TABLE), is_header)
    rows = F.flatten(F.transform(tables, rows_of))
    return F.when(F.contains(text, F.lit("Likelihood")), F.filter(rows, is_open))
