"""Frontmatter as built-in expressions.

The common subset of YAML (plain and quoted scalars, inline and block lists of
plain items, nulls, comments) is read inside the JVM. A block that uses anything
else, or a scalar YAML 1.1 would turn into another text (``yes``, ``012``,
``1:30``), is marked as outside the subset instead of being read differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"[A-Za-z_][A-Za-z0-9_\-]*"
NULLS = ("", "~", "null", "Null", "NULL")

# Scalars whose YAML 1.1 value prints differently from their source text.
_BOOL = r"(?:yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF)"
_CANONICAL = r"(?:-?[1-9][0-9]*|\d{4}-\d\d-\d\d)"
_NUMBER = r"[-+]?(?:[0-9.][0-9_.:eExXoOa-fA-F+\-]*|\.(?:inf|Inf|INF|nan|NaN|NAN))"
_STAMP = r"\d{4}-\d\d?-\d\d?[Tt ].*"
_OTHER = rf"(?:{_BOOL}|(?!{_CANONICAL} *(?:$|[,\]])){_NUMBER}|{_STAMP}|=|<<)"

_NULL = r"(?:~|null|Null|NULL)"

_FIRST = r"(?:[^ \t\n\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^ \n]))"
_PLAIN = rf"(?!{_OTHER} *$)(?!.*:(?: |$)){_FIRST}.*"
_SCALAR = rf"(?:\"[^\"\\]*\"|'[^']*'|{_PLAIN})"
_FLOW = r"\[[^\[\]{}\"'#&*!|>%@`\\:?]*\]"

_LINE_OUTSIDE = rf"(?md)^(?!(?: *|{KEY}:(?: +(?:{_SCALAR}|{_FLOW}))? *| *- +(?!{_NULL} *$){_SCALAR} *)$).+$"
_FLOW_OUTSIDE = rf"(?md)^{KEY}: +(?=\[).*(?:[\[,] *(?:(?:{_OTHER}|{_NULL}) *[,\]]|[^\p{{L}}\p{{N}}_./ \]])|, *\])"
_ITEM_AFTER_SCALAR = rf"(?md)^{KEY}: +[^ \n].*\n *- "
_ITEM_INDENT = r"(?md)^( *)- .*\n(?!\1- )(?= *- )"
_REPEATED_KEY = rf"(?mds)^({KEY}):(?=.*^\1:)"
_QUOTE_AND_HASH = r"(?md)^.*[\"'].* #|^.* #.*[\"']"
_ODD_CHARACTER = r"[\t\x00-\x08\x0b-\x1f\x7f-\x9f\u2028\u2029\ufeff]"
_NOT_AN_ITEM = r"(?md)^(?! *- +[^ ]).+$"


def fence_end(text: Column) -> Column:
    """1-based position of the line break before the closing fence; 0 if there is none."""
    return F.locate("\n---", text, 4)


def block(text: Column) -> Column:
    """What stands between the fences."""
    return F.substring(text, F.lit(4), fence_end(text) - 4)


def body(text: Column) -> Column:
    """The text behind the closing fence; the whole text where there is no block."""
    fenced = F.startswith(text, F.lit("---")) & (fence_end(text) > 0)
    rest = F.substring(text, fence_end(text) + 4, F.length(text))
    return F.when(fenced, F.ltrim(rest, F.lit("\n"))).otherwise(text)


def significant(block_col: Column) -> Column:
    """The block without comments and blank lines."""
    bare = F.regexp_replace(block_col, r"(?md)(?:^|(?<= ))#.*$", "")
    return F.ltrim(F.regexp_replace(bare, r"\n *(?=\n|\z)", ""), F.lit("\n"))


def status(text: Column, block_col: Column, lean: Column) -> Column:
    """Why a document is no page; NULL if its block can be read here."""
    outside = (
        lean.rlike(_LINE_OUTSIDE)
        | lean.rlike(_FLOW_OUTSIDE)
        | lean.rlike(_ITEM_AFTER_SCALAR)
        | lean.rlike(_ITEM_INDENT)
        | lean.rlike(_REPEATED_KEY)
        | lean.rlike(r"^ *- ")
        | block_col.rlike(_QUOTE_AND_HASH)
        | block_col.rlike(_ODD_CHARACTER)
    )
    return (
        F.when(~F.startswith(text, F.lit("---")), "no_frontmatter")
        .when(fence_end(text) == 0, "unterminated")
        .when(F.trim(lean) == "", "empty")
        .when(~lean.rlike(_NOT_AN_ITEM), "not_mapping")
        .when(outside, "unsupported_yaml")
    )


def _unquote(col: Column) -> Column:
    bare = F.rtrim(col)
    quoted = F.startswith(bare, F.lit('"')) | F.startswith(bare, F.lit("'"))
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def mapping(lean: Column) -> Column:
    """MAP of field to text. Lists keep their source text, nulls are NULL."""
    pairs = F.str_to_map(lean, F.lit(rf"\n(?={KEY}:)"), F.lit(r":[ \n]*"))
    return F.transform_values(
        pairs, lambda _, v: F.when(~F.rtrim(v).isin(*NULLS), _unquote(v))
    )


def text_list(raw: Column) -> Column:
    """An inline or block list as an array; a scalar becomes a list of one."""
    inline = F.filter(F.split(F.btrim(raw, F.lit("[] ")), r" *, *", -1), lambda x: x != "")
    items = F.transform(F.split(F.regexp_replace(raw, r"^- +", ""), r"\n *- +", -1), _unquote)
    return (
        F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>"))
        .when(F.startswith(raw, F.lit("[")), inline)
        .when(F.startswith(raw, F.lit("- ")), items)
        .otherwise(F.array(raw))
    )
