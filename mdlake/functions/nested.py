"""Nested frontmatter as a value: a fold over the lines' indentation writes JSON, which becomes a VARIANT.

Read are maps and lists of any depth, lists of maps, literal and folded block scalars, inline lists of plain words, plain and
simply quoted scalars, whole and decimal numbers, truth values, nulls and comments. For anything else the result is NULL, and
the block is left to a YAML library. Dates stay text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdlake.functions import frontmatter as fm

_TRUE, _FALSE = r"(?:yes|Yes|YES|true|True|TRUE|on|On|ON)", r"(?:no|No|NO|false|False|FALSE|off|Off|OFF)"
_INTEGER, _DECIMAL = r"(?:0|-?[1-9][0-9]{0,17})", r"-?(?:0|[1-9][0-9]{0,8})\.[0-9]{1,6}"
_ENTRY = rf"^({fm.KEY}):(?: +(.*))?$"
_BLOCK = r"[|>]"
_ODD = r"[\t\x00-\x08\x0b-\x1f\x7f-\x9f\u2028\u2029\ufeff]"

# A token of a line: an item's dash, a key with or without a value, or an item's value.
_STATE = "struct<ok:boolean,out:string,wants:boolean,stack:array<struct<at:int,kind:string>>,style:string,key_at:int,held:array<string>>"


def _json(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _plain(value: Column) -> Column:
    """A scalar as JSON; NULL if it is none of those that are read."""
    quoted = value.rlike(rf"^(?:\"[^\"\\]*\"|'[^']*')$")
    return (
        F.when(quoted, _json(F.substring(value, F.lit(2), F.length(value) - 2)))
        .when(value.rlike(r"^(?:~|null|Null|NULL)$"), "null")
        .when(value.rlike(f"^{_TRUE}$"), "true")
        .when(value.rlike(f"^{_FALSE}$"), "false")
        .when(value.rlike(f"^(?:{_INTEGER}|{_DECIMAL})$"), value)
        .when(value.rlike(rf"^{fm._PLAIN}$") & ~value.rlike("^-?[0-9]+$"), _json(value))  # no longer number
    )


def _value(text: Column) -> Column:
    """A scalar or an inline list of plain words as JSON."""
    inside = F.substring(text, F.lit(2), F.length(text) - 2)
    items = F.transform(F.split(inside, ",", -1), lambda x: _plain(F.trim(x)))
    flow = F.when(F.trim(inside) == "", "[]").when(F.exists(items, lambda x: x.isNull()), None).otherwise(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    return F.when(text.rlike(rf"^{fm._FLOW}$"), flow).when(~text.rlike(r"^[\[{]"), _plain(text))


def _state(s: Column, **changes: Column) -> Column:
    names = ("ok", "out", "wants", "stack", "style", "key_at", "held")
    return F.struct(*(changes.get(n, s[n]).alias(n) for n in names)).cast(_STATE)


def _closers(frames: Column) -> Column:
    return F.array_join(F.transform(F.reverse(frames), lambda f: F.when(f["kind"] == "m", "}").otherwise("]")), "")


def _separated(out: Column) -> Column:
    return F.when(F.right(out, F.lit(1)).isin("{", "["), out).otherwise(F.concat(out, F.lit(",")))


def _token(s: Column, at: Column, kind: Column, key: Column, value: Column) -> Column:
    """The state behind a token: ``kind`` is m for a key and l for a dash."""
    kept = F.filter(s["stack"], lambda f: (f["at"] < at) | ((f["at"] == at) & ((f["kind"] == kind) | (f["kind"] == "m"))))
    top = F.get(F.reverse(kept), F.lit(0))
    goes_on = F.coalesce((top["at"] == at) & (top["kind"] == kind), F.lit(False))
    gone = F.slice(s["stack"], F.size(kept) + 1, F.size(s["stack"]) - F.size(kept))
    closed = F.concat(s["out"], F.when(s["wants"], "null").otherwise(""), _closers(gone))
    opened = F.concat(s["out"], F.when(kind == "m", "{").otherwise("["))
    fits = goes_on | (s["wants"] & (F.size(gone) == 0))
    out = _separated(F.when(goes_on, closed).otherwise(opened))
    frame = F.struct(at.cast("int").alias("at"), kind.alias("kind"))
    return _state(
        s, ok=s["ok"] & fits,
        out=F.when(kind == "m", F.concat(out, _json(key), F.lit(":"), F.coalesce(value, F.lit("")))).otherwise(out),
        wants=value.isNull(), stack=F.when(goes_on, kept).otherwise(F.concat(kept, F.array(frame))),
    )


def _held_text(style: Column, held: Column, newline: Column) -> Column:
    """A block scalar's text; NULL where its layout is not one of those that are read."""
    full = F.filter(held, lambda x: F.trim(x) != "")
    first = F.get(full, F.lit(0))
    depth = F.length(first) - F.length(F.ltrim(first))
    bare = F.transform(held, lambda x: F.substring(x, depth + 1, F.length(x)))
    shallow = F.exists(full, lambda x: F.length(x) - F.length(F.ltrim(x)) < depth)
    text = F.rtrim(F.array_join(bare, "\n"), F.lit("\n"))
    deep = F.exists(bare, lambda x: F.startswith(x, F.lit(" ")))
    blank = F.exists(held, lambda x: F.trim(x) == "")
    folded = F.when(~deep & ~blank, F.array_join(bare, " "))
    trailing = F.exists(held, lambda x: (F.trim(x) == "") & (F.length(x) > 0))  # blanks on an empty line count in some places
    return F.when((F.size(full) > 0) & ~shallow & ~trailing, F.concat(F.when(style == "|", text).otherwise(folded), newline))


def _end_block(s: Column, newline: Column) -> Column:
    """The state behind a block scalar, if there is one; its last line break is ``newline``."""
    text = _held_text(s["style"], s["held"], newline)
    ended = _state(
        s, ok=s["ok"] & text.isNotNull(), out=F.concat(s["out"], F.coalesce(_json(text), F.lit(""))), wants=F.lit(False),
        style=F.lit(None).cast("string"), held=F.array().cast("array<string>"),
    )
    return F.when(s["style"].isNotNull(), ended).otherwise(s)


def _named(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _line(s: Column, line: Column) -> Column:
    at = F.length(line) - F.length(F.ltrim(line))
    inside = s["style"].isNotNull() & ((F.trim(line) == "") | (at > s["key_at"]))
    held = _state(s, held=F.concat(s["held"], F.array(line)))
    closed = line.rlike(r"^[^\"'#]*(?:\"[^\"\\]*\"|'[^']*') *$")  # ends with a quoted scalar, so there is no comment
    bare = F.when(closed, F.rtrim(line)).otherwise(F.rtrim(F.regexp_replace(line, r"(?:^| )#.*$", "")))
    unsure = ~closed & line.rlike(r"[\"'].* #| #.*[\"']")  # a hash that may be quoted
    return F.when(inside, held).otherwise(_named(_end_block(s, F.lit("\n")), lambda e: F.when(F.trim(bare) == "", e).otherwise(_tokens(_state(e, ok=e["ok"] & ~unsure), at, F.trim(bare)))))


def _tokens(s: Column, at: Column, text: Column) -> Column:
    """The state behind a line without its indentation."""
    dash = text.rlike("^-(?: |$)")
    rest = F.when(dash, F.ltrim(F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    inner = at + F.length(text) - F.length(rest)  # where the content of an item starts
    entry = rest.rlike(_ENTRY) & ~rest.rlike("^[\"']")
    key, raw = F.regexp_extract(rest, _ENTRY, 1), F.nullif(F.trim(F.regexp_extract(rest, _ENTRY, 2)), F.lit(""))
    none = F.lit(None).cast("string")
    is_block = F.coalesce(raw.rlike(f"^{_BLOCK}$"), F.lit(False))

    def entry_of(e: Column) -> Column:
        value = F.when(is_block, "").otherwise(_value(raw))
        after = _token(e, inner, F.lit("m"), key, value)
        ok = after["ok"] & (raw.isNull() | value.isNotNull())
        return _named(after, lambda a: _state(a, ok=a["ok"] & ok, style=F.when(is_block, raw), key_at=inner.cast("int")))

    def scalar_of(e: Column) -> Column:
        value = _value(rest)
        return _state(e, ok=e["ok"] & value.isNotNull() & dash, out=F.concat(e["out"], F.coalesce(value, F.lit(""))), wants=F.lit(False))

    item = F.when(dash, _token(s, at, F.lit("l"), none, none)).otherwise(s)
    return _named(item, lambda e: F.when(entry, entry_of(e)).when(dash & (rest == ""), e).otherwise(scalar_of(e)))


def value(block: Column) -> Column:
    """The block as a VARIANT; NULL if it is no mapping or beyond what is read here."""
    start = F.struct(
        F.lit(True).alias("ok"), F.lit("").alias("out"), F.lit(True).alias("wants"), F.array().cast("array<struct<at:int,kind:string>>").alias("stack"),
        F.lit(None).cast("string").alias("style"), F.lit(0).alias("key_at"), F.array().cast("array<string>").alias("held"),
    ).cast(_STATE)
    lines = F.split(F.rtrim(F.ltrim(block, F.lit("\n")), F.lit("\n")), "\n", -1)
    last = F.when(F.endswith(block, F.lit("\n")), "\n").otherwise("")
    end = _named(F.aggregate(lines, start, _line), lambda s: _end_block(s, last))
    text = _named(end, lambda e: F.when(e["ok"], F.concat(e["out"], F.when(e["wants"], "null").otherwise(""), _closers(e["stack"]))))
    mapping = _named(text, lambda t: F.when(F.startswith(t, F.lit("{")), F.try_parse_json(t)))
    return F.when(~block.rlike(_ODD), mapping)
