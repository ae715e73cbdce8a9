"""The page table: documents with readable frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.conventions import ENTITY_TYPES, LINK
from mdlake.functions import frontmatter as fm
from mdlake.functions import nested
from mdlake.functions.columns import once
from mdlake.functions.dates import day
from mdlake.functions.text import basename, or_empty, title_from_path
from mdlake.sources.documents import drop_excluded

_PARSED = "reason string, fm map<string,string>, title string, tags array<string>, mentioned_in array<string>"


def _yaml_reader():
    """Arrow-batched reader for blocks outside the built-in subset."""

    @F.pandas_udf(_PARSED)
    def read_yaml(blocks):
        import pandas as pd
        import yaml

        def dateless(base):
            # dates stay text, so that an impossible one does not abort the job
            resolvers = {
                first: [(tag, rx) for tag, rx in found if not tag.endswith(":timestamp")]
                for first, found in base.yaml_implicit_resolvers.items()
            }
            return type("Loader", (base,), {"yaml_implicit_resolvers": resolvers})

        plain = dateless(yaml.SafeLoader)
        fast = dateless(getattr(yaml, "CSafeLoader", yaml.SafeLoader))

        def names(value):
            if value is None or value is False or value == "":
                return []
            return [str(v) for v in value] if isinstance(value, list) else [str(value)]

        def shown(value):
            if value is None:
                return None
            if isinstance(value, (list, dict)):
                return yaml.safe_dump(value, default_flow_style=True, allow_unicode=True, width=10**9).strip()
            return str(value)

        def read(block):
            if block is None:
                return None, None, None, None, None
            try:
                # the C parser takes tabs inside plain scalars, the other one does not
                data = yaml.load(block, plain if "\t" in block else fast)
            except (yaml.YAMLError, ValueError):
                return "invalid_yaml", None, None, None, None
            if not data:
                return "empty", None, None, None, None
            if not isinstance(data, dict):
                return "not_mapping", None, None, None, None
            title = data.get("title")
            return (
                None,
                {str(k): shown(v) for k, v in data.items()},
                str(title) if title else None,
                names(data.get("tags")),
                names(data.get("mentioned_in")),
            )

        return pd.DataFrame(
            [read(b) for b in blocks], columns=["reason", "fm", "title", "tags", "mentioned_in"], dtype=object
        )

    return read_yaml


def judge(docs: DataFrame) -> DataFrame:
    """(path, text, block, lean, reason): the frontmatter block and why it is not readable here.

    The block is named with ``once``: it is referred to a dozen times.
    """
    block = fm.block(F.col("text"))
    cut = once(docs.select("path", "text"), block=block, lean=fm.significant(block))
    return cut.withColumn("reason", fm.status(F.col("text"), F.col("block"), F.col("lean")))


def _lists(fields: Column) -> list[Column]:
    return [fm.text_list(fields.getItem(name)).alias(name) for name in ("tags", "mentioned_in")]


def _title(fields: Column) -> Column:
    return F.nullif(fields.getItem("title"), F.lit("")).alias("title")


def _parsed(judged: DataFrame, yaml: str) -> DataFrame:
    """Add fm, title, tags and mentioned_in to judged documents."""
    own, here = F.col("fm"), F.col("reason").isNull()
    native = judged.withColumn("fm", F.when(here, fm.mapping(F.col("lean"))))
    if yaml == "native":
        return native.select("path", "text", "reason", "fm", _title(own), *_lists(own))
    fenced = here | ~F.col("reason").isin("no_frontmatter", "unterminated")
    wanted = fenced if yaml == "strict" else F.coalesce(F.col("reason") == "unsupported_yaml", F.lit(False))
    read = native.withColumn("by_yaml", wanted).withColumn("y", _yaml_reader()(F.when(F.col("by_yaml"), F.col("block"))))

    def pick(name: str, native_value: Column) -> Column:
        return F.when(F.col("by_yaml"), F.col(f"y.{name}")).otherwise(native_value).alias(name)

    tags, mentioned_in = _lists(own)
    return read.select(
        "path", "text", pick("reason", F.col("reason")), pick("fm", own), pick("title", _title(own)),
        pick("tags", tags), pick("mentioned_in", mentioned_in),
    )


def read_frontmatter(docs: DataFrame, yaml: str = "auto") -> DataFrame:
    """(path, text, reason, fm, title, tags, mentioned_in); ``reason`` is NULL for pages.

    ``yaml`` picks the reader: ``native`` uses built-in expressions only and reports
    other blocks as ``unsupported_yaml``; ``auto`` hands just those blocks to PyYAML;
    ``strict`` hands it all blocks.
    """
    if yaml not in ("native", "auto", "strict"):
        raise ValueError(f"yaml must be native, auto or strict, not {yaml!r}")
    return _parsed(judge(docs), yaml)


def frontmatter(docs: DataFrame, yaml: str = "auto") -> DataFrame:
    """Readable documents only, as :func:`read_frontmatter` without ``reason``."""
    if yaml == "native":
        own = F.col("fm")
        kept = judge(docs).where("reason IS NULL").withColumn("fm", fm.mapping(F.col("lean")))
        return kept.select("path", "text", "fm", _title(own), *_lists(own))
    return read_frontmatter(docs, yaml).where("reason IS NULL").drop("reason")


def _json_reader():
    """Arrow-batched reader of blocks that the fold leaves; dates stay text, what is no mapping is NULL."""

    @F.pandas_udf("string")
    def read_json(blocks):
        import json

        import pandas as pd
        import yaml

        plain = type("Loader", (yaml.SafeLoader,), {
            "yaml_implicit_resolvers": {
                first: [(tag, rx) for tag, rx in found if not tag.endswith(":timestamp")] for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
            }
        })

        def read(block):
            try:
                data = yaml.load(block, plain) if block is not None else None
                return json.dumps(data, ensure_ascii=False, default=str, allow_nan=False) if isinstance(data, dict) else None
            except (yaml.YAMLError, ValueError, TypeError, RecursionError):
                return None

        return pd.Series([read(b) for b in blocks], dtype=object)

    return read_json


def frontmatter_values(docs: DataFrame) -> DataFrame:
    """(path, value, by_yaml): the whole frontmatter as a VARIANT, with nested maps and lists, for documents with a mapping.

    The fold of :mod:`mdlake.functions.nested` reads blocks in the JVM; only what it leaves goes to PyYAML, and ``by_yaml`` marks it.
    """
    fenced = docs.where(F.startswith("text", F.lit("---")) & (fm.fence_end(F.col("text")) > 0))
    folded = once(once(fenced.select("path", fm.block(F.col("text")).alias("block")), value=nested.value(F.col("block"))), by_yaml=F.col("value").isNull())
    read = folded.withColumn("json", _json_reader()(F.when(F.col("by_yaml"), F.col("block"))))
    whole = read.select("path", F.coalesce("value", F.try_parse_json("json")).alias("value"), "by_yaml")
    return whole.where("value IS NOT NULL")


def yaml_share(values: DataFrame) -> DataFrame:
    """(n_blocks, n_by_yaml) of :func:`frontmatter_values`: how many blocks were left to PyYAML."""
    return values.agg(F.count("*").alias("n_blocks"), F.count_if("by_yaml").alias("n_by_yaml"))


def link_targets(body: Column) -> Column:
    """Targets of all links to markdown files, relative to the root."""
    found = F.regexp_extract_all(body, F.lit(LINK), F.lit(1))
    return F.transform(found, lambda raw: F.translate(F.regexp_replace(raw, r"^\./", ""), "\\", "/"))


def page_type(type_col: Column, category: Column) -> Column:
    """entity, concept, meta (by category) or use-case."""
    return (
        F.when(type_col.isin(*ENTITY_TYPES), type_col)
        .when(F.contains(F.lower(or_empty(category)), F.lit("meta")), "meta")
        .otherwise("use-case")
    )


def page_table(docs: DataFrame, profile: str = "reader", yaml: str = "auto") -> DataFrame:
    """Typed pages of a corpus, one row per document with frontmatter.

    Link targets are collected in the same pass, so the graph is built later
    from slim columns and never reads a text again.
    """
    read = once(frontmatter(drop_excluded(docs, profile), yaml), body=fm.body(F.col("text")))
    field = F.col("fm").getItem
    return read.select(
        "path",
        F.coalesce("title", title_from_path(F.col("path"))).alias("title"),
        page_type(field("type"), field("category")).alias("page_type"),
        field("type").alias("type"),
        field("category").alias("category"),
        field("status").alias("status"),
        field("owner").alias("owner"),
        field("source").alias("source"),
        basename(F.nullif(field("source"), F.lit(""))).alias("source_name"),
        "tags",
        "mentioned_in",
        day(field("created")).alias("created"),
        day(field("last_reviewed")).alias("last_reviewed"),
        field("created").alias("created_raw"),
        field("last_reviewed").alias("last_reviewed_raw"),
        "fm",
        "text",
        link_targets(F.col("body")).alias("links"),
        "body",
    )


def rejected_pages(docs: DataFrame, profile: str = "reader", yaml: str = "auto") -> DataFrame:
    """Documents that are no pages, with the reason."""
    read = read_frontmatter(drop_excluded(docs, profile), yaml)
    return read.where("reason IS NOT NULL").select("path", "reason")


def body_split(docs: DataFrame) -> DataFrame:
    """(path, body): the document without its frontmatter."""
    return docs.select("path", fm.body(F.col("text")).alias("body"))

