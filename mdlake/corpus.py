"""A markdown corpus derived from the star-schema tables.

Page k comes from part k, its prose from documents; suppliers, nations and
regions give entity and concept pages, events the log. Answers can be computed
from the generating columns alone, which makes them an independent check of
everything that reads the text.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-12-31"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _if(cond: Column, text: Column | str) -> Column:
    return F.when(cond, F.lit(text) if isinstance(text, str) else text).otherwise("")


SLICE = 2048  # part pages that one task writes, on average


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prose"))
    n_docs = documents.agg(F.count("*")).scalar()
    n_suppliers = _table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    k = F.col("k")
    part = _table(spark, sf_dir, "part")
    parts = (
        part
        .select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", "p_size")
        .withColumn("d", F.pmod(k, n_docs))
        .withColumn("s", F.pmod(k, n_suppliers))
        .withColumn("n_docs", n_docs)
    )
    # a document is on many pages: the number of tasks follows the pages, not the bytes that meet
    slices = max(1, ceil(part.count() / SLICE))
    rows = parts.repartition(slices, "d").join(documents.repartition(slices, "doc_id"), F.col("d") == F.col("doc_id"))
    words = F.split("p_name", " ")
    t1, t2, t3 = words[0], words[1], F.lower("p_type")
    title = _s("Part ", k, " ", F.col("p_name"))
    created = F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int"))

    def doc(i: int) -> Column:
        return _s("sources/doc-", F.pmod(k + i, F.col("n_docs")), ".md")

    fields = F.concat(
        _if(k % 3 == 0, "# reviewed by hand\n"),
        _if(k % 11 != 0, F.when(k % 13 == 5, _s('title: "', title, '"\n')).otherwise(_s("title: ", title, "\n"))),
        _if(k % 17 != 0, _s("category: ", _if(k % 97 == 0, "Meta "), F.col("p_brand"), "\n")),
        F.when(k % 19 == 0, 'status: ""\n')
        .when(k % 3 == 0, "status: Draft\n")
        .when(k % 3 == 1, "status: Active\n")
        .otherwise("status: Deprecated\n"),
        _s("owner: team-", k % 10, "  # rota\n"),
        F.when(k % 5 == 0, _s("tags:\n  - ", t1, "\n  - ", t2, "\n  - ", t3, "\n")).otherwise(
            _s("tags: [", t1, ", ", t2, ", ", t3, "]\n")
        ),
        _s("created: ", created, "\n"),
        _if(k % 23 != 0, _s("last_reviewed: ", F.date_add(created, F.col("p_size")), "\n")),
        F.when(k % 44 == 0, _s("source: sources/lost-", k, ".md\n")).when(k % 4 == 0, _s("source: ", doc(0), "\n")).otherwise(""),
    )
    front = (
        F.when(k % 212 == 0, "")
        .when(k % 212 == 53, _s("---\ntitle: Part ", k, "\n"))
        .when(k % 212 == 106, "---\n# nothing yet\n---\n")
        .when(k % 212 == 159, "---\n- a\n- b\n---\n")
        .otherwise(_s("---\n", fields, "---\n"))
    )

    def risk(r: int) -> Column:
        mark = (k + r) % 3
        status = F.when(mark == 0, "⚠️ Action required").when(mark == 1, "✅ Handled").otherwise("🔲 Not yet addressed")
        level = F.when((k + r) % 2 == 0, "High").otherwise("Low")
        return _if(k % 3 + 1 >= r, _s(f"| Risk {r} of part ", k, " | ", level, f" | Medium | Plan {r} | ", status, " |\n"))

    # a table that names a likelihood but no risk, before or behind the register
    hazards = _s("#### Hazards\n\n| Hazard | Likelihood | Impact | Plan | Status |\n| --- | --- | --- | --- | --- |\n| Fire ", k, " | High | High | Plan | 🔲 Open |\n\n")

    body = F.concat(
        _s("\n# Part ", k, "\n\n"),
        _if(k % 47 == 5, "```\ncode text\n```\n\n"),
        _if(k % 47 == 6, "\n".join(f"w{i}" for i in range(40)) + "\n\n"),
        _s("## What This Is\n\nPart ", k, " of ", F.col("p_brand"), "."),
        _if(k % 6 == 1, _s(" See ", doc(0))),
        _if(k % 12 == 7, _s(" and ", doc(1), " and ", doc(2), " and ", doc(3))),
        _if(k % 6 == 1, " for details."),
        _s("\n\n## How It Works\n\n", F.col("prose"), "\n\nLinks: [nation](./entities/nation-", k % 25, ".md), [supplier](./entities/supplier-", F.col("s"), ".md), [next](./parts/part-", k + 1, ".md)"),
        _if(k % 13 == 0, _s(", [self](./parts/part-", k, ".md)")),
        _if((k % 29 == 0) & (k >= 2), _s(", [back](../parts/part-", k - 2, ".md)")),
        _if(k % 31 == 0, ", [region](./entities/region-0.md#x)"),
        F.lit("\n\n"),
        _if(F.col("p_size") % 10 == 0, _s("> **Open question:** Is size ", F.col("p_size"), " right for part ", k, "?  \n\n")),
        _if(k % 43 == 3, hazards),
        F.lit("## Risk Register\n\n| Risk | Likelihood | Impact | Mitigation | Status |\n"),
        F.when(k % 37 == 0, "| :--- | :--- | :--- | :--- | :--- |\n").otherwise("| --- | --- | --- | --- | --- |\n"),
        risk(1), risk(2), risk(3),
        F.lit("\n"),
        _if(k % 41 != 0, "## Prerequisites\n\nNone.\n"),
        _if(k % 8 == 0, "\n## Appendix A\n\nSee above.\n"),
        _if(k % 43 == 4, F.concat(F.lit("\n"), hazards)),
    )
    return rows.select(_s("parts/part-", k, ".md").alias("path"), F.concat(front, body).alias("text"))


def _entity_text(kind: str, title: Column, key: Column, tag: str, mentions: Column, where: Column) -> Column:
    return F.concat(
        _s("---\ntitle: ", title, f"\ntype: {kind}\ncategory: Entities & Concepts\nstatus: Active\nowner: team-", key % 10),
        _s(f"\ntags: [{tag}]\nmentioned_in:", mentions, "\ncreated: 2024-01-01\nlast_reviewed: ", F.date_add(F.lit("2024-06-01").cast("date"), (key % 100).cast("int"))),
        _s("\n---\n\n## What It Is\n\n", title, ".\n\n## How We Use It\n\nDaily.\n"),
        where,
    )


def entity_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pages(name: str, prefix: str, key: str, title: str) -> DataFrame:
        n = F.col(key).cast("bigint")
        mentions = F.concat(
            _s("\n  - parts/part-", n, ".md\n  - ./parts/part-", n + 25, ".md"),
            _if(n % 5 == 0, _s("\n  - parts/ghost-", n, ".md")),
        )
        where = _if(n % 7 != 0, "\n### Where It Appears\n\nIn parts.\n")
        return _table(spark, sf_dir, name).select(
            _s(f"entities/{prefix}-", n, ".md").alias("path"),
            _entity_text("entity", F.col(title), n, prefix, mentions, where).alias("text"),
        )

    r = F.col("r_regionkey").cast("bigint")
    concepts = _table(spark, sf_dir, "region").select(
        _s("entities/region-", r, ".md").alias("path"),
        _entity_text("concept", F.initcap("r_name"), r, "region", F.lit(" []"), F.lit("\n## Where It Appears\n\nNowhere.\n")).alias("text"),
    )
    s = F.col("s_suppkey")
    notes = _table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select(
        _s("notes/Supplier_Note_", s, ".md").alias("path"),
        F.lit("---\ntype: concept\ncategory: Meta notes\nsource:\nstatus: ~\n---\n").alias("text"),
    )
    return _union(
        pages("nation", "nation", "n_nationkey", "n_name"), pages("supplier", "supplier", "s_suppkey", "s_name"), concepts, notes
    )


def source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    header = F.when(d % 9 == 0, "").otherwise(
        F.concat(
            _if(d % 50 == 7, "".join(f"> note {i}\n" for i in range(150))),
            _s("> **Source type:** feed ", F.col("source"), "\n"),
            _if(d % 2 == 0, _s("> **URL:** https://example.org/doc/", d, "\n")),
            _if(d % 10 != 3, _s("> **Fetched:** ", F.date_add(F.lit("2024-01-01").cast("date"), (d % 300).cast("int")), "\n")),
            F.lit("> Kept as it was fetched; changes belong on the page made from it.\n\n"),
        )
    )
    body = F.concat(
        _s("# Document ", d, "\n\n## How It Works\n\n", F.col("text"), "\n\n## Appendix A\n\nLast words.\n"),
        _if(d % 4 == 0, "\n## Glossary\n\nNone.\n"),
    )
    return _table(spark, sf_dir, "documents").select(
        _s("sources/doc-", d, ".md").alias("path"), F.concat(header, body).alias("text")
    )


def excluded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry frontmatter but stand under names that all or some programs leave out."""
    text = _s("---\ntitle: Copy ", F.col("k"), "\n---\nNot a page.\n")
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return _union(
        part.where("k % 50 = 0").select(_s("parts/group-", F.col("k"), "/README.md").alias("path"), text.alias("text")),
        part.where("k % 50 = 1").select(_s("_templates/part-", F.col("k"), ".md").alias("path"), text.alias("text")),
        part.where("k % 50 = 7").select(_s("docs/guide-", F.col("k"), ".md").alias("path"), text.alias("text")),
        part.where("k % 50 = 8").select(_s("tests/case-", F.col("k"), ".md").alias("path"), text.alias("text")),
        part.where("k % 50 = 9").select(_s("evals/run-", F.col("k"), ".md").alias("path"), text.alias("text")),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus as (path, text)."""
    return _union(
        part_docs(spark, sf_dir), entity_docs(spark, sf_dir), source_docs(spark, sf_dir), excluded_docs(spark, sf_dir)
    )


def manifest(spark: SparkSession, sf_dir: str, documents_written: DataFrame) -> DataFrame:
    """(path) of every file, also of those that are no documents."""
    d = F.col("doc_id")
    documents = _table(spark, sf_dir, "documents").select("doc_id")
    others = documents.select(
        F.explode(
            F.filter(
                F.array(
                    F.when(d % 20 == 0, _s("sources/scan-", d, ".pdf")),
                    F.when(d % 25 == 0, _s("sources/img/fig-", d, ".png")),
                    F.when(d % 30 == 0, _s("sources/.draft-", d)),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("path")
    )
    return documents_written.select("path").unionByName(others)


def _line_table(rows: DataFrame, path: str, start: Column, lines: Column) -> DataFrame:
    numbered = rows.select(start.alias("start"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("i", "line"))
    return numbered.select(F.lit(path).alias("path"), (F.col("start") + F.col("i")).alias("line_no"), "line")


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index.md as a line table: live, dead and commented-out entries."""
    k = F.col("k")
    lines = F.array(
        F.when(k % 7 != 0, _s("- [Part ", k, "](./parts/part-", k, ".md) does things")),
        F.when(k % 50 == 0, _s("- [Group](./parts/group-", k, "/README.md)")),
        F.when(k % 100 == 1, _s("- [Gone](./parts/gone-", k, ".md)")),
        F.when(k % 100 == 2, _s("<!-- - [Old](./parts/old-", k, ".md) --> - [Bare](parts/bare.md)")),
        F.when(k % 100 == 3, F.lit("text <!-- parked")),
        F.when(k % 100 == 3, _s("- [Hidden](./parts/hidden-", k, ".md)")),
        F.when(k % 100 == 3, _s("--> - [Shown](./parts/shown-", k, ".md)")),
        F.when(k % 100 == 4, _s("text <!--> - [Veiled](./parts/veiled-", k, ".md)")),
        F.when(k % 100 == 4, _s("- [Masked](./parts/masked-", k, ".md) -->")),
        F.when(k % 100 == 5, _s("- [One](./parts/one-", k, ".md), [Wide](./parts/wide-", k)),
        F.when(k % 100 == 5, F.lit("](./of several lines")),
        F.when(k % 100 == 5, _s("page.md) and [Last](./parts/last-", k, ".md)")),
        F.when(k % 100 == 6, _s("- [Sewn](./parts/sewn-", k, "<!-- noted")),
        F.when(k % 100 == 6, F.lit("here -->.md) ](./no link")),
        F.when(k % 100 == 6, F.lit("at all)")),
    )
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return _line_table(parts, "index.md", k * 8, lines).unionByName(
        _line_table(suppliers, "index.md", -k - 1, F.array(_s("- [S](./entities/supplier-", k, ".md)")))
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log.md as a line table, with malformed lines."""
    e = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    lines = F.array(
        F.when(e == 0, F.lit("## [2023-12-31] init | Created")),
        _s("## [", day, "] ", F.col("event_type"), " | user ", F.col("user_id")),
        F.when(e % 100 == 0, _s("## ", day, " no brackets")),
        F.when(e % 100 == 50, _s("## [2024-13-45] ", F.col("event_type"), " | no such day")),
        F.when(e % 100 == 70, F.lit("a remark")),
    )
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    return _line_table(events, "log.md", e * 5, lines)


def refetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, text): what the addresses of sources would return today."""
    d = F.col("doc_id")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fresh = (
        F.when(d % 8 == 0, F.concat(F.lit("# Moved\n\n"), F.reverse("text")))
        .when(d % 8 == 4, _s("# Document ", d, "\n\n## How It Works\n\n", F.col("text"), "\n\nOne more closing sentence was put here.\n"))
        .otherwise(
            F.concat(
                _s("# Document ", d, "\n\n## How It Works\n\n", F.col("text"), "\n\n## Appendix A\n\nLast words.\n"),
                _if(d % 4 == 0, "\n## Glossary\n\nNone.\n"),
            )
        )
    )
    return documents.where("doc_id % 2 = 0").select(_s("doc-", d, ".md").alias("name"), fresh.alias("text"))
