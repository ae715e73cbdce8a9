"""Tables extracted from texts."""

import random
import re

from conftest import page
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdlake.functions.dates import day
from mdlake.functions.text import strip
from mdlake.operators import extract as X
from mdlake.operators import filters, projections as prj
from mdlake.sources import companions as C
from mdlake.sources import documents

TABLE = "| Risk | Likelihood | Impact | Mitigation | Status |\n| --- | --- | --- | --- | --- |\n"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_open_risks_leave_out_handled_ones(make_pages):
    body = "## Risk Register\n\n" + TABLE + (
        "| Frost | Rare | Burst pipe | Lagging | ⚠️ Order wool |\n| Rust | Sure | Leak | Paint | ✅ Done in May |\n| Mice | Some | Noise | Cat | 🔲 Ask around |\n"
    )
    pages = make_pages({"p.md": page(body, title="P")})
    assert rows(X.open_risks(X.risk_rows(pages)), "risk", "status_symbol", "page_title") == [("Frost", "⚠️", "P"), ("Mice", "🔲", "P")]
    assert rows(X.risk_status_mix(X.risk_rows(pages)), "action_required", "not_addressed", "handled", "other") == [(1, 1, 1, 0)]


def test_the_three_risk_readers_differ(make_pages):
    colon = "| :-- | :-- | :-- | :-- | :--- |\n"
    head = "| Risk | Likelihood | Impact | Mitigation | Status |\n"
    texts = {
        "colon.md": page("## Risk Register\n" + head + colon + "| A | l | i | m | 🔲 |\n"),
        "outside.md": page("## Other\n" + TABLE + "| B | l | i | m | was 🔲 |\n"),
        "nosep.md": page("## Risk Register\n" + head + "| C | l | i | m | 🔲 |\n"),
        "gap.md": page("## The risk register\n" + TABLE + "| D | l | i | m | ⚠️ |\n\n| E | l | i | m | 🔲 |\n# Top\n| F | l | i | m | 🔲 |\n### Next\n| G | l | i | m | 🔲 |\n"),
        "bare.md": page("## Risk Register\n" + TABLE + "| H | l | i | m | ⚠ |\n| I | l | i | m --- x | 🔲 |\n|| J | l | i | m | 🔲 |\n| K \\| k | l | i | m | 🔲 |\n| short | 🔲 |\n"),
    }
    pages = make_pages(texts)
    assert rows(X.open_risks(X.risk_rows(pages)), "path", "risk") == [
        ("bare.md", "J"), ("colon.md", "A"), ("gap.md", "D"), ("gap.md", "E"), ("gap.md", "F"),
    ]
    assert rows(X.open_risks_query(pages), "file", "risk") == [
        ("bare.md", "I"), ("bare.md", "J"), ("gap.md", "D"), ("outside.md", "B"),
    ]
    notes = pages.select("path", F.explode(X.open_risk_notes(F.col("text"))).alias("risk"))
    assert rows(notes, "path", "risk") == [("bare.md", "I"), ("bare.md", "J"), ("outside.md", "B")]


FRAGMENTS = [
    "## Risk Register", "### Other", "# Top", "##risk register x", "  ## Risk register", "", "text", "| a | b | c | d | 🔲 x |",
    "| a | b | c | d | ⚠️ |", " | b | c | d | e | was 🔲 |", "| --- | --- | --- | --- | --- |", "|---|", "| :--- | --- |", "||",
    "| Risk | Likelihood | Impact | Mitigation | Status |", "Risk or Likelihood | x", "| Risk | b | c | d | 🔲 |", "| x | y |",
    "| Hazard | Likelihood | Impact | Plan | Status |", "Likelihood", "|| a | b | c | d | 🔲", "| a - | -- | c | d | 🔲 | f |", " | n | b | c | d | 🔲 |",
]


def by_windows(lines):
    """The row readers once more, as windows over the line table."""
    s = strip(F.col("line"))
    cells = F.transform(F.split(F.btrim(s, F.lit("|")), r"\|", -1), strip)
    up_to = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    piped = F.startswith(s, F.lit("|"))
    dashes = piped & F.contains(s, F.lit("---"))
    heading = F.startswith(s, F.lit("##"))
    register = (
        lines.withColumn("sec", F.count_if(heading).over(up_to))
        .withColumn("in_reg", F.last(F.when(heading, F.contains(F.lower(s), F.lit("risk register"))), True).over(up_to))
        .withColumn("open", F.max(F.when(dashes & ~heading, 1)).over(W.partitionBy("path", "sec").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
        .where(F.col("in_reg") & (F.col("open") == 1) & piped & ~dashes & ~heading).withColumn("c", cells)
        .where((F.size("c") >= 5) & (F.lower(F.get("c", F.lit(0))) != "risk"))
    )
    header = F.contains(s, F.lit("Risk")) & F.contains(s, F.lit("Likelihood")) & F.contains(s, F.lit("|"))
    separator = piped & ~header & (F.regexp_replace(s, r"[|\-\s ]", "") == "")
    group = W.partitionBy("path", "grp").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    tables = (
        lines.withColumn("grp", F.count_if(header | ~piped).over(up_to))
        .withColumn("headed", F.first(header).over(group)).withColumn("sep", F.max(F.when(separator, 1)).over(group))
        .where(F.col("headed") & (F.col("sep") == 1) & piped & ~header & ~separator).withColumn("c", cells).where(F.size("c") >= 5)
    )
    return register, tables


def test_risk_readers_on_random_documents(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 25))) + rng.choice(["", "\n", "\r\n"]) for _ in range(600)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, text string").cache()
    register, tables = by_windows(documents.page_lines(docs))
    key = lambda c: F.concat_ws("¦", *[F.get(c, F.lit(i)) for i in range(5)])
    got = X.risk_rows(docs.select("path", F.lit("t").alias("title"), F.col("text").alias("body")))
    want = sorted((r.path, r.k) for r in register.select("path", key("c").alias("k")).collect())
    assert sorted((r.path, r.k) for r in got.select("path", F.concat_ws("¦", "risk", "likelihood", "impact", "mitigation", "status").alias("k")).collect()) == want
    assert len(want) > 100
    got = X.open_risks_query(docs)
    want = tables.where(filters.has_marker(F.get("c", F.lit(4)), "⚠️", "🔲"))
    assert rows(got, "file", "risk", "status") == sorted((r.path, r.a, r.b) for r in want.select("path", F.get("c", F.lit(0)).alias("a"), F.get("c", F.lit(4)).alias("b")).collect())
    todo = docs.select("path", F.explode(X.open_risk_notes(F.col("text"))).alias("risk"))
    want = tables.where(filters.has_marker(F.get("c", F.lit(4)), "🔲"))
    assert rows(todo, "path", "risk") == sorted((r.path, r.a) for r in want.select("path", F.get("c", F.lit(0)).alias("a")).collect())


def test_long_tables_do_not_overflow(make_pages):
    body = "## Risk Register\n" + TABLE + "| R | l | i | m | 🔲 |\n" * 50_000
    pages = make_pages({"p.md": page(body)})
    assert X.open_risks(X.risk_rows(pages)).count() == X.open_risks_query(pages).count() == 50_000


def test_open_questions(make_pages):
    body = (
        "Words.\n\n> **Open question:** Who holds the spare key?\n\nWords again.\n\n> **Open question:**  How deep is the well?  \n"
        "> **open question:** wrong case\n>**Open question:**\n\nnext line\n"
    )
    found = X.open_questions(make_pages({"p.md": page(body, title="P")}))
    assert rows(found, "seq", "question", "page_title") == [
        (0, "Who holds the spare key?", "P"), (1, "How deep is the well?", "P"), (2, "next line", "P"),
    ]


def test_headings_come_from_the_whole_text(make_pages):
    text = page("# One\n#### Four\n##\nnext\n```\n## In fence\n```\n# One\n#no", title="T").replace("title", "# in front\ntitle")
    found = X.headings(make_pages({"p.md": text}))
    assert rows(found, "pos", "heading") == [(0, "in front"), (1, "One"), (2, "next"), (3, "In fence")]


def test_link_targets(make_pages):
    body = "[a](./b.md) [c](../d.md) [e](/f.md) [g](h.md#x) [i](j.md 'title') [k](http://x/l.md) ![m](n.md) [o](p\\q.md) [](r.md) [s\nt](./././u.md)"
    found = X.raw_links(make_pages({"p.md": page(body)}))
    assert rows(found, "target") == [("./u.md",), ("b.md",), ("d.md",), ("f.md",), ("http://x/l.md",), ("n.md",), ("p/q.md",)]


def test_source_refs(make_pages):
    body = "sources/b.md, xsources/n.md sources/a/ä.pdf. sources/b.md sources/noext sources/c.txt sources/d.md"
    found = X.source_refs(make_pages({"p.md": page(body)}))
    assert rows(found, "n_refs", "preview") == [(4, "sources/a/ä.pdf, sources/b.md, sources/c.txt…")]


def test_lines_like_splitlines(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i\n\n", "x\x1fy"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {}
    for r in documents.page_lines(docs).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.line)
    assert got == {str(i): t.splitlines() for i, t in enumerate(texts) if t.splitlines()}


def test_log(spark, make_docs):
    text = "# Log\n\n## [2025-07-02] open | Ledger begun\n## [2025-07-04] amend | B | more \n##[2025-07-04]  join|A\n## 2025-07-03 no\n## [2026-13-45] x | y\n## [2025-07-03] | z\n"
    lines = documents.numbered_lines(make_docs({"log.md": text}))
    found = [(r.date, r.action, r.detail, r.log_date) for r in C.recent_changes(C.change_log(lines)).collect()]
    assert [f[:3] for f in found] == [
        ("2026-13-45", "x", "y"), ("2025-07-04", "amend", "B | more"), ("2025-07-04", "join", "A"),
        ("2025-07-03", " ", "z"), ("2025-07-02", "open", "Ledger begun"),
    ]
    assert found[0][3] is None


def test_index_comments_across_lines_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 4)
    rng = random.Random(5)
    words = ["[a](./p{}.md)", "<!--", "-->", "<!-->", "<!--->", "text", "[b](p.md)", "<!-- [c](./q{}.md) -->", ""]
    for trial in range(12):
        lines = [" ".join(rng.choice(words).format(rng.randint(0, 99)) for _ in range(rng.randint(0, 4))) for _ in range(60)]
        if trial % 3 == 0:
            lines = [l for l in lines if "-->" not in l] if trial % 2 else lines
        text = re.sub(r"<!--.*?-->", "", "\n".join(lines), flags=re.DOTALL)
        want = set(re.findall(r"\]\(\./([^)]+\.md)\)", text))
        table = spark.createDataFrame([("index.md", i, l) for i, l in enumerate(lines)], "path string, line_no bigint, line string")
        assert {r.entry for r in C.index_entries(table).collect()} == want


def test_index_links_across_lines_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 4)
    rng = random.Random(6)
    words = ["[a](./p{}.md)", "[b](./q{}", "{}.md)", "x)", "](./r", ".md) y", "text", "<!--", "-->", "[c](./s{}.md", "(z)"]
    spanning = 0
    for _ in range(8):
        lines = ["".join(rng.choice(words).format(rng.randint(0, 99)) for _ in range(rng.randint(0, 3))) for _ in range(50)]
        text = re.sub(r"<!--.*?-->", "", "\n".join(lines), flags=re.DOTALL)
        want = set(re.findall(r"\]\(\./([^)]+\.md)\)", text))
        spanning += sum("\n" in w for w in want)
        table = spark.createDataFrame([("index.md", i, l) for i, l in enumerate(lines)], "path string, line_no bigint, line string")
        assert {r.entry for r in C.index_entries(table.repartition(3)).collect()} == want
    assert spanning > 5


def test_source_header(spark):
    text = "> **Source type:** ticket\n> **URL:** \n> **Fetched:** 2026-04-30\n> ⚠️ Do not edit\n\nBody\n> **URL:** http://late\n"
    got = C.source_headers(spark.createDataFrame([("a.md", text), ("b.md", "Body")], "name string, text string")).collect()
    assert [(r.name, r.source_type, r.url, str(r.fetched)) for r in sorted(got)] == [("a.md", "ticket", None, "2026-04-30"), ("b.md", None, None, "None")]


def test_header_blocks_of_any_length(spark):
    for n in (0, 1, 150, 100_000):
        text = "> note\n" * n + "> **URL:** http://x\n> 🔲 **Source type:** y\n> **Fetched:** 2024-05-06\n\n\nBody\n> **URL:** http://late\n"
        table = spark.createDataFrame([("a.md", text), ("b.md", "> **URL:** http://x"), ("c.md", "")], "name string, text string")
        got = {r.name: (r.url, str(r.fetched), r.b) for r in C.source_headers(table).join(table, "name").withColumn("b", C.source_body(F.col("text"))).collect()}
        assert got == {"a.md": ("http://x", "2024-05-06", "Body\n> **URL:** http://late\n"), "b.md": ("http://x", "None", ""), "c.md": (None, "None", "")}


def test_blurbs_of_fences_and_long_paragraphs(make_pages):
    lines = "\n".join(f"w{i}" for i in range(40))
    texts = {
        "a.md": page("```\ncode text\n```\n\nBehind it.", title="A"),
        "b.md": page("~~~ py\n```\nstill code\n~~~\nBehind it.", title="B"),
        "c.md": page(lines + "\n\nnext", title="C"),
        "d.md": page("```\nnever closed", title="D"),
        "e.md": page("Text\n```\ncode\n```\nmore", title="E"),
        "f.md": page("x\n" * 100_000, title="F"),
    }
    got = dict(rows(prj.page_blurb(make_pages(texts)), "path", "blurb"))
    assert got == {"a.md": "Behind it.", "b.md": "Behind it.", "c.md": lines, "d.md": "", "e.md": "Text", "f.md": ("x\n" * 90)}


def test_dates(spark):
    cases = {
        "2024-01-05": "2024-01-05", "2024-1-5": "2024-01-05", "2024-1-5 x": None, "2024-01-05 x": "2024-01-05", "2024-1-5 10:00:00": "2024-01-05",
        "2024-1-5T10:00": "2024-01-05", "2024-12-1x": None, "2024-13-01": None, "soon": None, "": None, "2024-1-123": None,
    }
    table = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.d and str(r.d) for r in table.select("raw", day(F.col("raw")).alias("d")).collect()} == cases


def test_projections(make_pages):
    texts = {
        "a.md": page("# H\n\n- list\n\nFirst _word_ of `it`.\n", title="A" * 36, last_reviewed="2026-04-29", source="sources/a.md"),
        "b.md": page("snake_case text\nsecond line", title="B" * 60, last_reviewed="soon", category=None),
        "c.md": page("", title=None, last_reviewed="2025-01-01", status="null"),
    }
    pages = make_pages(texts)
    assert rows(prj.page_blurb(pages), "path", "blurb") == [("a.md", "First "), ("b.md", "snake_case text\nsecond line"), ("c.md", "")]
    assert rows(prj.labels(pages), "label")[0] == ("A" * 33 + "…",)
    assert rows(prj.review_age(pages, "2026-04-30"), "path", "reviewed") == [("a.md", "yesterday"), ("b.md", ""), ("c.md", "1 years ago")]
    summary = prj.page_summary(pages)
    assert rows(summary, "file", "title", "category", "status", "last_reviewed") == [
        ("a.md", "A" * 36, "Yard", "Running", "2026-04-29"), ("b.md", "B" * 50, "", "Running", "soon"), ("c.md", "", "Yard", "", "2025-01-01"),
    ]
    assert prj.column_widths(summary).first().asDict() == {"file": 4, "title": 50, "category": 8, "status": 7, "last_reviewed": 13}
    assert {len(r.line) for r in prj.padded_rows(summary).collect()} == {4 + 50 + 8 + 7 + 13 + 16}


def test_filters(make_pages):
    texts = {
        "a.md": page(title="A", status="Draft", tags="[Claude-API, x]", last_reviewed="2026-01-01"),
        "b.md": page(title="B", status="draft", category="AI / Meta", last_reviewed=None),
        "c.md": page(title="C", status="Live", type="entity", last_reviewed="2026-05-10"),
    }
    pages = make_pages(texts)

    def names(df):
        return "".join(sorted(r.path[0] for r in df.collect()))

    as_of = "2026-04-30"
    assert names(filters.matching(pages, status="DRAFT")) == "ab"
    assert names(filters.matching(pages, status="")) == "abc"
    assert names(filters.matching(pages, category="meta")) == "b"
    assert names(filters.matching(pages, page_type="META")) == "b"
    assert names(filters.matching(pages, tag="claude-api")) == "a"
    assert names(filters.matching(pages, stale_days=90, as_of=as_of)) == "a"
    assert names(filters.matching(pages, stale_days=0, as_of=as_of)) == "ab"
    assert names(filters.matching(pages, stale_days=-10, as_of=as_of)) == "abc"
    assert names(filters.visible_nodes(pages, types=["use-case", "meta"], text="B.MD")) == "b"
    assert names(filters.visible_nodes(pages, tags=["x", "y"])) == "a"
