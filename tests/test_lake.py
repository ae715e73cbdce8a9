"""Checks, graph, search and upkeep on small corpora."""

import json
import math
import random
from collections import Counter

import pytest
from conftest import page
from pyspark.sql import functions as F

from mdlake import lake as lakes, session
from mdlake.operators import checks, edges as E, filters, graph, joins, maintenance, search, sinks
from mdlake.operators import aggregates as agg
from mdlake.operators import projections as prj
from mdlake.plans import lint, reader
from mdlake.plans import query as page_query
from mdlake.streaming import log_stream as LS

CLEAN = "## What This Is\n## How It Works\n## Risk Register\n## Prerequisites\n"


def write(root, texts):
    for rel, text in texts.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_nine_checks_on_a_folder(spark, tmp_path):
    write(tmp_path, {
        "p/ok.md": page(CLEAN, title="Ok", source="sources/used.md"),
        "p/isnt.md": page(CLEAN.replace("This Is", "This Isn't"), title="Isnt"),
        "p/bad.md": page("see sources/used.md\n| Risk | Likelihood | I | M | S |\n|---|---|---|---|---|\n| " + "r" * 90 + " | l | i | m | 🔲 |", title="Bad", owner="", status="false", tags="[]"),
        "p/lost.md": page(CLEAN, title="Lost", source="sources/gone.md"),
        "p/meta.md": page("sources/used.md", title="Meta", type="meta"),
        "entities/e.md": page("## What It Is\nsources/used.md", title="E", type="entity", mentioned_in="[p/ok.md, ./p/ok.md, p/none.md]"),
        "index.md": "[a](./p/ok.md) [b](./p/isnt.md) [c](./p/bad.md) [d](./p/lost.md) [e](./p/meta.md) [x](./CONVENTIONS.md) [y](./p/dead.md)\n<!-- [z](./p/hidden.md)\n-->",
        "CONVENTIONS.md": "rules", "sources/used.md": "s", "sources/orphan.txt": "s", "sources/.hidden": "s", "sources/deep/x.md": "s",
    })
    lake = lakes.open_folder(spark, str(tmp_path))
    found = pairs(lint.findings(lake), "file", "check", "detail")
    use, ent = "use-case page missing section: ", "entity page missing section: "
    assert found == sorted([
        ("entities/e.md", "mentioned_in_missing", "mentioned_in: './p/ok.md' does not exist"),
        ("entities/e.md", "mentioned_in_missing", "mentioned_in: 'p/none.md' does not exist"),
        ("entities/e.md", "missing_section", ent + "How We Use It"),
        ("entities/e.md", "missing_section", ent + "Where It Appears"),
        ("entities/e.md", "not_in_index", "not listed in index.md"),
        ("index.md", "index_dead_link", "entry 'p/dead.md' does not exist"),
        ("p/bad.md", "frontmatter", "missing field: owner"),
        ("p/bad.md", "likely_missing_source", "body references sources/used.md but no source field — should this be set?"),
        *[("p/bad.md", "missing_section", use + s) for s in ("What This Is", "How It Works", "Risk Register", "Prerequisites")],
        ("p/bad.md", "open_risk", "🔲 " + "r" * 80),
        ("p/lost.md", "source_missing", "source 'sources/gone.md' not found in sources/"),
        ("sources/orphan.txt", "orphan_source", "no wiki page has source pointing here"),
    ])
    assert pairs(checks.mentioned_in_missing(lake.pages, strip_dot_slash=True), "detail") == [("mentioned_in: 'p/none.md' does not exist",)]
    total = checks.totals(lint.findings(lake)).first()
    assert (total.total, total.open_risks, total.structural) == (15, 1, 14)
    sinks.write_json(lint.findings(lake), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert pairs(back, "file", "check", "detail") == found


def test_edges(make_pages):
    pages = make_pages({
        "a.md": page("[B](./b.md) [B](b.md) [self](a.md) [none](x.md)", title="A"),
        "b.md": page("[up](../a.md)", title="B"),
        "tide.md": page(title="Tide"),
        "entities/harbour.md": page(title="Harbour", type="entity", mentioned_in="[./tide.md, tide.md, gone.md]"),
    })
    found = E.edges(pages)
    assert pairs(found, "src", "dst") == [("a.md", "b.md"), ("b.md", "a.md"), ("tide.md", "entities/harbour.md")]
    assert pairs(agg.total_degree(found, pages), "path", "degree") == [("a.md", 2), ("b.md", 2), ("entities/harbour.md", 1), ("tide.md", 1)]
    assert agg.graph_stats(found, pages).first().asDict() == {"pages": 4, "links": 3, "orphans": 1}
    assert pairs(graph.orphan_pages(found, pages), "path") == [("tide.md",)]
    assert ("a.md", "mentions", "B") in pairs(E.mention_titles(found, pages), "path", "direction", "title")


def test_empty_corpus(make_pages):
    pages = make_pages({"x.md": "no page"})
    found = E.edges(pages)
    assert found.count() == 0
    assert agg.graph_stats(found, pages).first().asDict() == {"pages": 0, "links": 0, "orphans": 0}


def test_bundle_end_to_end(spark, tmp_path):
    body = "## What This Is\nPumps and valves.\n\n## Risk Register\n| Risk | Likelihood | Impact | Mitigation | Status |\n| --- | --- | --- | --- | --- |\n| Leak | Rare | Flood | Bucket | ⚠️ Call a plumber |\n"
    write(tmp_path, {"plant/pump.md": page(body, title="Pump", tags="[water]"), "log.md": "## [2025-03-09] init | Opened\n"})
    tables = reader.collections(lakes.open_folder(spark, str(tmp_path)))
    assert set(tables) == {"pages", "edges", "log", "risks", "open_qs", "search"}
    records = {}
    for r in sinks.reader_bundle(tables).collect():
        records.setdefault(r.collection, []).append(json.loads(r.json))
    assert records["pages"][0]["title"] == "Pump" and records["pages"][0]["tags"] == ["water"]
    assert records["log"] == [{"date": "2025-03-09", "action": "init", "detail": "Opened"}]
    assert records["risks"][0]["status_symbol"] == "⚠️"
    assert records["search"][0]["body"].startswith("## What This Is")
    sinks.write_bundle(tables, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle/pages")).count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, how):
    rng = random.Random(1)
    left = [(rng.choice(["hot"] * 6 + [f"k{i}" for i in range(8)]), i) for i in range(3000)] + [(None, -1)]
    right = [("hot", 1), ("k1", 2), ("k3", 3), ("k3", 4), ("other", 5)]
    a = spark.createDataFrame(left, "k string, v int")
    b = spark.createDataFrame(right, "k string, w int")
    assert {r.k for r in joins.hot_keys(a, "k", 500).collect()} == {"hot"}
    got, want = joins.skew_join(a, b, "k", how, "v", target=500), a.join(b, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_slice_exceeds_its_target(spark):
    half = spark.range(40_000).select(F.lit("half").alias("k"), "id")
    many = spark.range(40_000).select(F.concat(F.lit("m"), (F.col("id") % 8).cast("string")).alias("k"), "id")
    left = half.union(many)
    hot = {r.k: r.slices for r in joins.hot_keys(left, "k", 4000).collect()}
    assert hot == {"half": 10, **{f"m{i}": 2 for i in range(8)}}
    sliced = left.join(joins.hot_keys(left, "k", 4000), "k").groupBy("k", F.pmod(F.xxhash64("id"), F.col("slices"))).count()
    assert max(r["count"] for r in sliced.collect()) <= 4000 * 1.2


def test_known_hot_keys_are_not_counted_again(spark, capsys):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(20)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3)], "k string, w int")
    table = spark.createDataFrame([("hot", 4)], "key string, slices int")
    for listed in (1000, 0):
        hot = joins.Hot(table)
        if not listed:
            hot.few = None  # as if there were too many for a map
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = joins.skew_join(left, right, "k", how, "v", hot=hot)
            assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
        got.explain("formatted")
        assert "count(" not in capsys.readouterr().out
    none = joins.Hot(table.limit(0))
    assert joins.skew_join(left, right, "k", "left", "v", hot=none).count() == 321


def test_the_sketch_misses_only_what_its_error_allows(spark):
    """Keys with more than twice 3.5 / map size of all rows are found, and counted within that error."""
    rng = random.Random(3)
    sizes = {f"h{i}": int(40_000 / (i + 1)) for i in range(60)}
    keys = [(k,) for k, n in sizes.items() for _ in range(n)] + [(f"once{i}",) for i in range(60_000)] + [(None,)] * 500
    rng.shuffle(keys)
    rows = spark.createDataFrame(keys, "key string").repartition(9)
    tracked = 1000
    error = 3.5 * len(keys) / 1024
    found = {r.key: r.n for r in joins.frequent(rows, 0, tracked).collect()}
    for key, n in sizes.items():
        assert key in found or n <= 2 * error
    assert all(abs(n - sizes.get(k, 1)) <= error for k, n in found.items())


def test_hot_pages_count_both_ends(make_pages):
    texts = {f"p{i}.md": page("[a](hub.md)", mentioned_in="[./hub.md, other.md]") for i in range(40)}
    texts["hub.md"] = page("".join(f"[x](p{i}.md)" for i in range(30)))
    hot = {r.key: r.slices for r in E.link_ends(make_pages(texts), target=50).collect()}
    assert hot["hub.md"] == 3 and "p1.md" not in hot  # 40 links, 40 back-links under either name, 30 of its own


def test_programs_see_their_own_folders(spark, tmp_path):
    write(tmp_path, {p: page(CLEAN, title="T") for p in ("a.md", "docs/b.md", "tests/c.md", "evals/d.md", "scripts/e.md", "x/docs/f.md")})
    lake = lakes.open_folder(spark, str(tmp_path))
    assert pairs(lake.pages, "path") == [("a.md",), ("x/docs/f.md",)]
    assert {f for (f,) in pairs(lint.findings(lake), "file")} == {"a.md", "docs/b.md", "tests/c.md", "x/docs/f.md"}
    assert len(pairs(page_query.summary(lake), "file")) == 5


def test_k_hop_against_breadth_first(spark):
    rng = random.Random(2)
    links = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(45)}
    links = {(str(a), str(b)) for a, b in links if a != b}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = graph.both_ways(spark.createDataFrame(sorted(links), "src string, dst string"))
    seeds = spark.createDataFrame([("0",), ("7",)], "path string")
    want = []
    for seed in ("0", "7"):
        seen, ring = {seed: 0}, {seed}
        for hop in (1, 2, 3):
            ring = {n for r in ring for n in near.get(r, ())} - set(seen)
            seen |= dict.fromkeys(ring, hop)
        want += [(seed, n, h) for n, h in seen.items()]
    ball = graph.k_hop(df, seeds, 3)
    assert pairs(ball, "seed", "path", "hop") == sorted(want)


def test_many_seeds_at_once(spark):
    rng = random.Random(9)
    edges = {(f"n{rng.randrange(1500):04}", f"n{rng.randrange(1500):04}") for _ in range(2500)}
    links = graph.both_ways(spark.createDataFrame([e for e in edges if e[0] != e[1]], "src string, dst string"))
    seeds = spark.createDataFrame([(f"n{i:04}",) for i in range(0, 1200)] + [("n0003",), ("lonely",)], "path string")
    numbers, found = graph.k_hop_many(links, seeds, 3)
    assert sorted(r.number for r in numbers.collect()) == list(range(1201))  # two blocks of seeds
    want = pairs(graph.k_hop(links, seeds, 3), "seed", "path", "hop")
    assert pairs(graph.reached_pairs(numbers, found), "seed", "path", "hop") == want
    per_hop = {r.hop: r["count"] for r in found.groupBy("hop").count().collect()}
    assert max(per_hop.values()) <= 2 * 1501  # a row per page and block, for far more pairs
    counts = Counter((p, h) for _, p, h in want)
    assert {(r.path, r.hop): r.n_seeds for r in graph.reach_counts(found).collect()} == counts
    few = graph.k_hop_many(links, seeds.limit(0), 2)
    assert graph.reached_pairs(*few).count() == 0


def test_rows_and_their_counts_in_one_job(spark, tmp_path):
    write(tmp_path, {f"p{i}.md": page(RISKS if i % 2 else "x", title=f"T{i}", status="Draft" if i < 4 else "Live") for i in range(6)})
    lake = lakes.open_folder(spark, str(tmp_path))
    out = str(tmp_path.parent / "listing")
    for conditions in ({}, {"status": "Draft"}):
        got = page_query.write_summary(lake, out, **conditions)
        assert got == page_query.summary_count(lake, **conditions).first().asDict()
        assert spark.read.parquet(out).count() == got["n_pages"]
        got = page_query.write_risks(lake, out, **conditions)
        assert got == page_query.risks_count(lake, **conditions).first().asDict()
        assert spark.read.parquet(out).count() == got["n_rows"] > 0


RISKS = "## Notes\n\n| Risk | Likelihood | Impact | Mitigation | Status |\n| --- | --- | --- | --- | --- |\n| a | l | i | m | 🔲 |\n| b | l | i | m | ✅ |\n| c | l | i | m | ⚠️ now |\n"


def test_search_against_direct_scoring(make_pages):
    rng = random.Random(4)
    words = ["alpha", "alphas", "alpine", "beta", "betta", "gamma", "delta", "über"]
    texts = {f"p{i}.md": page(" ".join(rng.choices(words, k=rng.randint(0, 30))), title=" ".join(rng.choices(words, k=3)), tags=f"[{rng.choice(words)}]") for i in range(25)}
    docs = prj.search_docs(make_pages(texts))
    index = search.build_index(docs)
    fields = {(r.doc, r.field): r.terms for r in search.field_terms(docs).collect()}
    names = sorted({f for _, f in fields})
    n_docs = len(texts)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    def weight(term, word):
        if term == word:
            return 1.0
        if term.startswith(word):
            return search.PREFIX_WEIGHT * len(term) / (len(term) + 0.3 * (len(term) - len(word)))
        reach = int(0.2 * len(word) + 0.5)
        far = distance(term, word)
        return search.FUZZY_WEIGHT * len(term) / (len(term) + far) if reach and far <= reach else 0.0

    def direct(query):
        scores = {}
        for f in names:
            mean = sum(len(t) for (_, g), t in fields.items() if g == f) / n_docs
            for term in {t for (_, g), ts in fields.items() if g == f for t in ts}:
                w = sum(weight(term, q) for q in query.split())
                holders = [(d, ts) for (d, g), ts in fields.items() if g == f and term in ts]
                idf = math.log(1 + (n_docs - len(holders) + 0.5) / (len(holders) + 0.5))
                for d, ts in holders if w else ():
                    tf = ts.count(term)
                    norm = search.DELTA + tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(ts) / mean))
                    scores[d] = scores.get(d, 0) + w * (2 if f == "title" else 1) * idf * norm
        return scores

    for query in ("alpha", "alp beta", "über delta", "nothing"):
        got = {r.doc: r.score for r in search.search(index, query).collect()}
        assert got == pytest.approx(direct(query))
    for words, prefix in (("alpha", False), ("alp", True)):
        exact = {r.doc for r in search.search(index, words, prefix=prefix, fuzzy=False).collect()}
        hit = (lambda t: t.startswith(words)) if prefix else (lambda t: t == words)
        assert exact == {d for (d, _), ts in fields.items() if any(map(hit, ts))}
    assert search.search(index, "  !").count() == 0
    best = [r.doc for r in search.top(search.search(index, "alpha"), 5).collect()]
    want = direct("alpha")
    assert best == sorted(want, key=lambda d: (-round(want[d], 6), d))[:5]


def test_saved_index(spark, make_pages, tmp_path):
    index = search.build_index(prj.search_docs(make_pages({"a.md": page("red fox", title="A"), "b.md": page("dog", title="Fox")})))
    search.save_index(index, str(tmp_path))
    again = search.load_index(spark, str(tmp_path))
    assert pairs(search.search(again, "fox"), "doc") == [("a.md",), ("b.md",)]


def test_upkeep(spark, make_pages):
    head = "> **Source type:** x\n> **URL:** http://x\n> **Fetched:** 2026-01-01\n\n"
    words = " ".join(f"w{i}" for i in range(100))
    sources = spark.createDataFrame([
        ("same.md", head + words), ("near.md", head + words), ("far.md", head + words), ("nourl.md", words), ("tiny.md", head + "a b"),
    ], "name string, text string")
    fresh = spark.createDataFrame([
        ("same.md", words), ("near.md", words + " more"), ("far.md", words[::-1]), ("nourl.md", "x"), ("tiny.md", "a c"),
    ], "name string, text string")
    assert pairs(maintenance.source_drift(sources, fresh), "name", "similarity") == [("far.md", 0.0), ("tiny.md", 0.0)]
    assert pairs(maintenance.header_violations(sources), "name", "missing") == [("nourl.md", "fetched"), ("nourl.md", "source_type")]
    log = spark.createDataFrame([("log.md", 0, "## [2026-04-30] add | x"), ("log.md", 1, "## oops"), ("log.md", 2, "# Log")], "path string, line_no bigint, line string")
    assert sorted(r.reason for r in maintenance.log_violations(log).collect()) == ["no_entry", "no_init_entry"]
    pages = make_pages({"p.md": page("## One\n## TWO ", title="P", source="sources/s.md")})
    docs = spark.createDataFrame([("s.md", "# one\n## Two\n### Three\n" + "x" * 100)], "name string, text string")
    assert pairs(maintenance.section_coverage(pages, docs), "path", "heading") == [("p.md", "three")]
    assert maintenance.coverage_ratio(pages, docs, below=0.2).count() == 1


def test_file_names(make_pages):
    texts = {"p/AB-12-good-name.md": page(title="a"), "p/Bad Name.md": page(title="b"), "p/e.md": page(title="c", type="entity"), "entities/c.md": page(title="d", type="concept")}
    assert pairs(filters.misnamed(make_pages(texts)), "path", "reason") == [("p/Bad Name.md", "not_kebab_case"), ("p/e.md", "entity_outside_entities")]


def test_order_by_path_components(make_pages):
    from mdlake.functions.text import path_order

    pages = make_pages({p: page(title="t") for p in ("a.md", "a-b.md", "a/b.md")})
    assert [r.path for r in pages.orderBy(path_order(F.col("path"))).collect()] == ["a/b.md", "a-b.md", "a.md"]
    tree = make_pages({"x.md": page(title="b"), "y.md": page(title="A"), "z.md": page(title="a", category=None)})
    assert [r.title for r in agg.category_tree(tree).collect()] == ["a", "A", "b"]


def test_log_stream_drops_repeats(spark, tmp_path):
    write(tmp_path, {"in/1.md": "## [2026-04-28] init | Created\n## [2026-02-30] add | Never\n## [2026-04-29] add | A\n", "in/2.md": "## [2026-04-29] add | A\n## [2026-04-30] add | B\nnoise\n"})
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    LS.run_once(LS.log_stream(spark, str(tmp_path / "in")), out, state)
    assert pairs(spark.read.parquet(out), "date", "detail") == [("2026-04-28", "Created"), ("2026-04-29", "A"), ("2026-04-30", "B")]
    write(tmp_path, {"in/3.md": "## [2026-04-30] add | B\n## [2026-05-01] add | C\n"})
    LS.run_once(LS.log_stream(spark, str(tmp_path / "in")), out, state)
    rejected = str(tmp_path / "rejected")
    LS.run_once(LS.rejected_stream(spark, str(tmp_path / "in")), rejected, str(tmp_path / "rejected-state"))
    assert pairs(spark.read.parquet(rejected), "date", "detail") == [("2026-02-30", "Never")]
    assert pairs(spark.read.parquet(out), "date", "detail")[-2:] == [("2026-04-30", "B"), ("2026-05-01", "C")]


class _Session:
    """Just what shared_dir looks at."""

    def __init__(self, master, named):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{master}-{named}"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: named or default)})


def test_shared_folder():
    assert session.shared_dir(_Session("spark://x", "hdfs://c/ck")) == "hdfs://c/ck"
    with pytest.raises(ValueError):
        session.shared_dir(_Session("spark://x", None))
    local = _Session("local[2]", None)
    assert session.shared_dir(local) == session.shared_dir(local)


def test_texts_are_not_written_again(spark, tmp_path, monkeypatch):
    written = {}

    def kept(df, name, partition=None):
        written[name] = df.columns
        return session.stored(df, name, partition)

    monkeypatch.setattr(lakes, "stored", kept)
    monkeypatch.setattr(lakes, "_DERIVED", {})
    lake = lakes.derived(spark, "/root/testdata/sf0.001")
    lake.change_log.count(), lake.sources.count(), lake.texts.count()
    assert written == {}
    assert lake.pages.count() == lake.texts.count() > 0
    assert set(lake.texts.columns) - set(lake.pages.columns) == {"text", "body"}
    lake.edges, lake.findings, lake.source_digests
    assert {"pages", "edges", "findings"} <= set(written)
    assert not any({"text", "body"} & set(columns) for columns in written.values())


def test_findings_parse_texts_once(spark, tmp_path, monkeypatch):
    written = []

    def kept(df, name, partition=None):
        written.append((name, df.columns))
        return session.stored(df, name, partition)

    monkeypatch.setattr(lakes, "stored", kept)
    write(tmp_path, {"p/a.md": page("## What This Is", title="A", owner=""), "evals/b.md": page("", title="B"), "tests/c.md": page(CLEAN, title="C")})
    first, later = (lakes.open_folder(spark, str(tmp_path)) for _ in range(2))
    found = pairs(lint.findings(first), "file", "check", "detail")
    assert [name for name, columns in written if "details" in columns] == ["pages"] and len([1 for name, _ in written if name == "pages"]) == 1
    assert "details" not in first.pages.columns and pairs(first.pages, "path") == [("p/a.md",)]
    written.clear()
    later.pages.count()
    assert pairs(lint.findings(later), "file", "check", "detail") == found and {f for f, *_ in found} == {"p/a.md", "tests/c.md"}
    assert ("page-checks", ["path", "details"]) in written
