"""Scanning, frontmatter and the page table."""

import random

import pytest
import yaml
from conftest import page
from pyspark.sql import functions as F

from mdlake import lake as lakes
from mdlake.functions.text import title_from_path
from mdlake.sources import documents, folder, pages as P


def write(root, rel, text, encoding="utf-8"):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_scan_of_a_folder(spark, tmp_path):
    write(tmp_path, "cranes/north-gate.md", page("Lifts up to nine tons.", title="North gate"))
    write(tmp_path, "use cases/a+b é.md", page(title="Odd").replace("\n", "\r\n"))
    write(tmp_path, "notes.txt", "no")
    docs = documents.scan_documents(spark, str(tmp_path))
    rows = {r.path: r.text for r in docs.collect()}
    assert set(rows) == {"cranes/north-gate.md", "use cases/a+b é.md"}
    assert "\r" not in rows["use cases/a+b é.md"]
    titles = {r.path: r.title for r in P.page_table(docs).collect()}
    assert titles["cranes/north-gate.md"] == "North gate"
    named = {r.path for r in documents.manifest(spark, str(tmp_path)).collect()}
    assert named == set(rows) | {"notes.txt"}


def test_hidden_names_are_scanned(spark, tmp_path):
    names = ["_a.md", ".c.md", "_notes/d.md", "_notes/.deep/er/e.md", "x/y/z/f.md", "sources/_s.md", "sources/.t.md", "sources/u.txt"]
    for name in names:
        write(tmp_path, name, page(title=name))
    for splits in (1, 3, 256):
        got = folder.read_folder(spark, str(tmp_path), "*.md", splits=splits)
        assert {r.path for r in got.collect()} == {n for n in names if n.endswith(".md")}
    reader = folder.FolderReader({"path": str(tmp_path), "splits": "3"})
    parts = reader.partitions()
    assert {type(p) for p in parts} == {folder.Files, folder.Below} and len(parts) == 4  # two files at the top, and three folders
    lake = lakes.open_folder(spark, str(tmp_path))
    assert {r.path for r in lake.docs.collect()} == {n for n in names if n.endswith(".md")}
    assert {r.path for r in lake.manifest.where("length > 0 AND modified IS NOT NULL").collect()} == set(names)
    assert {r.name for r in lake.source_files.collect()} == {"_s.md", "u.txt"}
    assert {r.path for r in lake.pages.collect()} == {"_a.md", ".c.md", "_notes/d.md", "_notes/.deep/er/e.md", "x/y/z/f.md"}
    assert folder.read_folder(spark, f"file://{tmp_path}/sources").count() == 3
    assert folder.read_folder(spark, str(tmp_path / "none")).count() == 0
    assert not folder.is_known("viewfs://store/x")


@pytest.mark.parametrize("profile, kept", [("query", {"p/keep.md", "evals/e.md", "docs/d.md"}), ("lint", {"p/keep.md", "docs/d.md"}), ("reader", {"p/keep.md"})])
def test_exclusions_by_profile(make_pages, profile, kept):
    texts = {n: page(title="T") for n in ("index.md", "sources/raw.md", "p/README.md", "_templates/t.md", "p/keep.md", "evals/e.md", "docs/d.md")}
    assert {r.path for r in make_pages(texts, profile=profile).collect()} == kept


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    (tmp_path / "log.md").write_text("\n".join(lines))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/log.md").write_text("other")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = documents.read_root_lines(spark, str(tmp_path), "log.md")
        assert got.rdd.getNumPartitions() > 1
        rows = sorted((r.line_no, r.line) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(enumerate(lines))


def test_missing_companions_are_empty(spark, tmp_path):
    write(tmp_path, "a.md", page(title="A"))
    lake = lakes.open_folder(spark, str(tmp_path))
    assert lake.change_log.count() == 0
    assert lake.index_entries.count() == 0
    assert lake.source_files.count() == 0


REASONS = {
    "none.md": ("plain", "no_frontmatter"),
    "open.md": ("---\ntitle: x\n", "unterminated"),
    "empty.md": ("---\n# only\n---\nb", "empty"),
    "list.md": ("---\n- a\n- b\n---\n", "not_mapping"),
    "broken.md": ("---\ntitle: [a\n---\n", "invalid_yaml"),
    "scalar.md": ("---\njust words\n---\n", "not_mapping"),
    "dashes.md": ("----\ntitle: x\n---\n", "invalid_yaml"),
    "nomap.md": ("---\n{}\n---\n", "empty"),
}


def test_rejected_with_reason(make_docs):
    docs = make_docs({n: t for n, (t, _) in REASONS.items()})
    got = {r.path: r.reason for r in P.rejected_pages(docs).collect()}
    assert got == {n: r for n, (_, r) in REASONS.items()}
    native = {r.path: r.reason for r in P.rejected_pages(docs, yaml="native").collect()}
    assert native["broken.md"] == native["scalar.md"] == native["dashes.md"] == "unsupported_yaml"


def test_fence_rules(make_docs):
    docs = make_docs({
        "tight.md": "---title: x\n---\nbody",
        "inner.md": "---\ntitle: a\n--- more\ntext",
        "long.md": "---\ntitle: a\n----\n\n\nb",
        "plain.md": "no fence",
    })
    body = {r.path: r.body for r in P.body_split(docs).collect()}
    assert body == {"tight.md": "body", "inner.md": " more\ntext", "long.md": "-\n\n\nb", "plain.md": "no fence"}
    assert {r.path for r in P.page_table(docs).collect()} == {"tight.md", "inner.md", "long.md"}


def test_fields_and_fallbacks(make_pages):
    texts = {
        "p/my-3d-page.md": page(title=None, category="A meta thing", status='""', tags="\n  - a b\n  - 'c'", last_reviewed="2026-13-45"),
        "p/typed.md": page(title='"Q: x"', type="entity", category=None, mentioned_in="[./a.md, b.md]", tags="abc", created="2026-04-30T10:00:00"),
        "p/upper.md": page(title="U", type="Entity", source="sources/x/y.md"),
    }
    got = {r.path: r for r in make_pages(texts).collect()}
    first, typed, upper = (got[f"p/{n}.md"] for n in ("my-3d-page", "typed", "upper"))
    assert (first.title, first.page_type, first.status, first.tags) == ("My 3D Page", "meta", "", ["a b", "c"])
    assert first.last_reviewed is None and first.last_reviewed_raw == "2026-13-45"
    assert (typed.title, typed.page_type, typed.mentioned_in, typed.tags) == ("Q: x", "entity", ["./a.md", "b.md"], ["abc"])
    assert str(typed.created) == "2026-04-30"
    assert (upper.page_type, upper.type, upper.source_name) == ("use-case", "Entity", "y.md")


@pytest.mark.parametrize("stem", ["some-page", "3d-print", "it's-fine", "x2y-Zed", "ärger-über", "a_b-c", "UPPER-case"])
def test_title_case(spark, stem):
    got = spark.range(1).select(title_from_path(F.lit(f"d/{stem}.md"))).first()[0]
    assert got == stem.replace("-", " ").title()


SCALARS = [
    "word", "two words", '"quoted: yes"', "'single'", "yes", "No", "true", "012", "0x1F", "1:30", "12", "-7", "0", "1.5", ".5",
    "1_000", "~", "null", "", "2026-04-30", "2026-4-3", "2026-04-30 10:00:00", "a:b", "a: b", "a #b", "a#b", "# c", "- x", "-x",
    "[a, b]", "[]", "[a, yes]", "[a, 'b c']", "[a,, b]", "[1, 2]", "{a: 1}", "*x", "&x y", "!tag", "|", ">", "%x", "@x", "`x`",
    '"esc\\n"', "'it''s'", "é ü", "x:", "? y", "=", "a, b", "[a: b]", "[null, x]", "[a]  # note", "x  # note", "+1", "1e3", "1.0e+3",
    "<<", "[x y, z]", '["a", "b"]', "[-a, b]", "[a, b,]", "a\tb", " x", "2026-04-30T1:02:03Z", ".inf", "0o7", "9:5", "1,000",
]


def as_text(value):
    return None if value is None else str(value)


def expected(block):
    """What PyYAML makes of a block, with dates as text."""
    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {
            k: [x for x in v if not x[0].endswith("timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
        }
    try:
        data = yaml.load(block, Loader)
    except (yaml.YAMLError, ValueError):
        return None
    return data if isinstance(data, dict) and data else None


def random_block(rng):
    lines = []
    for key in rng.sample(["title", "tags", "owner", "mentioned_in", "x-y"], rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.7:
            lines.append(f"{key}:{rng.choice([' ', ' ', ' ', '  ', ''])}{rng.choice(SCALARS)}")
        else:
            lines.append(f"{key}:")
            indent = rng.choice(["", "  "])
            lines += [f"{indent}- {rng.choice(SCALARS)}" for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "# remark", "  continued", "  - stray", "owner: again"]))
    return "\n".join(lines)


def test_native_reader_agrees_with_yaml(spark):
    """Whatever the built-in reader accepts, PyYAML reads the same way."""
    rng = random.Random(7)
    blocks = [f"k: {s}\ntags: {s}" for s in SCALARS] + [f"k: v\ntags:\n  - {s}\n  - z" for s in SCALARS]
    blocks += [random_block(rng) for _ in range(1500)]
    docs = spark.createDataFrame([(f"p{i}.md", f"---\n{b}\n---\n") for i, b in enumerate(blocks)], "path string, text string")
    native = {r.path: r for r in P.read_frontmatter(docs, "native").collect()}
    auto = {r.path: r for r in P.read_frontmatter(docs, "auto").collect()}
    strict = {r.path: r for r in P.read_frontmatter(docs, "strict").collect()}
    accepted = 0
    for i, block in enumerate(blocks):
        want, n, a, s = expected(block), native[f"p{i}.md"], auto[f"p{i}.md"], strict[f"p{i}.md"]
        assert (a.reason is None) == (want is not None), block
        assert (s.reason is None) == (want is not None), block
        if n.reason == "unsupported_yaml":
            continue
        accepted += 1
        assert (n.reason is None) == (want is not None), block
        if want is None:
            continue
        assert set(n.fm) == set(want), block
        for key, value in want.items():
            if not isinstance(value, list):
                assert n.fm[key] == as_text(value), block
        for key in ("tags", "mentioned_in"):
            value = want.get(key)
            names = [str(v) for v in value] if isinstance(value, list) else ([] if value in (None, "") else [str(value)])
            assert getattr(n, key) == names, block
            assert getattr(s, key) == names or value is False, block
        if not isinstance(want.get("title"), list):
            assert n.title == s.title
    assert accepted > 100
