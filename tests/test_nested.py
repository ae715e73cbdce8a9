"""Nested frontmatter against PyYAML."""

import json
import random

import yaml
from pyspark.sql import functions as F

from mdlake.functions import nested
from mdlake.sources import pages as P

PLAIN = type("Loader", (yaml.SafeLoader,), {
    "yaml_implicit_resolvers": {k: [(t, r) for t, r in v if not t.endswith(":timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
})


def expected(block):
    try:
        data = yaml.load(block, PLAIN)
    except (yaml.YAMLError, ValueError):
        return None
    return data if isinstance(data, dict) else None


def written(rng, depth=0, indent=0):
    """Lines of a random mapping."""
    out, pad = [], " " * indent
    for k in rng.sample(["title", "tags", "x-1", "owner", "meta", "a_b", "when"], rng.randint(1, 4)):
        kind = rng.choice(["scalar", "scalar", "map", "list", "maps", "block", "flow", "none", "flat list"]) if depth < 3 else "scalar"
        step = rng.choice([1, 2, 4])
        if kind == "scalar":
            out.append(f"{pad}{k}: {scalar(rng)}")
        elif kind == "none":
            out.append(f"{pad}{k}:")
        elif kind == "flow":
            out.append(f"{pad}{k}: [" + ", ".join(rng.choices(["a", "b c", "12", "x.y"], k=rng.randint(0, 3))) + "]")
        elif kind == "map":
            out += [f"{pad}{k}:", *written(rng, depth + 1, indent + step)]
        elif kind in ("list", "flat list"):
            at = indent if kind == "flat list" else indent + step
            out += [f"{pad}{k}:", *(f"{' ' * at}- {scalar(rng)}" for _ in range(rng.randint(1, 3)))]
        elif kind == "maps":
            out.append(f"{pad}{k}:")
            for _ in range(rng.randint(1, 3)):
                first, *rest = written(rng, depth + 1, indent + step + 2)
                out += [" " * (indent + step) + "- " + first.lstrip(), *rest]
        else:
            style = rng.choice("||>")
            out.append(f"{pad}{k}: {style}")
            out += [" " * (indent + step) + rng.choice(["some text", "a: b", "- no item", "# no comment", "é 12"]) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.15:
            out.append(rng.choice(["", "# a comment", "  # another"]))
    return out


def scalar(rng):
    return rng.choice(["plain words", "42", "-7", "0", "3.25", "yes", "off", "null", "~", "2026-01-31", '"quoted: x"', "'single # x'", "a-b", "x:y", "http://h/p", "é", "v1.2.3"])


ODD = [
    "a: {b: 1}", "a: &x 1\nb: *x", "a: 012", "a: 1:30", "a: 1e3", "a:\n  - - 1", "a: |-\n  x", "a: |\n  x\n\n  y\nb: 1", "a: >\n  x\n   y", "a: 'it''s'",
    'a: "b\\n"', "a: b\n  c", "a: 1\na: 2", "- a\n- b", "just text", "a: [1, {b: 2}]", "? a\n: b", "a: !!str 1", "a:\n    b: 1\n  c: 2", "a: b: c", "a: |\nb: 1",
    "a:\n- b\n- c\nd: 1", "a:\n  - b: 1\n    c:\n      - d\n  - e", "'a': 1", "a: # note\n  b: 1", "a: x # note", "a: 'x' # note", "<<: 1", "a: =", "a: [b, c", "a: -", "-: 1", "a:\n  -\n  - x",
    "a: 123456789012345678901", "a: .5", "a: []", "a: [ ]", "a: [x,, y]", "a: [yes, 1.5]", "a: @x", "a: 5 apples", "a: - b", "a: |\n\n  x", "a: |\n   x\n  y", "a: trailing  ", "---\na: 1",
]


def test_values_agree_with_yaml(spark):
    rng = random.Random(2)
    blocks = ["\n" + "\n".join(written(rng)) for _ in range(500)] + ["\n" + b for b in ODD]
    docs = spark.createDataFrame(list(enumerate(blocks)), "i int, block string")
    got = {r.i: r.v for r in docs.select("i", F.to_json(nested.value(F.col("block"))).alias("v")).collect()}
    read = 0
    for i, block in enumerate(blocks):
        if got[i] is not None:
            read += i < 500
            assert json.loads(got[i]) == expected(block), block
    assert read > 400  # of 500; the rest is left to the library


def test_blocks_that_are_left_are_read_by_the_library(spark):
    rng = random.Random(3)
    blocks = ["\n" + "\n".join(written(rng)) for _ in range(60)] + ["\n" + b for b in ODD]
    docs = spark.createDataFrame([(f"{i}.md", f"---{b}\n---\nbody") for i, b in enumerate(blocks)] + [("none.md", "x")], "path string, text string")
    values = P.frontmatter_values(docs)
    got = {r.path: (json.loads(r.v), r.by_yaml) for r in values.select("path", F.to_json("value").alias("v"), "by_yaml").collect()}
    for i, block in enumerate(blocks):
        # the fence ends at the first line that begins with dashes
        want = expected(block.split("\n---")[0])
        assert got.get(f"{i}.md", (None,))[0] == want, block
    share = P.yaml_share(values).first()
    assert share.n_blocks == len(got) and 0 < share.n_by_yaml == sum(y for _, y in got.values()) < 0.5 * share.n_blocks
