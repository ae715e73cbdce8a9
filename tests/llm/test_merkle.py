"""Merkle manifests against a plain tree."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mdlake.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, k):
    """(before, after) per level."""
    out = []
    for level in tree[:-1]:
        first = k - k % 16
        out.append((level[first:k], level[k + 1 : first + 16]))
        k //= 16
    return out


def plain(rows):
    """rows (doc_id, text, source, lang, n_chars) to the expected rows."""
    by = {}
    for i, text, source, lang, n in rows:
        leaf = leaf_of(i, source, lang, n, text)
        bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        lowered = text if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        by.setdefault(source, []).append((i, leaf, leaf_of(i, source, lang, n, lowered) if bad else leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: levels([r[1] for r in by[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for k, (i, leaf, now) in enumerate(by[s]):
            steps = path(trees[s], k) + path(top, place)
            proof = h(*(x for a, b in steps for x in a + b))
            for a, b in steps:
                now = h(*a, now, *b)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "plain words", "Some Words", "ÀÉ only", "x" * 3000 + "Y"])
            rows.append((rng.randrange(10**9), text, source, rng.choice(["en", None]), rng.choice([None, 7, -2])))
    rng.shuffle(rows)
    return rows


COLUMNS = "doc_id bigint, text string, source string, lang string, n_chars bigint"


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16, "b": 17, "c": 1, None: 3, "": 2, "é": 33, "Z": 15},
    {"big": 4200, **{f"s{k}": 1 + k % 5 for k in range(40)}},
])
def test_against_a_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS i", "'x' AS tree").repartition(6)
    got = merkle.verified(merkle.tampered(docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_several_tiers(spark):
    rows = rows_of({"big": 1000, "b": 16, "c": 300, "d": 1})
    got = merkle.verified(merkle.tampered(spark.createDataFrame(rows, COLUMNS)), tier=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    rows = [(None, "A", "s", None, None)] * 3 + [(5, "A", "s", "en", 1)] * 40 + [(5, "B", "s", "en", 1), (None, None, None, None, None)]
    got = merkle.verified(merkle.tampered(spark.createDataFrame(rows, COLUMNS)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert merkle.verified(merkle.tampered(spark.createDataFrame([], COLUMNS))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_positions_are_those_of_a_postorder_walk(n):
    tree, log = levels([str(k) for k in range(n)]), []

    def walk(level, i):
        if level:
            for child in range(16 * i, min(16 * i + 16, len(tree[level - 1]))):
                walk(level - 1, child)
        log.append((level, i))

    walk(len(tree) - 1, 0)
    assert merkle.height(n) == len(tree) - 1
    place = {node: k for k, node in enumerate(log)}
    for level, nodes in enumerate(tree):
        assert merkle.position(level, np.arange(len(nodes)), n).tolist() == [place[level, i] for i in range(len(nodes))]
