"""Repeated passages against plain windows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdlake.llm import substrings
from mdlake.llm.words import BY_SPACE_CASED, hash_words

W = substrings.WINDOW


def plain(rows):
    """(n_words, kept words) per id, for distinct ids."""
    words = {i: re.findall("[^\x20\x09-\x0d]+", x or "") for i, x in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - W + 1):
            first.setdefault(tuple(words[i][k : k + W]), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - W + 1):
            if first[tuple(w[k : k + W])] != (i, k):
                gone.update(range(k, k + W))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [rng.choices(words, k=n) for n in (19, 20, 21, 35, 80)]
    out = []
    for _ in range(60):
        own = rng.choices(words, k=rng.choice([0, 5, 19, 20, 21, 60, 150]))
        for p in rng.sample(passages, rng.choice([0, 1, 2])):
            at = rng.randint(0, len(own))
            own[at:at] = p
        out.append(rng.choice([" ", "\n", "\t "]).join(own))
    out += [out[7], out[7] + " x", "A " + out[8], out[9].upper(), "", None, "  ", "a " * 45, "b " + "a " * 30 + "c", "a b " * 40, "x " + "a b " * 30, "a b c " * 33, "é ü " * 30, "z" * 40_000]
    out += ["y " * 5000 + " ".join(passages[4])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_windows(spark, seed):
    rows = list(enumerate(texts(seed), start=-3))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, x, "k", 1) for i, x in rows], "doc_id bigint, text string, n_words string, _spans int")
    got = substrings.without_repeats(docs.repartition(5))
    assert got.columns == [*docs.columns, "_n_words", "n_removed", "kept_text"]
    assert {r.doc_id: (r._n_words, r.n_removed, r.kept_text) for r in got.collect()} == plain(rows)


def test_rows_without_an_id_and_rows_of_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(None, a), (None, a), (5, a), (5, a), (5, "c " + a), (2, b), (5, b), (9, b)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    # in the third row of document 5 its windows start one word later than in the others
    want = [(None, 0), (None, 0), (2, 0), (5, 0), (5, 0), (5, 30), (5, 30), (9, 30)]
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert substrings.without_repeats(docs).count() == 0


def test_windows_are_parsed_alike_wherever_they_stand():
    rng = random.Random(4)
    window = " ".join(rng.choices([f"w{i}" for i in range(9)], k=W))
    found = set()
    for _ in range(50):
        before, after = (" ".join(rng.choices([f"w{i}" for i in range(9)], k=rng.randint(0, 30))) for _ in "ab")
        text = f"{before} {window} {after}".strip()
        hashes, counts = hash_words(__import__("pyarrow").array([text]), BY_SPACE_CASED)
        key, at, n = substrings.keys(hashes, counts)
        where = len(before.split())
        found.add(int(key[np.flatnonzero((at <= where) & (where < at + n))[0]]))
    assert len(found) == 1


def test_keys_leave_few_unique_windows(spark):
    """On whole documents, nearly all windows that go on to verification are repeated ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    import pyarrow as pa

    hashes, counts = hash_words(pa.array(docs["text"]), BY_SPACE_CASED)
    key, at, n = substrings.keys(hashes, counts)
    assert n.sum() == len(substrings.windows(counts))
    assert len(key) < 0.35 * len(hashes)
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = substrings.windows(counts)
    grams = substrings.hash_runs(hashes, starts, starts + W)
    _, place_of, times_of = np.unique(grams, return_inverse=True, return_counts=True)
    candidates, repeated = n[times[place] > 1].sum(), (times_of[place_of] > 1).sum()
    assert repeated <= candidates < 1.3 * repeated
