"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mdlake.llm import spelling


def plain_words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if is_near(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abeiorstéÉ", k=rng.randint(4, 9))) for _ in range(60)] + ["banana", "bananas", "ananab"]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 4, 9, 40])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(w))
            c = rng.choice("abeioé")
            words += [rng.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :]])] * rng.choice([1, 3, 3, 5])
    long = "ab" * 3000
    words += [long] * 4 + [long[:-1]] * 3 + [long + "ÿ"] * 9
    words = [rng.choice([w, w, w.upper() if w.isascii() else w]) for w in words]
    rng.shuffle(words)
    cuts = sorted(rng.sample(range(len(words)), 30))
    rows = [(i, rng.choice([" ", "-", "1", "×"])[:1].join(words[a:b]) if i % 4 else " ".join(words[a:b])) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(words)]))]
    return rows + [(3, None), (None, rows[2][1]), (4, ""), (5, "ab cd"), rows[5], rows[5]]


@pytest.mark.parametrize("seed,cell", [(1, 4096), (2, 16), (3, 4)])
def test_against_all_pairs(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, x, "w") for i, x in rows], "doc_id bigint, text string, word string")
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == plain(rows)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_close_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    data, asking = rng.integers(0, 3, (500, spelling.LETTERS)) * (rng.random((500, spelling.LETTERS)) < 0.06), None
    asking = np.concatenate([data[:200], np.maximum(data[200:400] - np.eye(spelling.LETTERS, dtype=np.int64)[rng.integers(0, spelling.LETTERS, 200)], 0)])
    apart = data[:, None] - asking[None]
    for more in (0, 1):
        want = ((np.maximum(apart, 0).sum(2) == 1) & (np.maximum(-apart, 0).sum(2) == 1 - more))
        got = spelling.close(data, asking, more)
        got = {(d, a) for d, a in zip(*(x.tolist() for x in got)) if apart[d, a].sum() == more}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(want))))
