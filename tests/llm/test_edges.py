"""Cases at the edge: repeated items, clashing names, ties, and the fit of the ordinal model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdlake.llm import decontaminate, toxicity, urls


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_texts_of_one_item_are_one_item(spark, block_bytes):
    docs = spark.createDataFrame([(1, "x a b c y d e f", ["own", "two"])], "doc_id bigint, text string, hits array<string>")
    items = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (None, "y"), (2, "q")], "item_id bigint, text string")
    got = decontaminate.report(decontaminate.mark(docs, items, block_bytes=block_bytes)).first()
    want = spark.range(1).select(F.sha2(F.lit("1"), 256)).first()[0]
    assert (got.n_words, got.n_hit, got.n_items, got.items_sha256, got.contaminated) == (8, 7, 1, want, True)


def test_urls_with_clashing_columns_and_tied_rules(spark):
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("allow", "b.org", "")]
    pages = spark.createDataFrame([(1, "http://a.com/x/1", "r", 7), (2, "http://b.org/", "r", 8), (3, None, "r", 9)], "page_id bigint, url string, _ruled string, _tenth int")
    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "allow", "allow"]  # of equally long rules the first
    assert [(got[i]._ruled, got[i]._tenth) for i in (1, 2, 3)] == [("r", 7), ("r", 8), ("r", 9)]


def plain_loss(w, b, x, grades, penalty):
    upper = np.vstack([1 / (1 + np.exp(-(b[:, None] - x @ w))), np.ones(len(x))])
    lower = np.vstack([np.zeros(len(x)), upper[:-1]])
    p = (upper - lower)[grades, np.arange(len(x))]
    return -np.log(np.maximum(p, 1e-12)).mean() + penalty * np.abs(w).sum()


def test_ordinal_fit_against_plain_descent():
    """No small change of a weight or cut lowers the penalised loss of the fitted model."""
    rng = np.random.default_rng(7)
    x = rng.poisson(0.5, (400, 6)).astype(float)
    hidden = np.array([1.5, -1.0, 0.8, 0.0, 0.0, 0.0])
    grades = np.digitize(x @ hidden + rng.logistic(size=400), [0.5, 1.5, 3.0])
    rows, slots = np.nonzero(x)
    penalty = 0.01
    model = toxicity.fit_ordinal(rows, slots, x[rows, slots], grades, penalty, steps=3000)
    w, b = model.weights[:6].astype(float), model.cuts.copy()
    best = plain_loss(w, b, x, grades, penalty)
    for step in (0.02, 0.1):
        for k in range(6):
            for sign in (-1, 1):
                assert plain_loss(w + sign * step * np.eye(6)[k], b, x, grades, penalty) > best - 2e-4
        for k in range(len(b)):
            for sign in (-1, 1):
                assert plain_loss(w, np.maximum.accumulate(b + sign * step * np.eye(len(b))[k]), x, grades, penalty) > best - 2e-4
    assert w[0] > 0.5 and w[1] < -0.3 and np.abs(w[3:]).max() < 0.2


def test_the_limit_is_the_best_allowed_one():
    p = np.array([0.9, 0.8, 0.3, 0.02, *np.linspace(0, 0.29, 100), 0.5])
    toxic = np.array([1, 1, 1, 1, *[0] * 101])
    limit, recall, clean = toxicity.best_limit(p, toxic)
    # at 0.3 three of four are found and one of 101 clean rows is lost; at 0.02 all, but most clean rows are lost
    assert 0.29 < limit < 0.3 and recall == 0.75 and clean == 100 / 101
    assert toxicity.best_limit(p, toxic * 0)[0] == 0.5 and toxicity.best_limit(np.zeros(0), np.zeros(0))[0] == 0.5
    assert toxicity.best_limit(np.array([0.1, 0.6, 0.7]), np.array([1, 0, 0])) == (0.5, 0.0, 0.0)


def test_the_sample_is_bounded_in_rows_and_words(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(5, f"same {i}") for i in range(50)] + [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in [5, *range(10, 60)]], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_sample", lambda rows, slots, counts, toxic: seen.append((len(toxic), len(rows))))
    for sample, words in ((1000, 10**6), (7, 10**6), (1000, 100), (1000, 1)):
        toxicity.fit(docs, labels, sample=sample, words=words)
    assert seen[0][0] == 51 and seen[1][0] == 7  # one row of the repeated id
    assert 1 <= seen[2][0] < 7 and seen[2][1] <= 100 and seen[3] == (0, 0)
