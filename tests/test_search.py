"""Best-of search that reads few blocks, and fuzzy expansion by shared keys."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from mdlake.operators import search


def documents(spark, rng, n, words):
    rows = []
    for i in range(n):
        body = " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))
        rows.append((f"d{i:05}.md", " ".join(rng.choices(words, k=2)), rng.choice(words), [rng.choice(words)], body))
    return spark.createDataFrame(rows, "id string, title string, category string, tags array<string>, body string")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeo", k=rng.randint(2, 8))) for _ in range(400)]
    return words, documents(spark, rng, 3000, words)


@pytest.fixture(scope="module")
def index(corpus):
    before, search.PART = search.PART, 16
    yield search.build_index(corpus[1])
    search.PART = before


def plain(rows):
    return [(r.doc, round(r.score, 6)) for r in rows]


def test_the_best_are_those_of_exhaustive_scoring(index, corpus):
    words = corpus[0]
    for query in (words[0], f"{words[1]} {words[250]} {words[42]}", words[5][:2], "nothing"):
        for n in (10,):
            for prefix, fuzzy in ((False, False), (True, True)):
                got = search.best(index, query, n, prefix, fuzzy)
                want = search.top(search.search(index, query, prefix, fuzzy), n)
                assert plain(got.hits.collect()) == plain(want.collect())
                assert got.read <= got.postings


def test_few_postings_are_read(index, corpus):
    got = search.best(index, corpus[0][0], 10, prefix=False, fuzzy=False)
    assert got.postings > 2000 and got.read < 0.3 * got.postings
    got = search.best(index, f"{corpus[0][3]} {corpus[0][200]}", 10, prefix=False, fuzzy=False)
    assert got.read < 0.5 * got.postings


def test_more_terms_and_parts_than_are_listed(index, corpus, monkeypatch):
    query = f"{corpus[0][1]} {corpus[0][7]}"
    want = plain(search.top(search.search(index, query), 10).collect())
    monkeypatch.setattr(search, "LISTED", 2)
    got = search.best(index, query, 10)
    assert plain(got.hits.collect()) == want and got.read <= got.postings


def test_ties_go_by_path_across_parts(spark):
    rows = [(f"{i:03}.md", "same title", "c", ["t"], "same body") for i in range(200)]
    docs = spark.createDataFrame(rows, "id string, title string, category string, tags array<string>, body string")
    got = search.best(search.build_index(docs), "same", 7)
    assert [r.doc for r in got.hits.collect()] == [f"{i:03}.md" for i in range(7)]


def test_only_buckets_of_the_terms_are_read(index, corpus, capsys):
    search.search(index, corpus[0][0]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "PushedFilters: [" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert "levenshtein" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_expansion_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    terms = {"".join(rng.choices("abc", k=rng.randint(1, 10))) for _ in range(400)}
    for _ in range(120):
        long = "".join(rng.choices("abcdefgh", k=rng.randint(9, 30)))
        for _ in range(4):
            w = list(long)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            terms.add("".join(w))
    rows = [(t, "body", 1) for t in sorted(terms)]
    vocabulary = spark.createDataFrame(rows, "term string, field string, df bigint")
    keys = search.neighbours(vocabulary).withColumn("bucket", F.pmod("key", F.lit(3)).cast("int")).persist()
    near = SimpleNamespace(vocabulary=vocabulary, neighbours=keys, key_buckets=3)
    asked = rng.sample(sorted(terms), 40) + ["".join(rng.choices("abc", k=k)) for k in range(1, 13)]
    for word in asked:
        got = {r.term for r in search.expand(near, word, fuzzy=True).collect()}
        reach = int(search.FUZZY_SHARE * len(word) + 0.5)
        far = vocabulary.where((F.levenshtein("term", F.lit(word)) <= reach) | (F.col("term") == word))
        assert got == {r.term for r in far.collect()}, word


def test_an_index_of_known_queries_scores_alike(index, corpus):
    words = corpus[0]
    queries = (f"{words[1]} {words[250]} {words[42]}", words[5][:2], f"{words[9]}x {words[30][1:]}", "prerequisit", "")
    own = search.build_index(corpus[1], queries)
    assert own.stats == index.stats
    assert own.vocabulary.count() < index.vocabulary.count()
    for query in queries:
        for prefix, fuzzy in ((False, False), (True, False), (False, True), (True, True)):
            assert plain(search.top(search.search(own, query, prefix, fuzzy), 3000).collect()) == plain(search.top(search.search(index, query, prefix, fuzzy), 3000).collect())
    assert plain(search.best(own, queries[0], 10).hits.collect()) == plain(search.best(index, queries[0], 10).hits.collect())
    with pytest.raises(ValueError):
        search.search(own, "another")
    with pytest.raises(ValueError):
        search.save_index(own, "/nowhere")


def test_terms_for_known_words_are_all_kept(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=k)) for k in range(1, 16)]
    terms = {"".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(500)}
    for word in words:
        for _ in range(20):
            w = list(word)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            terms.add("".join(w) or "z")
    table = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    for word in words:
        got = {r.term for r in table.where(search._can_match(F.col("term"), frozenset([word]))).collect()}
        assert got == {r.term for r in table.where(search._weight(F.col("term"), word, True, True) > 0).collect()}, word


ODD = [
    "", " ", "...", "widget", "a widget, widgets; WIDGET-widget_widgetry", "\U0001d400\U0001d41bwidget \U0001d400widgit \U0001d7d9", "İwidget İstanbul widgİt",
    "⚠️ widgt \U0001f532 idget\n\nwidgget\r\n\twidge", "x" * 5000 + "widget" + "y" * 5000 + " wi dg", "²widget① ١widget éwidget", "prerequisite prerequisit prrequist prefix",
    "\u212aelvin kelvin KELVIN ΟΔΟΣ οδος ΟΔΟΣ'Α Ⓐwidget ⅧWIDGT WiDgEt \u2126mega",
]


@pytest.mark.parametrize("prefix, fuzzy", [(False, False), (True, False), (False, True), (True, True)])
def test_terms_of_known_words_are_cut_out_and_the_rest_is_counted(spark, prefix, fuzzy):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("widgetWI İéΣσΑ'.\U0001d400", k=300)) for _ in range(40)]
    rows = [(f"{i}.md", t, t, [t, "t"], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id string, title string, category string, tags array<string>, body string")
    words = frozenset(["widget", "prerequisit", "wi", "١widget", "kelvin", "οδος", "οδοσ", "ωmega"])
    got = {(r.doc, r.field): (r.field_len, {(p.term, p.tf) for p in r.found}) for r in search.counted_terms(docs, words, prefix, fuzzy).collect()}
    weight = F.coalesce(*[search._weight(F.col("p.term"), w, prefix, fuzzy) for w in sorted(words)])
    whole = search.counted_terms(docs)
    want = {(r.doc, r.field): (r.field_len, set()) for r in whole.collect()}
    for r in whole.select("doc", "field", F.explode("found").alias("p")).where(weight > 0).collect():
        want[r.doc, r.field][1].add((r.p.term, r.p.tf))
    assert got == want and sum(len(found) for _, found in want.values()) > 20


def test_an_index_holds_the_kinds_of_match_it_serves(index, corpus):
    word = corpus[0][3]
    for prefix, fuzzy in ((False, False), (True, False), (False, True)):
        own = search.build_index(corpus[1], (word,), prefix, fuzzy)
        got, want = (search.search(i, word, prefix, fuzzy) for i in (own, index))
        assert plain(search.top(got, 3000).collect()) == plain(search.top(want, 3000).collect())
        with pytest.raises(ValueError):
            search.search(own, word)
