"""The registered queries on the smallest tables, and the pipeline against a plain version."""

import random
import re

import duckdb
import pytest
from compare import TABLES, _rows

import corpus_pipeline
from mdlake.llm import sentencepieces
from mdlake.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROWS = {"op1_warc": "pages", "op6_urls": "pages"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        rel = con.execute(ORACLE[name])
        assert _rows(df.columns, got) == _rows([d[0] for d in rel.description], rel.fetchall())
    else:
        assert len(got) == spark.read.parquet(f"{SF_DIR}/{ROWS.get(name, 'documents')}.parquet").count()


def plain_kept(rows):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            n = len(sets[i] & sets[j])
            if j < i and n and 100 * n >= 75 * len(sets[i] | sets[j]) and part[i] != part[j]:
                a, b = sorted((part[i], part[j]))
                part = {k: a if p == b else p for k, p in part.items()}
    return {i for i, p in part.items() if i == p}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = random.Random(12)
    words, bad = [f"w{i}" for i in range(400)], ["grok", "blarg", "snerd"]
    passage = "one two three four five six seven eight nine ten eleven twelve"
    texts, toxic = [], []
    for i in range(420):
        own = rng.choices(words, k=rng.randint(30, 60))
        if i % 6 == 0:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(bad)
        if i % 10 == 1:
            own[10:10] = passage.split()
        if i % 15 == 2:
            own[5:5] = [f"mail{i}@host{i}.example.com"]
        texts.append(" ".join(own))
        toxic.append(int(i % 6 == 0))
    texts += [texts[1], texts[1].replace("w", "W"), None, "", texts[2] + " more", texts[3] + " w1"]
    toxic += [0] * 6
    docs = [(i, x, "en", "src", None if x is None else len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    clean = [(i, x) for (i, x, *_), t in zip(docs, toxic) if not t]
    kept = plain_kept(clean)
    want = {}
    for i, x in clean:
        if i in kept:
            x = re.sub(re.escape(passage), "", x or "")
            want[i] = re.sub(r"mail\d+@host\d+\.example\.com", "[EMAIL]", x)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    back = sentencepieces.decoder(sentencepieces.Vocabulary.load())
    assert {r.doc_id: back(r.ids) if r.ids else "" for r in got} == want
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
