"""Operators on single texts against plain readings of their definitions."""

import hashlib
import itertools
import random
import re
from array import array

import pytest

from mdlake.llm import decontaminate, lm, pii, secrets, sentencepieces, toxicity
from mdlake.llm.words import BY_LETTER, BY_SPACE, hash_words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, texts):
    return spark.createDataFrame([(i, x, "en", None, None if x is None else len(x)) for i, x in enumerate(texts)], DOCS)


def odd_texts(alphabet, n, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 7, 60, 400]))) for _ in range(n)]
    return [*made, None, "", " \n", made[2], made[2], "x" * 200_000 + " y"]


@pytest.mark.parametrize("values,pattern", [(BY_SPACE, "[^\x20\x09-\x0d]+"), (BY_LETTER, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")])
def test_word_hashes(values, pattern):
    import pyarrow as pa

    texts = odd_texts(["a", "B", "é", "9", " ", "\n", "-", "語"], 200)
    hashes, counts = hash_words(pa.array(texts, pa.string()), values)
    words = [re.findall(pattern, lower(x)) for x in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def plain_pii(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", m.start(), m.end()))
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_patterns_match_their_definitions():
    pieces = ["a", "@", ".", "-", "7", "1", "25", "+", " ", "(", ")", "é", "a.b@c-d.e", "1.2.3.4", "4539578763621486", "+1 (555) 010-9999", "%"]
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.base_hits(text) == plain_pii(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" * 150_000, "a@" * 150_000, "token " + " " * 300_000):
        pii.base_hits(text)
        secrets.base_hits(text)


def test_texts_with_many_hits():
    text = " ".join(f"a{i}@b.example.com word{i} token: abcdefgh{i}" for i in range(40_000))
    hits = pii.base_hits(text)
    assert len(hits) == 40_000 and len(pii._terms(text, hits)) > 40_000
    assert len(secrets._long_tokens(text + " " + "q" * 30, secrets.base_hits(text)[0])) == 1


def test_pii_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    fill = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(fill, k=30)) for _ in range(60)]
    texts[5] = texts[17] = texts[40] = "the mayor Zebulon wrote z@hall.example.com about word1"
    docs = documents(spark, [*texts, None, ""]).withColumnRenamed("source", "_spans")
    found = pii.find_pii(docs, ["doc_id", "_spans"]).toPandas().set_index("doc_id")["pii"]
    words = lambda i, kind: {texts[i][s["start"] : s["end"]] for s in found[i] if s["kind"] == kind}
    for i in (5, 17, 40):
        assert words(i, "email") == {"z@hall.example.com"}
        assert "Zebulon" in words(i, "term") and "word1" not in words(i, "term") | words(i, "class")
    assert not len(found[0]) and not len(found[60]) and not len(found[61])
    clean = pii.sanitise(docs).toPandas().set_index("doc_id")["text"]
    assert "Zebulon" not in clean[5] and "@" not in clean[5] and "word1" in clean[5]
    assert clean[0] == texts[0] and clean[60] is None and clean[61] == ""


@pytest.mark.parametrize("copies", [1, 2])
def test_pii_terms_of_entities_in_few_documents(spark, copies):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"word{i}" for i in range(40)], k=30)) for _ in range(200)]
    for i in range(copies):
        texts[7 + i] = f"the mayor Zebulon wrote z@hall.example.com about word1 word{i}"
    found = pii.find_pii(documents(spark, texts), ["doc_id"]).toPandas().set_index("doc_id")["pii"]
    for i in range(copies):
        told = {texts[7 + i][s["start"] : s["end"]] for s in found[7 + i] if s["kind"] in ("term", "class")}
        assert told == {"the", "mayor", "Zebulon", "wrote", "about"}  # words of no other document
    assert not any(len(x) for i, x in found.items() if not 7 <= i < 7 + copies)


@pytest.mark.parametrize("keep", [["doc_id"], ["doc_id", "text"]])
def test_pii_terms_far_from_their_entity(spark, keep):
    rng = random.Random(5)
    fill = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(fill, k=30)) for _ in range(200)]
    gap = " ".join(rng.choices(fill, k=30))
    texts[3] = f"the mayor Zebulon wrote z@hall.example.com {gap} Zebulon said {gap} zebulon"
    texts[9] = f"z@hall.example.com {gap} and Zebulon again"  # the pair stands together in another document only
    found = pii.find_pii(documents(spark, texts), keep).toPandas().set_index("doc_id")["pii"]
    told = lambda i: [texts[i][s["start"] : s["end"]] for s in found[i] if s["kind"] == "term"]
    assert [w for w in told(3) if w.lower() == "zebulon"] == ["Zebulon", "Zebulon", "zebulon"]
    assert told(9) == ["Zebulon"]
    clean = pii.sanitise(documents(spark, texts)).toPandas().set_index("doc_id")["text"]
    assert "zebulon" not in clean[3].lower() + clean[9].lower()


def test_sanitised_overlaps():
    assert pii.sanitised("ab cd ef", [("ip", 0, 5), ("card", 3, 8)]) == "[IP]"
    assert pii.sanitised("12 Bob x", [("class", 0, 2), ("class", 3, 6), ("class", 7, 8)]) == "[NUMBER] [NAME] [WORD]"


def test_toxicity_learns_from_all_but_near_copies():
    import numpy as np

    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(np.arange(1000, 60_000), 40, replace=False)) for _ in range(100)]
    for own in sets[:50]:
        own[0] = 7  # a word that many texts share makes no copies of them
    toxic = np.zeros(104, np.int64)
    toxic[[20, 103]] = 1
    sets += [sets[3], sets[4].copy(), np.zeros(0, np.int64), sets[5]]
    sets[101][-2:] = [100_000, 100_001]
    rows = np.repeat(np.arange(104), [len(x) for x in sets])
    first = toxicity._one_per_family(rows, np.concatenate(sets), toxic)
    assert np.flatnonzero(~first).tolist() == [100, 101]  # copies; not a copy with another label


def plain_secrets(text):
    found = []
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found += [("assign", m.start(), m.end()) for m in re.finditer(rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_patterns_match_their_definitions():
    pieces = ["toKen", "api_key", "APIKEY", "ſecret", "secret", " ", ":", "=", '"', "abcd1234", "0" * 31, "f", "AKIA", "ABCDEF1234567", "é", "x"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert secrets.base_hits(text)[0] == plain_secrets(text), text


def test_random_strings_are_told_from_identifiers(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [f'key token = "{some(32)}" for the readable_identifier_of_things; read_able file_name of_things parameter_of name_things config' for _ in range(200)]
    hidden = [some(30) for _ in range(40)]
    texts += [f"the value {h} of configuration_parameter_names" for h in hidden]
    found = secrets.find_secrets(documents(spark, [*texts, None, ""]), ["doc_id", "source"]).toPandas().set_index("doc_id")["secrets"]
    caught = [[texts[i][s["start"] : s["end"]] for s in found[i] if s["kind"] == "random"] for i in range(240)]
    assert sum(c == [h] for c, h in zip(caught[200:], hidden)) >= 36
    assert not any("readable" in w or "configuration" in w for c in caught for w in c)
    assert not len(found[240]) and not len(found[241])


def ids_of(encoder, texts):
    return [array("i", b).tolist() for b in encoder.batch(texts)]


def test_sentencepieces_against_the_public_library():
    sp = pytest.importorskip("sentencepiece")
    vocabulary = sentencepieces.Vocabulary.load()
    texts = odd_texts(["the", "a", " ", "  ", "é", "語", "\n", "ing", "Z", "7", "▁", "🙂"], 150) + ["Hello world, this is text.", " lead", "trail  "]
    got = ids_of(sentencepieces.Encoder(vocabulary), texts)
    back = sentencepieces.decoder(vocabulary)
    assert [back(i) if i else "" for i in got] == [(x or "").replace("▁", " ") for x in texts]
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(sentencepieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1  # search by scores in place of merges
    public = sp.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = ["".join(random.Random(i).choices(["the", "a", " b", "ing", "Z", "7", "hello", " of", "."], k=8)) for i in range(80)]
    score = {i: s for i, s in vocabulary.scores.values()}
    for x, ids in zip(words, ids_of(sentencepieces.Encoder(vocabulary), words)):
        best = public.nbest_encode_as_ids(x, 2)[0]
        assert sum(map(score.get, ids)) == sum(map(score.get, best)), x


def test_sentencepieces_find_a_best_segmentation():
    v = sentencepieces.Vocabulary({"▁": (0, -5.0), "a": (1, -3.0), "b": (2, -3.0), "ab": (3, -5.5), "▁a": (4, -4.0), "bab": (5, -7.0)}, ["▁", "a", "b", "ab", "▁a", "bab"], [0] * 256, -17.0, 3)

    def best(word):
        if not word:
            return 0.0
        return max(([s + best(word[len(p) :]) for p, (_, s) in v.scores.items() if word.startswith(p)]), default=v.unknown + best(word[1:]))

    words = {"▁" + "".join(w) for n in range(7) for w in itertools.product("ab", repeat=n)}
    encoder = sentencepieces.Encoder(v)
    encoder.encode(words)
    score = {i: s for i, s in v.scores.values()}
    for w in words:
        assert sum(score[i] for i in array("i", encoder.known[w])) == best(w)


def test_encode_and_decode_columns(spark):
    docs = documents(spark, ["a b", None, "", "a b"]).withColumnRenamed("source", "ids")
    out = sentencepieces.decode(sentencepieces.encode(docs, ["doc_id", "ids", "text"]), "_ids").toPandas()
    assert out["decoded"].tolist() == ["a b", "", "", "a b"] and list(out.columns) == ["doc_id", "ids", "text", "_ids", "decoded"]
    assert sentencepieces.encode(docs.limit(0), ["doc_id"]).count() == 0
    assert {r.round_trip for r in sentencepieces.encode(docs, ["doc_id"], verify=True).collect()} == {True}


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(3)
    plain, bad = [f"w{i}" for i in range(300)], ["grok", "blarg", "snerd"]
    texts, hits = [], []
    for i in range(1200):
        words = rng.choices(plain, k=rng.randint(20, 60))
        hits.append(rng.randint(1, 6) if i % 6 == 0 else 0)
        for _ in range(hits[-1]):
            words[rng.randrange(len(words))] = rng.choice(bad)
        hits[-1] = sum(w in bad for w in words)
        texts.append(" ".join(words))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, int(h > 0)) for i, h in enumerate(hits[:800])] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.withColumnRenamed("source", "grade"), model).toPandas().set_index("doc_id")
    held = range(800, 1200)
    wrong = [i for i in held if (scored["p_toxic"][i] >= model.limit) != (hits[i] > 0)]
    assert len(wrong) <= 4
    by_hits = scored.loc[list(held)].assign(h=[hits[i] for i in held]).groupby("h")["severity"].mean()
    assert by_hits[0] < 0.2 < by_hits[2] < by_hits[5] <= 3
    assert scored["p_toxic"][1200] == scored["p_toxic"][1201] < 0.5
    assert {"grade", "_grade"} <= set(scored.columns)


def test_toxicity_without_labels_or_documents(spark):
    docs = documents(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 2
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def plain_marks(docs, items):
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(x))
    out = []
    for text in docs:
        w, hit, named = words(text), set(), set()
        for i, item in items:
            v = words(item)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit.update(range(p, p + n))
                        named.add(str(i))
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_decontamination_against_a_plain_search(spark, block_bytes):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["a", "B", "c-c", "dé", "e1", "語"]) for _ in range(n))
    items = [(i * 7, text(n)) for i, n in enumerate([0, 9, 10, 11, 25, 4])] + [(99, None), (14, text(10))]
    docs = [text(rng.choice([0, 3, 12, 90])) for _ in range(20)] + [None, ""]
    docs += [f"x {items[4][1]} y {items[1][1]}", items[3][1] + " a " + items[3][1], docs[5]]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = documents(spark, docs).withColumnRenamed("source", "hits")
    marked = decontaminate.mark(frame, benchmark, block_bytes=block_bytes)
    assert "_hits" in marked.columns
    marked = decontaminate.mark(documents(spark, docs), benchmark, block_bytes=block_bytes)
    got = decontaminate.report(marked).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain_marks(docs, items)
    clean = {r.doc_id: r.text for r in decontaminate.cleaned(documents(spark, docs), benchmark).collect()}
    assert clean[20] is None and clean[22].split() == ["x", "y"]
    assert decontaminate.mark(documents(spark, docs).limit(0), benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.report(decontaminate.mark(documents(spark, docs), benchmark.limit(0))).collect()} == {0}


def test_language_model_against_a_plain_count(spark):
    import zlib
    from collections import Counter
    from math import log, log10

    import numpy as np

    rng = random.Random(7)
    texts = [" ".join(rng.choices(["The", "the", "a", "é", "b\tb", "c"], k=rng.choice([0, 1, 5, 30]))) for _ in range(80)] + [None, ""]
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", lower(x)), None] for x in texts]
    tenth = [zlib.crc32(str(i).encode()) % 10 for i in range(len(texts))]
    count = Counter(t for ts, d in zip(tokens, tenth) if d for t in ts)
    pair = Counter(p for ts, d in zip(tokens, tenth) if d for p in zip([None, *ts], ts))
    n, v = sum(count.values()), len(count)
    rows = {r.doc_id: r for r in lm.lm_scores(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, ts in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (tenth[i] == 0, len(ts), sum(t in count for t in ts), n)
        assert r.base_score == pytest.approx(sum(log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    # weights from the tenth with remainder 1, with ratios of the other training documents
    fit = [d > 1 for d in tenth]
    count_f = Counter(t for ts, f in zip(tokens, fit) if f for t in ts)
    pair_f = Counter(p for ts, f in zip(tokens, fit) if f for p in zip([None, *ts], ts))
    n_f, u = sum(count_f.values()), 1 / (len(count_f) + 1)
    step = lambda x: round(log(x / u) * lm.BINS) if x else -(10**7)
    held = Counter(
        (count_f[h].bit_length(), step(pair_f[h, w] / max(count_f[h], 1)), step(count_f[w] / n_f))
        for ts, d in zip(tokens, tenth) if d == 1 for h, w in zip([None, *ts], ts)
    )
    weights = lm.learn_weights(np.array([[*cell, c] for cell, c in sorted(held.items())]))
    for i, ts in enumerate(tokens):
        own = sum(log10(plain_probability(pair[p], count[p[0]], count[p[1]], n, v, weights)) for p in zip([None, *ts], ts))
        assert rows[i].score == pytest.approx(own)


def plain_probability(pair, context, word, n, v, weights):
    a, b, c = weights[context.bit_length()]
    return a * pair / max(context, 1) + b * word / n + c / (v + 1)


def test_weights_follow_the_held_out_counts():
    import numpy as np

    bins = lambda x: round(np.log(x) * lm.BINS)
    cells = np.array([[5, bins(500), bins(10), 900], [5, -(10**7), bins(10), 100], [2, -(10**7), bins(10), 50], [0, -(10**7), bins(10), 10]])
    w = lm.learn_weights(cells)
    assert np.allclose(w.sum(1), 1) and w[5, 0] > 0.7 and w[2, 0] < 0.01 and w[0, 0] == 0
    assert lm.learn_weights(np.zeros((0, 4), np.int64)).shape == (64, 3)
