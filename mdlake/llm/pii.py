"""Personal data: fixed patterns, and terms that give protected entities away.

Base kinds (email, ip, card, phone) are found by patterns. Each value found is a
protected entity. The words around its mentions are terms; how strongly a term
reveals an entity is its pointwise mutual information with the entity over the
corpus' documents, as a share of the entity's own information content: near 1 means
that the term occurs in no other document than the entity's. Every pair that occurs
is judged; how often an entity's documents hold a term is drawn towards the term's
frequency in the corpus by one further document, which tempers small counts. Terms
above one threshold are generalised to the class of word they are, above another removed.

1. One pass over the texts writes the hits, their entities and the pairs (entity, term).
2. A second pass counts the documents of the terms. What it looks for is broadcast
   as a table of 2**25 bits, whatever their number; words are compared as vectors of hashes.
3. A pair's documents are those of the entity that hold the term anywhere. Those where it
   stands far from the mentions are found in the entities' documents, again by bits.
4. All occurrences of a disclosing pair's term in the entity's documents are marked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdlake.llm.tables import Covered, free_name
from mdlake.llm.words import BY_LETTER, hash_words, mixed, slices
from mdlake.session import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match always ends its run of digits
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{3,}")

WINDOW = 60  # characters on each side of a mention; words that stand there once are terms of the entity
GENERALISE, REMOVE = 0.6, 0.9  # shares of an entity's information content
_FLAGS, _BLOCK = 1 << 25, 1 << 16  # bits of a table, and of the pieces in which it is made
HELD = 1_000_000  # words of slices of texts that a task adds up
_PAIRS = 1 << 20  # pairs of a text that are looked up at a time

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_TERM = T.StructType([T.StructField("entity", T.LongType()), T.StructField("term", T.LongType())])
_ARROW_TERMS = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_hits(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by kind and start, in code points."""
    hits = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            hits.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at)  # no local part reaches across an @
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            hits.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                hits.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            hits.append(("phone", m.start(), m.end()))
    return hits


def _entity(kind: str, value: str) -> int:
    plain = value.lower() if kind == "email" else "".join(c for c in value if c.isdigit() or c == "." and kind == "ip")
    return int.from_bytes(blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def _hashes(words: list[str]) -> list[int]:
    return hash_words(pa.array(words, pa.string()), BY_LETTER)[0].view(np.int64).tolist()


def _terms(text: str, hits: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Distinct (entity, term) of whole words near each hit and outside all hits."""
    found, covered = [], Covered([h[1:] for h in hits])
    for kind, start, end in hits:
        entity = _entity(kind, text[start:end])
        left, right = max(0, start - WINDOW), min(len(text), end + WINDOW)
        for m in _WORD.finditer(text, left, right):
            a, b = m.span()
            cut = a == left and a > 0 and _WORD.match(text[a - 1] * 3) or b == right and b < len(text) and _WORD.match(text[b] * 3)
            if not cut and not covered.touches(a, b):
                found.append((entity, m[0]))
    return list(dict.fromkeys(zip((e for e, _ in found), _hashes([w for _, w in found]))))


def _scan(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, lambda b: b.column("kept").field(text)):
            spans, entities, terms = [], [], []
            for x in batch.column("kept").field(text).to_pylist():
                hits = base_hits(x or "")
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in hits])
                entities.append(list(dict.fromkeys(_entity(k, x[s:e]) for k, s, e in hits)))
                terms.append(_terms(x, hits) if hits else [])
            columns = [batch.column("kept"), pa.array(spans, _ARROW_SPANS), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, _ARROW_TERMS)]
            yield pa.RecordBatch.from_arrays(columns, ["kept", "spans", "entities", "terms"])

    return run


def _pair(entity: np.ndarray, term: np.ndarray) -> np.ndarray:
    return mixed(entity * np.uint64(0x9E3779B97F4A7C15) + term)


def _flags(hashes: DataFrame) -> np.ndarray:
    """A table of _FLAGS bits in which those of the hashes are set; two columns of hashes are taken as pairs."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            slot = np.unique((h[0] if len(h) == 1 else _pair(*h)) & np.uint64(_FLAGS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot // _BLOCK).astype(np.int32)), pa.array((slot % _BLOCK).astype(np.int32))], ["block", "at"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for batch in batches:
            block, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for b in np.unique(block).tolist():
                made.setdefault(b, np.zeros(_BLOCK, bool))[at[block == b]] = True
        for b, marks in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()])], ["block", "bits"])

    rows = hashes.mapInArrow(slots, "block int, at int").repartition("block").mapInArrow(pieces, "block int, bits binary").toPandas()
    flags = np.zeros((_FLAGS // _BLOCK, _BLOCK // 8), np.uint8)
    for block, bits in zip(rows["block"], rows["bits"]):
        flags[block] |= np.frombuffer(bits, np.uint8)
    return flags.reshape(-1)


def _set(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    slot = hashes & np.uint64(_FLAGS - 1)
    return (flags[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _documents_of(docs: DataFrame, text: str) -> DataFrame:
    """(term, n_term): in how many texts each word occurs. A task adds up to HELD words before it sends them, so rows grow with the texts."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        term, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return term, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(term)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts, size = [none], 0
        for batch in slices(batches, text):
            hashes, counts = hash_words(batch.column(text), BY_LETTER)
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            once = np.ones(len(hashes), bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            parts.append(np.unique(hashes[once], return_counts=True))
            size += len(parts[-1][0])
            if size > HELD:
                parts = [summed(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["term", "n"])
                    parts, size = [none], 0
        term, n = summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    return docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))


def _held(touched: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, entity, term) of the pairs, wherever in a text with the entity the term stands."""
    entity_flags, term_flags, pair_flags = _flags(pairs.select("entity")), _flags(pairs.select("term")), _flags(pairs.select("entity", "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            hashes, counts = hash_words(batch.column("body"), BY_LETTER)
            ends = np.cumsum(counts)
            for row, own, end, n in zip(batch.column("row").to_pylist(), batch.column("entities").to_pylist(), ends.tolist(), counts.tolist()):
                entities = np.array(own, np.int64).view(np.uint64)
                entities = entities[_set(entity_flags, entities)]
                if not len(entities):
                    continue
                words = np.unique(hashes[end - n : end])
                words = words[_set(term_flags, words)]
                step = max(1, _PAIRS // max(1, len(words)))
                for k in range(0, len(entities), step):
                    e, w = np.nonzero(_set(pair_flags, _pair(entities[k : k + step, None], words[None, :])))
                    if len(e):
                        columns = [np.full(len(e), row, np.int64), entities[k + e].view(np.int64), words[w].view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "entity", "term"])

    found = touched.select("row", "entities", "body").mapInArrow(run, "row bigint, entity bigint, term bigint")
    return found.join(pairs.select("entity", "term"), ["entity", "term"], "left_semi").select("row", "entity", "term")  # bits may be shared


def disclosing(touched: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share), how much of an entity's information a term reveals, for all pairs seen together,
    and (row, entity, term) of every text that holds both; rows may repeat. ``touched`` are the texts with entities.
    """
    mention = touched.select("row", F.explode("terms").alias("t")).select("row", "t.entity", "t.term")
    entities = touched.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = stored(mention.groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(entities, "entity"), "pii-pairs")
    partly = F.col("n_both") < F.col("n_entity")  # further documents may hold the term
    held = stored(_held(touched, pairs.where(partly)), "pii-held")
    further = held.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    counted = pairs.where(~partly).unionByName(further.join(entities, "entity"))
    total = F.lit(float(max(docs.count(), 1)))
    info, usual = F.log2(total / F.col("n_entity")), F.col("n_term") / total
    pmi = F.log2((F.col("n_both") + usual) / (F.col("n_entity") + 1) / usual)
    shares = (
        counted.join(_documents_of(docs, text), "term")
        .select("entity", "term", F.when(info > 0, pmi / info).otherwise(F.lit(0.0)).alias("share"))
    )
    return shares, mention.unionByName(held)


def _mark(body):
    """Adds the spans of all words that are telling terms of their text and lie outside all hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            spans = batch.column("spans").to_pylist()
            for x, own, telling in zip(body(batch).to_pylist(), spans, batch.column("telling").to_pylist()):
                if not telling:
                    continue
                kinds = {t["term"]: t["kind"] for t in telling}
                covered, at = Covered([(s["start"], s["end"]) for s in own]), [m.span() for m in _WORD.finditer(x)]
                found = [(kinds[h], a, b) for h, (a, b) in zip(_hashes([x[a:b] for a, b in at]), at) if h in kinds and not covered.touches(a, b)]
                own += [{"kind": k, "start": a, "end": b} for kind in ("term", "class") for k, a, b in found if k == kind]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(spans, _ARROW_SPANS)], ["kept", "spans"])

    return run


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, with ``pii``: array of (kind, start, end).

    Kinds are those of the patterns in their order and then ``term`` (removed) and ``class`` (generalised),
    each by start. Positions count code points, ends are exclusive. A null text counts as empty. Repeated rows
    count as documents of their own.
    """
    out = free_name(docs.select(*keep), "pii")
    kept = F.struct(*dict.fromkeys([*keep, text])).alias("kept")  # as one column, so that no name can clash
    rows = docs.select(kept)
    schema = T.StructType([*rows.schema, T.StructField("spans", T.ArrayType(SPAN)), T.StructField("entities", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(_TERM))])
    scan = rows.mapInArrow(_scan(text), schema).withColumn("row", F.monotonically_increasing_id())
    if text not in keep:  # then only texts with entities are written
        scan = scan.withColumn("body", F.when(F.size("entities") > 0, F.col(f"kept.`{text}`"))).withColumn("kept", F.struct(*(F.col(f"kept.`{c}`") for c in keep)))
    scanned = stored(scan, "pii-scan")  # written once: row numbers stay
    corpus = scanned.select(F.col(f"kept.`{text}`").alias(text)) if text in keep else docs
    plain, touched = scanned.where(F.size("entities") == 0), scanned.where(F.size("entities") > 0)
    body = F.col(f"kept.`{text}`") if text in keep else F.col("body")
    shares, held = disclosing(touched.select("row", "entities", "terms", body.alias("body")), corpus, text)
    kind = F.when(F.col("share") >= REMOVE, "term").otherwise("class").alias("kind")
    telling = (
        held.join(shares.where(F.col("share") >= GENERALISE).select("entity", "term", kind), ["entity", "term"])
        .groupBy("row", "term").agg(F.max("kind").alias("kind"))  # removal goes first
        .groupBy("row").agg(F.collect_list(F.struct("term", "kind")).alias("telling"))
    )
    both = touched.join(stored(telling, "pii-terms"), "row", "left")
    own = (lambda b: b.column("kept").field(text)) if text in keep else (lambda b: b.column("body"))
    columns = ["kept", "spans", "telling"] if text in keep else ["kept", "spans", "telling", "body"]
    marked = both.select(*columns).mapInArrow(_mark(own), scanned.select("kept", "spans").schema)
    return plain.select("kept", "spans").unionByName(marked).select("kept.*", F.col("spans").alias(out))


_CLASS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[REMOVED]"}


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced; of overlapping spans the one that starts first (then the longer) stands for all."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            if end > at:  # the rest of an overlapping span goes too
                at = end
            continue
        parts.append(text[at:start])
        word = text[start:end]
        parts.append(_CLASS.get(kind) or ("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"))
        at = end
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, their texts with personal data and telling terms replaced; a null text stays null."""
    columns = docs.columns
    found = find_pii(docs, columns, text)
    spans = found.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            new = [
                sanitised(x, [(s["kind"], s["start"], s["end"]) for s in own]) if own else x
                for x, own in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in columns], columns)

    return found.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per row of ``find_pii(docs, ["doc_id"])``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS))
    number = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), number("term"), number("class"))
