"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers.

The fixed patterns find assignments, access keys and long hexadecimal strings.
Their values are the labelled sample of random strings; all other runs of fewer than
20 token characters are the ordinary identifiers. From both, first-order character models
are counted over the whole corpus (two tables of fixed size), and every further
long token is a secret if its log-likelihood ratio per character is nearer to the
random strings' mean than to the identifiers'.

Texts are read once. Their hits and long tokens are written to the shared
folder; the models and scores come from that slim table. No shuffle carries text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdlake.llm.tables import Covered, free_name
from mdlake.llm.words import chunks, slices
from mdlake.session import stored

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more, whole: a run is never entered in its middle
LEAST_TOKEN = 20  # characters of a token that is judged by the models
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_TOKEN)

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SYMBOLS = len(_ALPHABET) + 1  # 0 stands for a token's start and end
_WEIGHT = 5.0  # pseudo-counts of a symbol's own frequency
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[[ord(c) for c in _ALPHABET]] = np.arange(1, SYMBOLS)

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_LONG = T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ARROW_LONG = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_CELL = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])
_ARROW_CELLS = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))


def base_hits(text: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Spans (kind, start, end) by start and kind, and the matched values."""
    hits, values = [], []
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 8:
            hits.append(("assign", m.start(), m.end()))
            values.append(m[1])
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            hits.append(("access", m.start(), m.end()))
            values.append(m[0])
    for m in _HEX.finditer(text):
        hits.append(("hex", m.start(), m.end()))
        values.append(m[0])
    return sorted(hits, key=lambda h: (h[1], KINDS.index(h[0]))), values


def _long_tokens(text: str, hits: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Long tokens that overlap no hit."""
    covered = Covered([h[1:] for h in hits])
    return [(m[0], *m.span()) for m in _TOKEN.finditer(text) if not covered.touches(*m.span())]


def _pairs(data: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbols in UTF-8 bytes that are taken to stand between separators."""
    symbols = np.zeros(len(data) + 2, np.int32)
    symbols[1:-1] = _SYMBOL[data]
    return np.bincount(symbols[:-1] * SYMBOLS + symbols[1:], minlength=SYMBOLS * SYMBOLS)


def _scan(text: str):
    names = ["kept", "spans", "tokens", "random", "ordinary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything, random, unknown = (np.zeros(SYMBOLS**2, np.int64) for _ in range(3))
        kind = None
        for batch in slices(batches, lambda b: b.column("kept").field(text)):
            spans, tokens, values = [], [], []
            texts = batch.column("kept").field(text)
            for x in texts.to_pylist():
                hits, own = base_hits(x or "")
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in hits])
                tokens.append([{"token": t, "start": s, "end": e} for t, s, e in _long_tokens(x or "", hits)])
                values += own
            for _, _, data, _ in chunks(texts):
                everything += _pairs(data)
            random += _pairs(np.frombuffer("\n".join(values).encode(), np.uint8))
            unknown += _pairs(np.frombuffer("\n".join(t["token"] for own in tokens for t in own).encode(), np.uint8))
            kind, none = batch.column("kept").type, pa.nulls(batch.num_rows, _ARROW_CELLS)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(spans, _ARROW_SPANS), pa.array(tokens, _ARROW_LONG), none, none], names)
        if kind is not None:  # a last row with the counts
            ordinary = np.maximum(everything - random - unknown, 0)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, _ARROW_SPANS), pa.nulls(1, _ARROW_LONG), _sparse(random), _sparse(ordinary)], names)

    return run


def _sparse(counts: np.ndarray) -> pa.Array:
    """One row: the cells that are not zero, with their counts."""
    cells = np.flatnonzero(counts)
    return pa.array([[{"cell": c, "n": n} for c, n in zip(cells.tolist(), counts[cells].tolist())]], _ARROW_CELLS)


def _counts(scanned: DataFrame, column: str) -> np.ndarray:
    """The sum of all tasks' counts: at most SYMBOLS**2 rows reach the driver."""
    rows = scanned.where(F.size(column) > 0).select(F.explode(column).alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**2)
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    counts[0] = 0  # between two separators there is no token
    return counts.reshape(SYMBOLS, SYMBOLS)


def ratio_model(random: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-likelihood ratios of symbol pairs and the dividing mean ratio.

    A symbol's frequency (add-one) smooths what follows each symbol. Without any random sample, random strings are taken to be uniform.
    """
    single = ((c.sum(0) + 1) / (c.sum() + SYMBOLS) for c in (random, ordinary))
    log_r, log_o = (np.log((c + _WEIGHT * p) / (c.sum(1, keepdims=True) + _WEIGHT)) for c, p in zip((random, ordinary), single))
    ratio = log_r - log_o
    of = [float((c * ratio).sum() / c.sum()) if c.sum() else float(ratio[1:, 1:].mean()) for c in (random, ordinary)]
    return ratio, max(0.0, (of[0] + of[1]) / 2)


def token_score(token: str, ratio: np.ndarray) -> float:
    """Mean log-likelihood ratio of a token's symbol pairs, start and end included."""
    s = np.concatenate([[0], _SYMBOL[np.frombuffer(token.encode(), np.uint8)], [0]])
    return float(ratio[s[:-1], s[1:]].mean())


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row, with ``secrets``: array of (kind, start, end) by start and kind.

    Kinds are assign, access, hex and, by the models, random. Positions count code points, ends are exclusive.
    A null text counts as empty; rows, repeated ones and those with null ids included, stay as they are.
    """
    out = free_name(docs.select(*keep), "secrets")
    rows = docs.select(F.struct(*dict.fromkeys([*keep, text])).alias("kept"))  # as one column, so that no name can clash
    cells, spans = T.ArrayType(_CELL), T.ArrayType(_SPAN)
    more = [("spans", spans), ("tokens", T.ArrayType(_LONG)), ("random", cells), ("ordinary", cells)]
    schema = T.StructType([T.StructField("kept", rows.schema["kept"].dataType), *(T.StructField(*m) for m in more)])
    scan = rows.mapInArrow(_scan(text), schema)
    if text not in keep:
        scan = scan.withColumn("kept", F.struct(*(F.col(f"kept.`{c}`") for c in keep)))
    scanned = stored(scan, "secret-scan")
    ratio, least = ratio_model(_counts(scanned, "random"), _counts(scanned, "ordinary"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, tokens in zip(batch.column("spans").to_pylist(), batch.column("tokens").to_pylist()):
                more = [{"kind": "random", "start": t["start"], "end": t["end"]} for t in tokens if token_score(t["token"], ratio) > least]
                found.append(sorted(own + more, key=lambda s: (s["start"], (*KINDS, "random").index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found, _ARROW_SPANS)], ["kept", "found"])

    rows = scanned.where("spans IS NOT NULL").select("kept", "spans", "tokens")
    judged = rows.mapInArrow(judge, T.StructType([rows.schema["kept"], T.StructField("found", spans)]))
    return judged.select("kept.*", F.col("found").alias(out))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per row of ``find_secrets(docs, ["doc_id"])``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), number("random"))
