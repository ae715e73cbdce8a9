"""Repeated passages by recompression.

A text's words are the symbols of level 0. Equal neighbours become a run; then rounds join pairs: half of all symbols, by a bit of
their name, open a pair and the others close one. Names are hashes of what they stand for, so every task gives equal runs and pairs the
same name. Whether two neighbours are joined depends on these two alone, so a window of WINDOW words has an interior (what is left when
its first and last run, and in each round a first symbol that closes and a last one that opens, are taken off) that is parsed alike
wherever the window stands.

1. A window is filed under the least named symbol of its interior at the highest level (of ROUNDS) that has one, together with half of
   the other words of the window, on the side where they are: about one key in four words. Equal windows have equal keys.
2. Spark counts the keys. A slice of texts sends each key once, so a key of many texts is no more rows than there are slices. Windows
   under a key that occurs once are unique and go no further.
3. The others are verified on 128 bits of all their words: the first of each kind is found, and sent to its document.
4. Documents drop the words of their shared windows that are not first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdlake.llm.tables import free_name
from mdlake.llm.words import BY_SPACE_CASED, flat, hash_runs, hash_words, lists, mixed, slices
from mdlake.session import stored

WINDOW = 20  # words
ROUNDS = 4  # of pairs: symbols of the last level have three words on average
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = mixed(np.arange(ROUNDS + 1, dtype=np.uint64))  # so that each round deals symbols anew


def windows(counts: np.ndarray) -> np.ndarray:
    """Positions of the words that windows start with; ``counts`` are the texts' numbers of words."""
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(ends))
    return at[at + WINDOW <= ends]


def _least(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first of the least names in each range [low, high); ranges are not empty."""
    best, step = np.arange(len(names)), 1  # of 2 ** k names from each place
    size = np.frexp(high - low)[1] - 1  # k of the largest power of two that fits
    out = np.empty_like(low)
    for k in range(int(size.max(initial=-1)) + 1):
        at = np.flatnonzero(size == k)
        left, right = best[low[at]], best[high[at] - step]
        out[at] = np.where(names[right] < names[left], right, left)
        other = best[np.minimum(np.arange(len(names)) + step, len(names) - 1)]
        best, step = np.where(names[other] < names[best], other, best), 2 * step
    return out


def parse(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, first word, words) of the symbol that each window is filed under."""
    starts = windows(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    first, size = starts.copy(), np.ones(len(starts), np.int64)  # of a window without an interior: its first word
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    places = np.append(np.flatnonzero(new), len(hashes))
    length = np.diff(places)
    names = hashes[places[:-1]]
    names = np.where(length > 1, mixed(names + mixed(length.astype(np.uint64))), names)
    run = np.cumsum(new) - 1
    open_, low, high = np.arange(len(starts)), run[starts] + 1, run[starts + WINDOW - 1]
    some = low < high
    open_, low, high = open_[some], low[some], high[some]
    for level in range(ROUNDS + 1):
        text = text[places[:-1]] if level == 0 else text
        opens = mixed(names + _LEVEL[level]) >> np.uint64(63) == 1
        pair = np.zeros(len(names), bool)
        pair[:-1] = opens[:-1] & ~opens[1:] & (text[:-1] == text[1:])
        inner_low, inner_high = low + ~opens[low], high - opens[high - 1]
        last = (inner_low >= inner_high) if level < ROUNDS else np.ones(len(low), bool)
        chosen = _least(names, low[last], high[last])
        first[open_[last]], size[open_[last]] = places[chosen], places[chosen + 1] - places[chosen]
        if last.all():
            break
        kept = np.ones(len(names), bool)
        kept[1:] = ~pair[:-1]
        number = np.cumsum(kept) - 1
        on = ~last
        open_, low, high = open_[on], number[inner_low[on]], number[inner_high[on] - 1] + 1
        joined = np.flatnonzero(pair)
        names[joined] = mixed(names[joined] * _STEP + mixed(names[joined + 1]))
        places = np.append(places[:-1][kept], places[-1])
        names, text = names[kept], text[kept]
    return starts, first, size


def keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of the windows that are filed under the same words, in order."""
    starts, first, size = parse(hashes, counts)
    rest = WINDOW - size
    left = first - starts >= (rest + 1) // 2
    low, high = np.where(left, first - (rest + 1) // 2, first), np.where(left, first + size, first + size + rest // 2)
    new = np.ones(len(starts), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (left[1:] != left[:-1])
    at = np.flatnonzero(new)
    key = mixed(hash_runs(hashes, low[at], high[at]) + left[at].astype(np.uint64))
    return key, starts[at], np.diff(np.append(at, len(starts)))


def _filed(docs: DataFrame, text: str) -> DataFrame:
    """(key, doc_id, span, shared): a span is a document's word and a number of windows, as first * 256 + number.

    A key that occurs once in a slice of texts asks for the others. One that occurs more often tells so, once for the slice
    (without a document), and its spans are shared already: they travel under a key of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            hashes, counts = hash_words(batch.column(text), BY_SPACE_CASED)
            key, at, n = keys(hashes, counts)
            ends = np.cumsum(counts)
            row = np.searchsorted(ends, at, "right")
            span = (at - (ends - counts)[row]) << 8 | n
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            several, place, times = np.unique(key, return_inverse=True, return_counts=True)
            here = times[place] > 1
            several = several[times > 1]
            own = np.where(here, mixed(key + mixed(span.astype(np.uint64) + doc.astype(np.uint64) * _STEP)), key)
            none = pa.nulls(len(several), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own, several]).view(np.int64)), pa.concat_arrays([pa.array(doc, pa.int64()), none]),
                 pa.concat_arrays([pa.array(span, pa.int64()), none]), pa.array(np.append(here, np.ones(len(several), bool)))],
                ["key", "doc_id", "span", "shared"],
            )

    return docs.mapInArrow(run, "key bigint, doc_id bigint, span bigint, shared boolean")


def _starts(span: np.ndarray) -> np.ndarray:
    """The windows of spans."""
    n = span & 255
    return np.repeat((span >> 8) - np.cumsum(n) + n, n) + np.arange(n.sum())


def _shared_windows(batch: pa.RecordBatch, text: str, spans: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, 64 bits, 64 bits) of the windows in the spans of each row, and the rows' numbers of words."""
    hashes, counts = hash_words(batch.column(text), BY_SPACE_CASED)
    span, n = flat(batch.column(spans))
    span = span.astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(n)), n), span & 255)
    start = _starts(span)
    one = np.unique(row << 32 | start)  # rows of one id share their spans, which may overlap or end beyond a row
    row, start = one >> 32, one & 0xFFFFFFFF
    real = start + WINDOW <= counts[row]
    row, start = row[real], start[real]
    at = start + (np.cumsum(counts) - counts)[row]
    return row, start, hash_runs(hashes, at, at + WINDOW), hash_runs(mixed(hashes + np.uint64(1)), at, at + WINDOW), counts


def _firsts(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, first): starts and 64 bits of the windows in ``_spans`` that stand nowhere earlier, as one list per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            row, start, a, b, _ = _shared_windows(batch, text, "_spans")
            doc = batch.column("doc_id").to_numpy()[row]
            order = np.lexsort((start, doc, b, a))  # the first of each kind in this slice
            a, b, doc, start = a[order], b[order], doc[order], start[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (a.view(np.int64), b.view(np.int64), doc, start)], ["a", "b", "doc_id", "start"])

    windows_ = docs.select("doc_id", text, "_spans").mapInArrow(run, "a bigint, b bigint, doc_id bigint, start bigint")
    first = windows_.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("p"))
    return first.select("p.doc_id", F.struct("p.start", "a").alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("first"))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words outside repeated windows, joined by one space.

    A word goes if a window of WINDOW words that covers it also starts earlier: in a document with a smaller ``doc_id``, or
    earlier in its own. A null or empty text has no words. Rows of one id are one document, whose windows start where they
    stand in their row. A row without an id keeps its words, and none goes because of it.
    """
    has_id, digest = F.col("doc_id").isNotNull(), F.xxhash64(text)
    known = docs.where(has_id)
    texts = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    of = Window.partitionBy("key")
    filed = _filed(texts, text).withColumn("shared", F.max("shared").over(of) | (F.count("*").over(of) > 1))
    spans = stored(filed.where("shared AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list("span").alias("_spans")), "repeat-spans")

    # equal texts have one name as a whole: all windows of a later one start earlier, too
    whole = texts.select("doc_id", digest.alias("d"), F.xxhash64(F.lit(1), text).alias("e"))
    least = whole.groupBy("d", "e").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copied = whole.join(least, ["d", "e"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("d").alias("_copied"))
    copied = stored(copied, "repeat-copies")

    is_copy = F.coalesce(F.array_contains("_copied", digest), F.lit(False))
    judged = texts.join(spans.join(copied, "doc_id", "left"), "doc_id").where(~is_copy)
    first = stored(_firsts(judged, text), "repeat-firsts")

    side = spans.join(first, "doc_id", "full").join(copied, "doc_id", "full")
    names = {n: free_name(docs, n) for n in ("_spans", "_first", "_start", "_copied", "_copy", "n_words", "n_removed", "kept_text")}
    parts = {names["_spans"]: F.col("_spans"), names["_first"]: F.col("first.a"), names["_start"]: F.col("first.start").cast("array<bigint>"), names["_copied"]: F.col("_copied")}
    side = side.select("doc_id", *(x.alias(n) for n, x in parts.items()))
    nothing = docs.where(~has_id).select(*docs.columns, *(F.lit(None).cast("array<bigint>").alias(n) for n in parts))  # no null meets the join
    joined = known.join(side, "doc_id", "left").select(*docs.columns, *parts).union(nothing)
    joined = joined.withColumn(names["_copy"], F.coalesce(F.array_contains(names["_copied"], digest), F.lit(False))).drop(names["_copied"])

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            row, start, name, _, counts = _shared_windows(batch, text, names["_spans"])
            later = np.ones(len(row), bool)
            if len(row):  # a window is first if its row's list has its start and its name
                first_name, n = flat(batch.column(names["_first"]))
                own = np.repeat(np.arange(len(n)), n)
                kinds = np.stack([np.append(row, own), np.append(start, flat(batch.column(names["_start"]))[0].astype(np.int64)), np.append(name, first_name.astype(np.int64).view(np.uint64)).view(np.int64)], 1)
                order = np.lexsort(kinds.T[::-1])
                kinds = kinds[order]
                same = (kinds[1:] == kinds[:-1]).all(1)
                found = np.zeros(len(kinds), bool)
                found[order[1:]] |= same
                found[order[:-1]] |= same
                later = ~found[: len(row)]
            offset = np.append(0, np.cumsum(counts))
            at = offset[row[later]] + start[later]
            gone = np.cumsum(np.bincount(at, minlength=offset[-1] + 1) - np.bincount(at + WINDOW, minlength=offset[-1] + 1)) > 0
            removed, kept = [], []
            for i, (value, copy) in enumerate(zip(batch.column(text), batch.column(names["_copy"]).to_pylist())):
                words = (value.as_py() or "").encode().split()  # by the same six characters
                mask = gone[offset[i] : offset[i + 1]]
                if copy and len(words) >= WINDOW:
                    mask = np.ones(len(words), bool)
                removed.append(int(mask.sum()))
                kept.append(b" ".join(compress(words, (~mask).tolist()) if removed[-1] else words).decode())
            out = [*(batch.column(c) for c in columns), pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*columns, names["n_words"], names["n_removed"], names["kept_text"]])

    more = [T.StructField(names["n_words"], T.LongType()), T.StructField(names["n_removed"], T.LongType()), T.StructField(names["kept_text"], T.StringType())]
    return joined.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *more]))
