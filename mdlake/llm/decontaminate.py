"""Benchmark decontamination by an FM-index of each shard of the documents.

A shard is a batch of documents. Its words become symbols; a word that no benchmark
item has ends a run, since no phrase can reach over it, and runs shorter than the
shortest phrase are left out. The runs are indexed, all phrases are searched backwards at once,
their occurrences are located from sampled suffix positions, and the words covered
are merged into spans for removal.

Documents are read once and do not move. The benchmark is the stated query set:
it is sent to the shards in blocks of a fixed number of bytes, one pass per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdlake.llm.fmindex import FMIndex
from mdlake.llm.tables import free_name
from mdlake.llm.words import BY_LETTER, chunks, hash_chunk, hash_words, lists, slices

WINDOW = 10  # words of a phrase
BLOCK_BYTES = 16 << 20  # of benchmark texts that are searched in one pass
_FLAG_BITS = 20


@dataclass
class Phrases:
    """All windows of a block of items: by length, rows of symbols and (item, row) pairs."""

    words: np.ndarray  # sorted hashes; the symbol of a word is its index + 1
    flags: np.ndarray  # whether a word may have the low bits
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # distinct windows, items, windows of these items
    items: np.ndarray

    @classmethod
    def of(cls, items: list, texts: list[str | None]) -> Phrases:
        hashes, counts = hash_words(pa.array(texts, pa.string()), BY_LETTER)
        words, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols + 1
        flags = np.zeros(1 << _FLAG_BITS, bool)
        flags[(words & np.uint64((1 << _FLAG_BITS) - 1)).astype(np.int64)] = True
        bounds = np.concatenate([[0], np.cumsum(counts)])
        numbers: dict = {}
        number = np.array([numbers.setdefault(i, len(numbers)) for i in items], np.int64)  # texts of one id are one item
        by_length = []
        for length in range(1, WINDOW + 1):
            of_items = np.flatnonzero(counts >= WINDOW if length == WINDOW else counts == length)
            starts = [np.arange(bounds[i], bounds[i + 1] - length + 1) for i in of_items]
            if starts:
                item = number[np.repeat(of_items, [len(s) for s in starts])]
                windows = symbols[np.concatenate(starts)[:, None] + np.arange(length)]
                distinct, window = np.unique(windows, axis=0, return_inverse=True)
                order = np.argsort(window.ravel(), kind="stable")
                by_length.append((distinct, item[order], np.searchsorted(window.ravel()[order], np.arange(len(distinct) + 1))))
        return cls(words, flags, by_length, np.array(list(numbers), object))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """0 for words of no item."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.flags[(hashes & np.uint64((1 << _FLAG_BITS) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            out[maybe] = np.where(self.words[at] == hashes[maybe], at + 1, 0)
        return out


def find(phrases: Phrases, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For a shard: number of words of each text, which words are hit, (row, item) pairs, and first and last bytes of hit words by row.

    Returns (counts, hit flag of every word, pairs, [starts, ends] of all words in their texts, bounds).
    """
    symbols, counts, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in chunks(texts):
        hashes, first, last, n = hash_chunk(data, offsets, BY_LETTER)
        shift = np.repeat(offsets[:-1], n)
        symbols.append(phrases.symbols(hashes))
        counts.append(n)
        starts.append(first - shift)
        ends.append(last - shift)
    symbols, counts = np.concatenate(symbols), np.concatenate(counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    hit = np.zeros(len(symbols) + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    row_of = np.repeat(np.arange(len(counts)), counts)
    if phrases.by_length and len(symbols):
        known = symbols > 0
        opens = known.copy()
        opens[1:] &= ~known[:-1] | (row_of[1:] != row_of[:-1])
        run = np.cumsum(opens) - 1
        size = np.bincount(run[known], minlength=int(opens.sum()))
        shortest = phrases.by_length[0][0].shape[1]
        word = np.flatnonzero(known)
        word = word[size[run[word]] >= shortest]
        if len(word):
            first = np.flatnonzero(np.concatenate([[True], run[word[1:]] != run[word[:-1]]]))
            index = FMIndex(symbols[word], first, len(phrases.words) + 1)
            found = []
            for windows, items, of_window in phrases.by_length:
                phrase, at = index.locate(*index.search(windows))
                begin = word[at]
                np.add.at(hit, begin, 1)
                np.add.at(hit, begin + windows.shape[1], -1)
                seen = np.unique(np.stack([row_of[begin], phrase], axis=1), axis=0) if len(phrase) else np.zeros((0, 2), np.int64)
                n = of_window[seen[:, 1] + 1] - of_window[seen[:, 1]]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(of_window[seen[:, 1]], n)
                found.append(np.stack([np.repeat(seen[:, 0], n), items[place]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
    return counts, np.cumsum(hit[:-1]) > 0, pairs, [np.concatenate(starts), np.concatenate(ends)], bounds


def _pass(phrases: Phrases, columns: list[str], text: str, out: list[str], earlier: bool):
    """Adds words, hits (indexes of hit words) and items to each row, joined with those of an earlier pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts, hit, pairs, (starts, ends), bounds = find(phrases, batch.column(text))
            words = np.flatnonzero(hit)
            row = np.searchsorted(bounds, words, "right") - 1
            per_row = np.bincount(row, minlength=batch.num_rows)
            hits = pa.StructArray.from_arrays([pa.array(words - bounds[row]), pa.array(starts[words]), pa.array(ends[words])], ["word", "start", "end"])
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), hits)
            named = pairs[[phrases.items[i] is not None for i in pairs[:, 1]]] if len(pairs) else pairs
            items = lists(np.array([str(phrases.items[i]) for i in named[:, 1]], object), np.bincount(named[:, 0], minlength=batch.num_rows), pa.string())
            if earlier:
                merged = [
                    (sorted({(h["word"], h["start"], h["end"]) for h in a + b}), sorted(set(c + d)))
                    for a, b, c, d in zip(batch.column(out[1]).to_pylist(), hits.to_pylist(), batch.column(out[2]).to_pylist(), items.to_pylist())
                ]
                hits = pa.array([[{"word": w, "start": s, "end": e} for w, s, e in m[0]] for m in merged], hits.type)
                items = pa.array([m[1] for m in merged], items.type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(counts), hits, items], [*columns, *out])

    return run


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (word index, first byte, end byte of every word in an occurrence) and ``items``.

    A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. A null text has no words.
    An item without an id is searched for but not listed. Rows of one item id are one item, whatever their texts; repeated documents count each.
    """
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    names = [free_name(docs, n) for n in ("n_words", "hits", "items")]
    hit = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("word", "start", "end")]))
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], hit), T.StructField(names[2], T.ArrayType(T.StringType()))])
    marked = docs
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").distinct().toPandas()  # about block_bytes
        phrases = Phrases.of([None if i != i or i is None else int(i) for i in rows["item_id"]], rows["text"].tolist())
        marked = marked.mapInArrow(_pass(phrases, docs.columns, text, names, block > 0), schema)
    return marked


def without(text: str, hits: list[dict]) -> str:
    """The text without the hit words; words next to each other go with what is between them."""
    data, parts, at, last = text.encode(), [], 0, None
    for h in hits:
        if last is None or h["word"] != last + 1:
            parts.append(data[at : h["start"]])
        at, last = h["end"], h["word"]
    return b"".join([*parts, data[at:]]).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, without the words of benchmark passages."""
    columns = docs.columns
    marked = mark(docs, benchmark, text)
    hits = marked.columns[-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            new = [without(x, own) if own else x for x, own in zip(batch.column(text).to_pylist(), batch.column(hits).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in columns], columns)

    return marked.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def report(marked: DataFrame) -> DataFrame:
    """Counts and the digest of the items per row of ``mark``."""
    words, hits, items = marked.columns[-3:]
    n_hit = F.size(hits).cast("bigint")
    return marked.select(
        "doc_id", F.col(words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
