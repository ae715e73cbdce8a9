"""Language-model scores by deleted interpolation of words and word pairs.

P(w|h) = l2 c(hw)/c(h) + l1 c(w)/N + l0 /(V+1). The weights l depend on the bucket of c(h), by powers of two. They are
learned by expectation-maximisation: ratios come from the training documents but a tenth, and that tenth gives the held-out counts.
The final ratios come from all training documents.

Counting and scoring move packed arrays, not a row per word:

1. A task turns documents into chunks of about two million words and writes each chunk's words once, as indexes into its distinct words.
2. The distinct words and pairs of a chunk, with their counts, go to ranges of hashes. A range adds up the counts of all chunks
   and answers each chunk with the totals of what it asked for. A frequent word or pair comes once per chunk, so no range is hot.
3. A chunk meets its answers: first the chunks of held-out documents, which give the weights, then all, which gives the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.llm.words import BY_SPACE, chunks, hash_chunk, lists, mixed
from mdlake.session import stored

CHUNK_WORDS = 2_000_000  # words of a chunk, about
RANGE_WORDS = 1_000_000  # words of the corpus for each range of hashes
END = np.uint64(0x8F1BBCDCBFA53E0B)  # the end of a text, which is also what its first word follows
TENTHS, HELD_OUT, DELETED = 10, 0, 1  # the remainders of documents that are not learned from, and that weights are learned on
BINS = 8  # log ratios are rounded to 1 / BINS for the weights
STEPS = 50


def pack(values: np.ndarray) -> bytes:
    """An array, compressed by the planes of its bytes."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _pairs(words: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The hash of each word with the one before it; the stream begins after an end."""
    hashes = words[index]
    before = np.concatenate([[END], hashes[:-1]]) if len(hashes) else hashes
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes))


def chunked(docs: DataFrame, text: str) -> DataFrame:
    """One row per chunk of documents; ``deleted`` chunks hold the tenth that weights are learned on."""
    tenth = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(TENTHS)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        waiting: dict[bool, list] = {False: [], True: []}

        def emit(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            hashes, lengths, ids, tenths = (np.concatenate(x) for x in zip(*waiting[deleted]))
            waiting[deleted] = []
            words, index = np.unique(hashes, return_inverse=True)
            number += 1
            one = np.array([len(ids)])
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([deleted]), pa.array([len(hashes)]), pa.array([ids.tolist()], pa.list_(pa.int64())),
                 lists(tenths.astype(np.int32), one, pa.int32()), lists(lengths.astype(np.int32), one, pa.int32()),
                 pa.array([pack_sorted(words)], pa.binary()), pa.array([pack(index.astype(np.int32))], pa.binary())],
                ["chunk", "deleted", "tokens", "ids", "tenths", "lengths", "words", "index"],
            )

        for batch in batches:
            every_id, every_tenth = np.array(batch.column("doc_id").to_pylist(), object), batch.column("tenth").to_numpy()
            for first, last, data, offsets in chunks(batch.column(text)):
                hashes, _, _, counts = hash_chunk(data, offsets, BY_SPACE)
                lengths = counts + 1
                stream = np.full(int(lengths.sum()), END, np.uint64)
                inside = np.ones(len(stream), bool)
                inside[np.cumsum(lengths) - 1] = False
                stream[inside] = hashes
                ids, tenths = every_id[first:last], every_tenth[first:last]
                for deleted in (False, True):
                    rows = (tenths == DELETED) == deleted
                    if rows.any():
                        waiting[deleted].append((stream[np.repeat(rows, lengths)], lengths[rows], ids[rows], tenths[rows]))
                        if sum(len(x[0]) for x in waiting[deleted]) >= CHUNK_WORDS:
                            yield emit(deleted)
        for deleted in (False, True):
            if waiting[deleted]:
                yield emit(deleted)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, tenth.alias("tenth")).mapInArrow(
        run, "chunk bigint, deleted boolean, tokens bigint, ids array<bigint>, tenths array<int>, lengths array<int>, words binary, index binary"
    )


def _ask(ranges: int):
    """(kind, range, chunk, keys, learned, deleted): a chunk's distinct words and pairs with their training counts."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, index = unpack_sorted(row["words"]), unpack(row["index"], np.int32)
                tenth = np.repeat(np.array(row["tenths"], np.int8), row["lengths"])
                learned = (tenth != HELD_OUT) & (tenth != DELETED)
                for kind in ("word", "pair"):
                    if kind == "word":
                        keys, inverse = words, index
                    else:
                        keys, inverse = np.unique(_pairs(words, index), return_inverse=True)
                    counts = [np.bincount(inverse[m], minlength=len(keys)).astype(np.int32) for m in (learned, tenth == DELETED)]
                    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                    parts = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(parts)), pa.array([r for r, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()),
                         pa.array([pack_sorted(keys[a:b]) for _, a, b in parts], pa.binary()), *(pa.array([pack(c[a:b]) for _, a, b in parts], pa.binary()) for c in counts)],
                        ["kind", "range", "chunk", "keys", "learned", "deleted"],
                    )

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Totals of a range, for each chunk in the order in which it asked; the range's distinct training keys and their number with its first row."""
    keys = [unpack_sorted(k) for k in group.column("keys").to_pylist()]
    cuts = np.cumsum([0, *map(len, keys)])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    totals = []
    for name in ("learned", "deleted"):
        own = np.concatenate([unpack(c, np.int32) for c in group.column(name).to_pylist()])
        totals.append(np.bincount(inverse, own, minlength=len(distinct)).astype(np.int64))
    n = group.num_rows
    known = totals[0] + totals[1]
    answers = [[pack(t[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])] for t in totals]
    first = np.arange(n) == 0
    return pa.table(
        {"chunk": group.column("chunk"), "kind": group.column("kind"), "range": group.column("range"),
         "learned": pa.array(answers[0], pa.binary()), "deleted": pa.array(answers[1], pa.binary()),
         "n_distinct": pa.array(np.where(first, (known > 0).sum(), 0)), "n_learned": pa.array(np.where(first, totals[0].sum(), 0)), "n_deleted": pa.array(np.where(first, totals[1].sum(), 0)),
         "v_learned": pa.array(np.where(first, (totals[0] > 0).sum(), 0))}
    )


_ANSWER = (
    "chunk bigint, kind string, range int, learned binary, deleted binary, "
    "n_distinct bigint, n_learned bigint, n_deleted bigint, v_learned bigint"
)


def _met(state: dict, answers: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For every token its own counts, its pair's and its context's, each as [learned, deleted]."""
    words, index = unpack_sorted(state["words"]), unpack(state["index"], np.int32)
    rows = sorted(answers.to_pylist(), key=lambda r: r["range"])
    counts = {}
    for kind in ("word", "pair"):
        own = [r for r in rows if r["kind"] == kind]
        counts[kind] = [np.concatenate([unpack(r[c], np.int64) for r in own]) for c in ("learned", "deleted")]
    _, of_pair = np.unique(_pairs(words, index), return_inverse=True)
    end = np.searchsorted(words, END)  # every chunk has it
    before = np.concatenate([[end], index[:-1]])
    return [c[index] for c in counts["word"]], [c[of_pair] for c in counts["pair"]], [c[before] for c in counts["word"]]


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, else one more than the power of two below its count."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)


def learn_weights(cells: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights (l2, l1, l0) of each of 64 buckets from rows (bucket, log c(hw)/c(h) over uniform, log c(w)/N over uniform, tokens).

    Logs are in steps of 1 / BINS; a value that did not occur is below -10**6. Buckets without held-out tokens take the weights
    of all, and what a context that was not seen gives to pairs goes to words.
    """

    def maximise(own: np.ndarray) -> np.ndarray:
        ratio = np.stack([np.where(own[:, k] < -(10**6), 0.0, np.exp(own[:, k] / BINS)) for k in (1, 2)] + [np.ones(len(own))], axis=1)
        weights = np.full(3, 1 / 3)
        for _ in range(steps):
            share = ratio * weights
            share /= share.sum(1, keepdims=True)
            weights = (share * own[:, 3:]).sum(0) / own[:, 3].sum()
        weights = np.maximum(weights, [0, 0, 1e-6])
        return weights / weights.sum()

    everywhere = maximise(cells) if len(cells) else np.array([0.5, 0.4, 0.1])
    weights = np.tile(everywhere, (64, 1))
    for bucket in np.unique(cells[:, 0]):
        weights[bucket] = maximise(cells[cells[:, 0] == bucket])
    weights[0, 1] += weights[0, 0]
    weights[0, 0] = 0
    return weights


def lm_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    A text's tokens are its words and one end; a null text has its end only. A row without an id is held out.
    Scores are sums of log10 probabilities. Without training documents all tokens are uniform.
    """
    state = stored(chunked(docs, text), "lm-chunks")
    tokens = state.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(1, -(-int(tokens) // RANGE_WORDS))
    asked = state.mapInArrow(_ask(ranges), "kind string, range int, chunk bigint, keys binary, learned binary, deleted binary")
    answers = stored(asked.groupBy("kind", "range").applyInArrow(_answer, _ANSWER), "lm-counts")
    total = answers.where("kind = 'word'").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_distinct", "n_learned", "n_deleted", "v_learned"))).first()
    n_train, v_train, n_learned, v_learned = total["n_learned"] + total["n_deleted"], total["n_distinct"], total["n_learned"], total["v_learned"]

    def held_out(left: pa.Table, right: pa.Table) -> pa.Table:
        own, pair, context = _met(left.to_pylist()[0], right)
        seen, both, before = own[0], pair[0], context[0]
        uniform = np.log(1 / (v_learned + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            by_pair = np.where(both > 0, np.rint((np.log(both) - np.log(before) - uniform) * BINS), -(10**7))
            by_word = np.where(seen > 0, np.rint((np.log(seen) - np.log(max(n_learned, 1)) - uniform) * BINS), -(10**7))
        cells, n = np.unique(np.stack([buckets(before), by_pair, by_word], axis=1).astype(np.int64), axis=0, return_counts=True)
        return pa.table({"bucket": cells[:, 0], "by_pair": cells[:, 1], "by_word": cells[:, 2], "n": n.astype(np.int64)})

    deleted = state.where("deleted")
    asked_by = answers.join(deleted.select("chunk"), "chunk", "left_semi")
    cells = (
        deleted.groupBy("chunk").cogroup(asked_by.groupBy("chunk")).applyInArrow(held_out, "bucket bigint, by_pair bigint, by_word bigint, n bigint")
        .groupBy("bucket", "by_pair", "by_word").agg(F.sum("n").alias("n")).toPandas()
    )  # a few hundred steps of either logarithm in at most 64 buckets
    weights = learn_weights(cells.to_numpy(np.int64))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own, pair, context = _met(row, right)
        seen, both, before = (c[0] + c[1] for c in (own, pair, context))
        base = np.log10((seen + 0.1) / (n_train + 0.1 * (v_train + 1)))
        own_weights = weights[buckets(before)]
        p = own_weights[:, 0] * both / np.maximum(before, 1) + own_weights[:, 1] * seen / max(n_train, 1) + own_weights[:, 2] / (v_train + 1)
        if not n_train:
            p = np.ones(len(p)) / (v_train + 1)
        lengths = np.array(row["lengths"], np.int64)
        starts = np.cumsum(lengths) - lengths
        return pa.table(
            {"doc_id": pa.array(row["ids"], pa.int64()), "held_out": np.array(row["tenths"]) == HELD_OUT, "n_tokens": lengths,
             "n_known": np.add.reduceat((seen > 0).astype(np.int64), starts), "train_tokens": np.full(len(lengths), n_train, np.int64),
             "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)}
        )

    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, kinds)
