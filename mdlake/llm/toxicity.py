"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

A text's features are its words, and the first PREFIX bytes of longer ones (a stem that many forms share), hashed into 2**18 slots,
as log(1 + count). One weight vector serves all ordered thresholds: P(grade <= k) = sigmoid(b_k - w.x). The expected severity is the
sum over k of P(grade > k).

The model is fitted by accelerated proximal gradient steps with an L1 penalty, which leaves weights to the few features that matter, on
a sample of labelled rows that is bounded in rows and in words (``sample``, ``words``), by a hash of their id. Features of hardly any
text are left out before anything comes to the driver. A part of the sample is held out to choose the limit from which a document is
rejected. Scoring reads each text once, as vectors of word hashes, and moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdlake.llm.tables import free_name
from mdlake.llm.words import BY_LETTER, flat, hash_prefixes, hash_words, lists, mixed, slices
from mdlake.session import stored

SLOTS = 1 << 18
SAMPLE = 12_000  # labelled rows a model is fitted on, at most
WORDS = 4_000_000  # distinct words of these rows, added up, at most
PREFIX = 5  # bytes
HELD = 4  # one in so many rows of the sample is held out
CLEAN = 0.97  # of held-out clean rows stay below the limit, at least
PENALTY = 0.1  # L1, over the square root of the number of labelled rows
STEPS = 300
COPY = 0.7  # of the union of two texts' words that they share, from which they are near copies
_BANDS, _BAND = 32, 3  # min-hashes that propose near copies: one at COPY is missed with a chance of about 1.4 in a million
_TELLING = 20.0  # times more frequent in toxic texts: words whose density grades a toxic text


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, one per slot
    cuts: np.ndarray  # ascending thresholds b_0 .. b_(K-2)
    limit: float = 0.5  # of the probability of a grade above 0, from which a document is rejected
    held_recall: float | None = None  # of held-out toxic rows that the limit rejects
    held_clean: float | None = None  # of held-out clean rows that it keeps

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) by k, for values of w.x."""
        return 1 - _sigmoid(self.cuts[:, None] - z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray, penalty: float, steps: int = STEPS) -> OrdinalModel:
    """Fits the model to the sparse matrix (rows, slots, values) and grades 0 .. K - 1.

    Cuts are kept ascending as a first cut and positive gaps. A grade that does not occur gets a gap of almost nothing.
    """
    n, top = len(grades), max(1, int(grades.max(initial=0)))
    used, column = np.unique(slots, return_inverse=True)
    above = np.array([np.clip((grades > k).mean() if n else 0.5, 1e-4, 1 - 1e-4) for k in range(top)])
    start = np.maximum.accumulate(np.log((1 - above) / above))
    w, b = np.zeros(len(used)), start + 1e-3 * np.arange(top)
    if not n or not len(used):
        return OrdinalModel(np.zeros(SLOTS, np.float32), b)
    momentum_w, momentum_b, t = w.copy(), b.copy(), 1.0
    norms = np.bincount(rows, values**2, minlength=n)
    rate = 4.0 * n / (top * max(1.0, np.sort(norms)[-max(1, n // 20) :].mean()) * max(1, n) ** 0.5)
    last = np.inf

    def probabilities(w, b):
        z = np.bincount(rows, values * w[column], minlength=n)
        upper = np.vstack([_sigmoid(b[:, None] - z), np.ones(n)])
        lower = np.vstack([np.zeros(n), upper[:-1]])
        own = np.arange(n)
        hi, lo = upper[grades, own], lower[grades, own]
        return hi, lo, np.maximum(hi - lo, 1e-12)

    def loss(w, b):
        return -np.log(probabilities(w, b)[2]).mean() + penalty * np.abs(w).sum()

    for _ in range(steps):
        hi, lo, p = probabilities(momentum_w, momentum_b)
        slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
        by_z = (slope_hi - slope_lo) / p / n  # derivative of the loss by w.x
        gradient_w = np.bincount(column, values * by_z[rows], minlength=len(used))
        gradient_b = np.array([(-(slope_hi / p)[grades == k].sum() + (slope_lo / p)[grades == k + 1].sum()) / n for k in range(top)])
        while True:
            new_w = momentum_w - rate * gradient_w
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
            new_b = momentum_b - min(rate, 1.0) * gradient_b
            new_b = np.maximum.accumulate(new_b + 1e-6 * np.arange(top))
            now = loss(new_w, new_b)
            if now <= last + 1e-3 or rate < 1e-3:
                break
            rate /= 2
            momentum_w, momentum_b, t = w, b, 1.0
            hi, lo, p = probabilities(momentum_w, momentum_b)
            slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
            by_z = (slope_hi - slope_lo) / p / n
            gradient_w = np.bincount(column, values * by_z[rows], minlength=len(used))
            gradient_b = np.array([(-(slope_hi / p)[grades == k].sum() + (slope_lo / p)[grades == k + 1].sum()) / n for k in range(top)])
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum_w, momentum_b, t = new_w + (t - 1) / t_next * (new_w - w), np.maximum.accumulate(new_b + (t - 1) / t_next * (new_b - b)), t_next
        w, b, last = new_w, new_b, min(last, now)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, b)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of the slots in use, by row."""
    keys = []
    for hashes, counts in (hash_words(texts, BY_LETTER), hash_prefixes(texts, BY_LETTER, PREFIX)):
        # a stem has another slot than the word that is spelled like it
        hashes = mixed(hashes) if keys else hashes
        keys.append((np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 18) | (hashes & np.uint64(SLOTS - 1)).astype(np.int64))
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key >> 18, key & (SLOTS - 1), n


def graded(rows: np.ndarray, slots: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ordinal grades 0 .. 3 from two-valued labels.

    Texts that are not toxic have grade 0. A toxic text has grade 1, 2 or 3 by the third of the toxic texts its number
    of telling words is in, where a word tells if it is many times as frequent in toxic texts as in the others.
    """
    bad = toxic[rows] > 0
    n_bad, n_good = max(1, int((toxic > 0).sum())), max(1, int((toxic <= 0).sum()))
    in_bad, in_good = (np.bincount(slots[m], minlength=SLOTS) for m in (bad, ~bad))
    telling = (in_bad >= max(3, 0.03 * n_bad)) & ((in_bad / n_bad) > _TELLING * (in_good + 0.5) / n_good)
    hits = np.bincount(rows, counts * telling[slots], minlength=len(toxic))
    grades = np.zeros(len(toxic), np.int64)
    of_bad = np.flatnonzero(toxic > 0)
    if len(of_bad):
        found = hits[of_bad]
        cuts = np.quantile(found[found > 0], [1 / 3, 2 / 3]) if (found > 0).any() else np.array([np.inf, np.inf])
        grades[of_bad] = 1 + (found[:, None] > cuts).sum(1)
    return grades


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, words: int = WORDS) -> OrdinalModel:
    """Fits to the texts of at most ``sample`` labelled documents (doc_id, toxic) that have ``words`` distinct words in all, at most.

    Rows with a null id or label are left out; of repeated labels the largest counts, of the texts of one id that with the smallest
    hash. Without toxic labels every text gets a severity near 0. A text of any length is one row of at most 2**18 features.
    """
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.xxhash64(text).alias("_digest"), F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("_text", "_toxic"), "_digest").alias("r")).select(F.xxhash64("doc_id").alias("at"), "doc_id", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            row, slots, counts = _features(batch.column("_text"))
            per_row = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("doc_id"), batch.column("_toxic").cast(pa.int32()), pa.array(per_row),
                 lists(slots.astype(np.int32), per_row, pa.int32()), lists(np.minimum(counts, 65535).astype(np.int32), per_row, pa.int32())],
                ["at", "doc_id", "toxic", "n", "slots", "counts"],
            )

    schema = T.StructType([T.StructField("at", T.LongType()), rows.schema["doc_id"], *T.StructType.fromDDL("toxic int, n bigint, slots array<int>, counts array<int>")])
    sampled = stored(rows.mapInArrow(run, schema), "toxicity-sample")

    sizes = sampled.select("at", "n").toArrow().sort_by("at")  # two numbers a row
    fits = np.cumsum(sizes.column("n").to_numpy()) <= words
    if not fits.all():
        sampled = sampled.where(F.col("at") < int(sizes.column("at")[int(np.argmin(fits))].as_py()))
    # features of hardly any text say nothing
    least = max(5, 0.005 * int(fits.sum()))
    used = sampled.select(F.explode("slots").alias("slot")).groupBy("slot").count().where(F.col("count") >= least).select("slot").toArrow().column("slot")
    common = np.zeros(SLOTS, bool)
    common[used.to_numpy()] = True  # of at most SLOTS numbers

    def only_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, per_row = flat(batch.column("slots"))
            keep = common[slots]
            left = np.bincount(np.repeat(np.arange(len(per_row)), per_row)[keep], minlength=len(per_row))
            parts = [lists(x[keep], left, pa.int32()) for x in (slots, flat(batch.column("counts"))[0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts], ["at", "doc_id", "toxic", "slots", "counts"])

    order = [("at", "ascending"), ("doc_id", "ascending")]  # not that of arrival
    whole = sampled.select("at", "doc_id", "toxic", "slots").toArrow().sort_by(order)
    toxic = whole.column("toxic").to_numpy().astype(np.int64)
    slots, per_row = flat(whole.column("slots"))
    first = _one_per_family(np.repeat(np.arange(len(toxic), dtype=np.int32), per_row), slots, toxic)
    del whole, slots
    schema = T.StructType([sampled.schema[c] for c in ("at", "doc_id", "toxic", "slots", "counts")])
    cells = sampled.mapInArrow(only_common, schema).toArrow().sort_by(order).filter(pa.array(first))
    slots, per_row = flat(cells.column("slots"))
    counts = flat(cells.column("counts"))[0].astype(np.float32)
    model = fit_sample(np.repeat(np.arange(len(per_row), dtype=np.int32), per_row), slots, counts, toxic[first])
    del cells, slots, counts
    pa.default_memory_pool().release_unused()
    return model


def fit_sample(rows: np.ndarray, slots: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> OrdinalModel:
    """Selects features with an L1 penalty and fits the chosen ones again with a twentieth of it; ``rows`` ascend.

    Every HELD-th row has no part in that: on these rows the limit is chosen.
    """
    held = np.arange(len(toxic)) % HELD == HELD - 1
    own, number = ~held[rows], np.cumsum(~held) - 1
    of, at, times = number[rows[own]].astype(np.int32), slots[own], counts[own]
    grades = graded(of, at, times, toxic[~held])
    n = max(1, int((~held).sum()))
    keep = np.ones(len(at), bool)
    for penalty in (PENALTY / n**0.5, PENALTY / 20 / n**0.5):
        model = fit_ordinal(of[keep], at[keep], np.log1p(times[keep]), grades, penalty)
        keep = (model.weights != 0)[at]
    on = held[rows]
    z = np.bincount(rows[on], np.log1p(counts[on]) * model.weights[slots[on]], minlength=len(toxic))[held]
    model.limit, model.held_recall, model.held_clean = best_limit(model.above(z)[0], toxic[held])
    return model


def best_limit(p: np.ndarray, toxic: np.ndarray) -> tuple[float, float | None, float | None]:
    """The probability with the largest sum of toxic rows at or above it and clean rows below it, both as shares, and these shares.

    CLEAN of the clean rows must be below; ties go to the larger limit. It lies halfway, in log odds, between the last toxic row
    that it rejects and the first clean one that it keeps, as rows that were not seen scatter around both. Without a toxic or without a clean row it is one half.
    """
    bad, good = np.sort(p[toxic > 0]), np.sort(p[toxic <= 0])
    if not len(bad) or not len(good):
        return 0.5, None, None
    recall = 1 - np.searchsorted(bad, bad, "left") / len(bad)
    kept = np.searchsorted(good, bad, "left") / len(good)
    kept[kept < CLEAN] = -np.inf
    best = len(bad) - 1 - int(np.argmax((recall + kept)[::-1]))
    if not np.isfinite(kept[best]):
        return 0.5, float((bad >= 0.5).mean()), float((good < 0.5).mean())
    last = np.searchsorted(good, bad[best], "left")
    ends = np.clip([bad[best], good[last - 1] if last else 0.0], 1e-6, 1 - 1e-6)
    return float(_sigmoid(np.log(ends / (1 - ends)).mean())), float(recall[best]), float(kept[best])


def _one_per_family(rows: np.ndarray, slots: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Marks the rows that are no near copies of an earlier marked row with the same label; ``rows`` ascend.

    Otherwise the words of a text with many copies would be learned as toxic, or not, with its label.
    Min-hashes propose pairs, the full sets of words decide. Rows without words are all marked.
    """
    first = np.ones(len(toxic), bool)
    own, starts = np.unique(rows, return_index=True)
    if not len(own):
        return first
    ends = np.append(starts[1:], len(rows))
    rng = np.random.default_rng(1)
    kept = {}  # rows that are marked by band, its min-hashes and label
    least = np.stack([np.minimum.reduceat(rng.permutation(SLOTS).astype(np.int32)[slots], starts) for _ in range(_BANDS * _BAND)], 1)
    for at, row in enumerate(own.tolist()):
        keys = [(band, least[at, band * _BAND : (band + 1) * _BAND].tobytes(), int(toxic[row] > 0)) for band in range(_BANDS)]
        words = slots[starts[at] : ends[at]]
        for other in {o for key in keys for o in kept.get(key, ())}:
            both = len(np.intersect1d(words, slots[starts[other] : ends[other]], assume_unique=True))
            if both >= COPY * (len(words) + ends[other] - starts[other] - both):
                first[row] = False
                break
        else:
            for key in keys:
                kept.setdefault(key, []).append(at)
    return first


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (the likeliest) and ``p_toxic`` (that the grade is above 0).

    A null or empty text has no words and the severity of none.
    """
    names = [free_name(docs, n) for n in ("severity", "grade", "p_toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            row, slots, counts = _features(batch.column(text))
            weight = model.weights[slots]
            on = weight != 0
            z = np.bincount(row[on], np.log1p(counts[on]) * weight[on], minlength=batch.num_rows)
            above = model.above(z)
            grades = -np.diff(np.vstack([np.ones(len(z)), above, np.zeros(len(z))]), axis=0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above.sum(0)), pa.array(grades.argmax(0).astype(np.int32)), pa.array(above[0])], [*batch.schema.names, *names]
            )

    more = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *more]))
