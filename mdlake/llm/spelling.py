"""Spelling variants by k-d trees over letter counts.

A word is the vector of its 90 letters' counts. A replaced letter lowers one count and raises another by one, an inserted letter raises one,
so near words are within an L1 distance of two, and a search for them is a search of a small box.

Each length has a tree. Its upper planes, one letter and one count each, are chosen from counts over all words of that length, so that
a cell holds about CELL of them; a word asks the cells of its own length, and those of words one letter longer, that the planes leave in
reach. Cells of any size are cut into slices, and their askers into blocks. Inside, the tree goes on down to LEAF words: a node whose
bounding box is out of reach is passed over, the words of a leaf are compared by their counts, and what is close enough by the order of
its letters. Only the number of near words and the most frequent one leave a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.llm.words import slices
from mdlake.session import stored

LEAST_LETTERS, LEAST_TIMES = 5, 3
CELL = 16_384  # words of a cell or block, fewer if they are long
CELL_LETTERS = 1 << 22
LEAF = 64
LETTERS = 26 + 64  # a to z, and U+00C0 to U+00FF
HELD = 200_000  # words that a task adds up before it sends them
_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_TIMES = 3  # planes lie above a count of 0, 1 or 2


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the runs of letters, with A-Z in lower case, that have enough letters and occur often enough.

    A run whose checksum together with its document's id is a multiple of 97 loses one letter. A null id counts as an empty one.
    Tasks add up before they send.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches, "text"):
            for id_, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                start = crc32(f"{id_}:".encode())
                for word, n in Counter(_RUNS.findall((value.as_py() or "").encode().lower().decode())).items():  # bytes: A-Z only
                    h = crc32(word.encode(), start)
                    if h % 97 == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    seen[word] += n
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters as numbers from 0, one after another, and the words' lengths."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    return np.where(codes < 0x80, codes - ord("a"), codes - 0xC0 + 26), size


def counted(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    codes, size = letters(words)
    row = np.repeat(np.arange(len(words)), size)
    return np.bincount(row * LETTERS + codes, minlength=len(words) * LETTERS).reshape(len(words), LETTERS)


def planes(words: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """For each length: the (letter, count) planes of its tree's upper levels, each with another letter, the most even ones.

    A length has so many planes that even ones would leave CELL words to a cell. What comes to the driver are sums by
    length and letter for lengths with more words than that.
    """
    sizes = {r.size: r.n for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    large = {m: n for m, n in sizes.items() if n > room(m)}
    out: dict[int, list[tuple[int, int]]] = {m: [] for m in sizes}
    if not large:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            size = np.array([len(w) for w in own], np.int64)
            times = counted(own)
            for m in np.unique(size).tolist():
                above = np.stack([(times[size == m] > t).sum(0) for t in range(_TIMES)])
                t, letter = np.nonzero(above)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), m)), pa.array(letter), pa.array(t), pa.array(above[t, letter])], ["size", "letter", "t", "n"])

    sums = words.where(F.length("word").isin(*large)).select("word").mapInArrow(run, "size bigint, letter bigint, t bigint, n bigint")
    for r in sums.groupBy("size", "letter", "t").agg(F.sum("n").alias("n")).orderBy("size", "letter", "t").collect():
        out[r.size].append((abs(2 * r.n - sizes[r.size]), r.letter, r.t))
    for m, n in large.items():
        best: dict[int, int] = {}
        for _, letter, t in sorted(out[m]):
            best.setdefault(letter, t)
        out[m] = list(best.items())[: max(1, int(n / room(m) - 1).bit_length())]
    return out


def room(size: int) -> int:
    """How many words of a length a task takes."""
    return max(1, min(CELL, CELL_LETTERS // size))


def _reached(times: np.ndarray, tree: list[tuple[int, int]], lowered: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, cell): the cells of ``tree`` with vectors that have one count more, and one less if ``lowered``; own ones included."""
    row, path = np.arange(len(times)), np.zeros(len(times), np.int64)
    up, down = [(row, path * 0)], [(row, path * 0)]  # (words, flipped planes)
    for level, (letter, t) in enumerate(tree):
        path |= (times[:, letter] > t).astype(np.int64) << level
        for flips, edge in ((up, t), (down, t + 1)):
            at = np.flatnonzero(times[:, letter] == edge)
            flips.append((at, np.full(len(at), 1 << level)))
    out = [(r, path[r] ^ f) for r, f in up]
    for r, f in down[1:] if lowered else ():
        for s, g in up:
            both = np.intersect1d(r, s, assume_unique=True)
            if len(both):
                out.append((both, path[both] ^ f[0] ^ g[0]))
    return np.concatenate([r for r, _ in out]), np.concatenate([p for _, p in out])


def _rows(words: DataFrame, trees: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(size, cell, asks, word, n): each word once in its cell, and once in every cell it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            length = np.array([len(w) for w in own], np.int64)
            times = counted(own)
            for m in np.unique(length).tolist():
                of = np.flatnonzero(length == m)
                parts = [(m, False, np.arange(len(of)), sum(((times[of, c] > t).astype(np.int64) << k for k, (c, t) in enumerate(trees[m])), np.zeros(len(of), np.int64)))]
                parts.append((m, True, *_reached(times[of], trees[m], True)))
                if m + 1 in trees:
                    parts.append((m + 1, True, *_reached(times[of], trees[m + 1], False)))
                for size, asks, row, cell in parts:
                    take = pa.array(of[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), size)), pa.array(cell), pa.array(np.full(len(row), asks)), batch.column("word").take(take), batch.column("n").take(take)],
                        ["size", "cell", "asks", "word", "n"],
                    )

    return words.mapInArrow(run, "size bigint, cell bigint, asks boolean, word string, n bigint")


def close(data: np.ndarray, asking: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    """(data, asking) pairs of rows where the data have one count that is higher by one and, if not ``more``, one that is lower by one.

    Sums of rows are taken to differ by ``more`` for all pairs, so the squared distance tells. Planes halve the data
    down to LEAF rows; a row asks a half while the counts it lacks, and those it has too many of, do not exceed what one edit changes.
    """
    used = data.any(0) | asking.any(0)
    data, asking = np.ascontiguousarray(data[:, used]), np.ascontiguousarray(asking[:, used])
    of_data, of_asking = (np.einsum("ij,ij->i", x, x) for x in (data, asking))
    kind = np.float32 if max(of_data.max(initial=0), of_asking.max(initial=0)) < 1 << 20 else np.float64  # exact
    exact_data, exact_asking = data.astype(kind), asking.astype(kind)
    by_letter = np.ascontiguousarray(asking.T).astype(np.int32)
    none = np.zeros(len(asking), np.int32)
    bounds = np.zeros(data.shape[1], np.int32)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    todo = [(np.arange(len(data)), np.arange(len(asking)), none, none, bounds, bounds + np.int32(1 << 30))]
    while todo:
        own, ask, lacks, extra, low, high = todo.pop()
        if not len(ask):
            continue
        inside = data[own]
        spread = inside.var(0) if len(own) > LEAF else None
        if spread is None or not spread.any():
            step = max(1, (1 << 22) // len(own))
            for k in range(0, len(ask), step):
                part = ask[k : k + step]
                apart = of_asking[part][:, None] + of_data[own] - 2 * (exact_asking[part] @ exact_data[own].T)
                a, d = np.nonzero(apart == 2 - more)
                found.append((own[d], part[a]))
            continue
        axis = int(np.argmax(spread))
        values = inside[:, axis]
        middle = min(int(np.partition(values, (len(own) - 1) // 2)[(len(own) - 1) // 2]), int(values.max()) - 1)
        c = by_letter[axis][ask]
        too_many = extra + np.maximum(c - middle, 0) - np.maximum(c - high[axis], 0)
        too_few = lacks + np.maximum(middle + 1 - c, 0) - np.maximum(low[axis] - c, 0)
        for half, reach, few, many, edge, at in (
            (own[values <= middle], too_many <= 1 - more, lacks, too_many, (low, high.copy()), (1, middle)),
            (own[values > middle], too_few <= 1, too_few, extra, (low.copy(), high), (0, middle + 1)),
        ):
            edge[at[0]][axis] = at[1]
            todo.append((half, ask[reach], few[reach], many[reach], *edge))
    return np.concatenate([d for d, _ in found]), np.concatenate([a for _, a in found])


def one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether rows of letters, of equal length or the first with one more, differ by exactly one letter."""
    m = shorter.shape[1]
    front = np.logical_and.accumulate(longer[:, :m] == shorter, axis=1).sum(1)
    back = np.logical_and.accumulate(longer[:, ::-1][:, :m] == shorter[:, ::-1], axis=1).sum(1)
    if longer.shape[1] == m:
        return front + back == m - 1
    return front + back >= m


def _near(rows: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of near words and the least of (-n, word) among them, for words that have any."""
    sizes = rows.groupBy("size", "cell").agg(F.count_if(~F.col("asks")).alias("own"), F.count_if("asks").alias("asking")).where("own > 0 AND asking > 0")
    limit = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(CELL_LETTERS / F.col("size"))))
    parts = sizes.select("size", "cell", F.ceil(F.col("own") / limit).cast("int").alias("slices"), F.ceil(F.col("asking") / limit).cast("int").alias("blocks"))
    rows = rows.join(parts, ["size", "cell"])

    def place(n: str):
        return F.pmod(F.xxhash64("word"), F.col(n)).cast("int")

    def every(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    dealt = rows.select(
        "size", "cell", "asks", "word", "n", F.when(F.col("asks"), every("slices")).otherwise(F.array(place("slices"))).alias("slices"),
        F.when(F.col("asks"), F.array(place("blocks"))).otherwise(every("blocks")).alias("blocks"),
    )
    dealt = dealt.select("size", "cell", "asks", "word", "n", F.explode("slices").alias("slice"), "blocks")
    dealt = dealt.select("size", "cell", "asks", "word", "n", "slice", F.explode("blocks").alias("block"))

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        words, n = np.array(group.column("word").to_pylist(), object), group.column("n").to_numpy()
        size = group.column("size")[0].as_py()
        length = np.array([len(w) for w in words], np.int64)
        own = np.flatnonzero(~asks)
        pairs = []
        for m in (size - 1, size):
            asking = np.flatnonzero(asks & (length == m))
            if not len(own) or not len(asking):
                continue
            data_letters, asking_letters = (letters(list(words[of]))[0].reshape(len(of), -1) for of in (own, asking))
            d, a = close(counted(list(words[own])), counted(list(words[asking])), size - m)
            step = max(1, CELL_LETTERS // size)
            good = [one_edit(data_letters[d[k : k + step]], asking_letters[a[k : k + step]]) for k in range(0, len(d), step)]
            good = np.concatenate([np.zeros(0, bool), *good])
            d, a = own[d[good]], asking[a[good]]
            pairs.append((a, d))
            if m < size:
                pairs.append((d, a))
        if not sum(len(a) for a, _ in pairs):
            return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "minus_n": pa.array([], pa.int64()), "near": pa.array([], pa.string())})
        word, near = (np.concatenate(x) for x in zip(*pairs))
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[near], -n[near], word))
        word, near = word[order], near[order]
        one, first, count = np.unique(word, return_index=True, return_counts=True)
        return pa.table({"word": pa.array(words[one], pa.string()), "n_near": pa.array(count, pa.int64()), "minus_n": pa.array(-n[near[first]]), "near": pa.array(words[near[first]], pa.string())})

    found = dealt.groupBy("size", "cell", "slice", "block").applyInArrow(run, "word string, n_near bigint, minus_n bigint, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("best"))


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``docs``.

    Words are near if they differ by one inserted, deleted or replaced letter. A word's form is its most frequent near word (of
    equally frequent ones the first by code points) if that occurs at least twice as often; its root is where the forms end. A null
    or empty text has no words; repeated rows count as often as they occur.
    """
    words = stored(vocabulary(docs, text), "words")
    near = _near(stored(_rows(words, planes(words)), "word-cells"))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus_n") >= 2 * F.col("n"), F.col("best")).alias("best")
    )
    judged = stored(judged.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus_n")).alias("form_n")), "word-forms")
    # a form occurs twice as often, so chains are short; each round makes the steps that are known twice as long
    root = stored(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(root.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        root = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return judged.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
