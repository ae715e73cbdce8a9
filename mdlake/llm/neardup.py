"""Near duplicates by SetSketch registers.

A document is the set of its shingles of five words. Its sketch has 128 registers; register i is 1 - log_b(x), rounded down and
truncated, where x is the smallest of exponential values that a hash gives each shingle. Registers of a union are the larger ones of
two sketches, and two registers agree about as often as the sets' shingles do.

1. Texts become sketches, in place. Equal sets form classes at once, and only one document per class goes on.
2. Bands of four registers put documents into buckets. In a bucket every document is paired with its smallest only.
3. A pair's similarity is estimated from its registers by maximum likelihood. What cannot be similar enough is left out, the rest is
   verified on the full sets.
4. Where a bucket still holds documents of several components, the documents outside the bucket's largest component are
   compared with the others by their registers, in blocks of bounded size, and verified there. Pairs inside a component are not
   compared any more, and only links that join components are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdlake.llm.components import components
from mdlake.llm.words import BY_SPACE, flat, hash_words, lists, mixed, slices
from mdlake.session import stored

SHINGLE = 5
NEEDED = 75  # percent of the union that the intersection must reach
REGISTERS, BAND = 128, 4
BASE, RATE = 1.001, 20.0
SLICE = 2048  # documents of a bucket that one task compares
#: estimates below this are no candidates: 6 standard errors under the needed similarity
LIKELY = NEEDED / 100 - 6 * (0.75 * 0.25 / REGISTERS) ** 0.5
_FLAG_BITS = 22

_FACTORS = (mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLACES = mixed(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; fewer than five words are one shingle, none are none."""
    hashes, counts = hash_words(texts, BY_SPACE)
    if len(hashes) >= SHINGLE:
        n = len(hashes) - SHINGLE + 1
        rolling = mixed(sum((hashes[k : k + n] * _PLACES[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))
    start = 0
    for count in counts.tolist():
        if count >= SHINGLE:
            yield np.unique(rolling[start : start + count - SHINGLE + 1])
        elif count:
            yield mixed((hashes[start : start + count] * _PLACES[:count]).sum(keepdims=True) + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)
        start += count


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set that is not empty."""
    least = np.full((len(sets), REGISTERS), 0xFFFFFFFF, np.uint32)
    for row, own in enumerate(sets):
        high = (own >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), 2048):
            np.minimum(least[row], (high[at : at + 2048, None] * _FACTORS).min(0), out=least[row])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of registers, given the sets' sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    return _likeliest(up, down, a.shape[1] - up - down, n_a, n_b)


def _likeliest(up, down, same, n_a, n_b) -> np.ndarray:
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(np.maximum(more, 1e-12)) + down * np.log(np.maximum(less, 1e-12)) + same * np.log(np.maximum(1 - more - less, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one maximum
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _key(own: np.ndarray) -> bytes | None:
    """128 bits that stand for a set."""
    if not len(own):
        return None
    return mixed(own).sum().tobytes() + np.bitwise_xor.reduce(mixed(own + np.uint64(1))).tobytes()


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, registers, bands): ``key`` stands for the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = list(shingles(batch.column(text)))
            sizes = np.array([len(s) for s in sets], np.int64)
            own = registers(sets)
            bands = mixed(own.view(np.uint64) + mixed(np.arange(own.shape[1] // BAND, dtype=np.uint64)))
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in own], pa.binary()),
                 lists(bands.view(np.int64).ravel(), np.full(len(sets), bands.shape[1]), pa.int64())],
                ["doc_id", "n_shingles", "key", "registers", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, key binary, registers binary, bands array<bigint>"
    )


def _sets(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """(id, shingles) of the documents in ``ids``, and of few others: ids are sent as a table of 2**22 flags, whatever their number."""
    slots = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << _FLAG_BITS)).cast("int").alias("slot")).distinct().toPandas()["slot"]
    flags = np.zeros(1 << _FLAG_BITS, bool)
    flags[slots.to_numpy(np.int64)] = True
    packed = np.packbits(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        for batch in slices(batches, text):
            batch = batch.filter(pa.array(wanted[batch.column("slot").to_numpy()]))
            sets = list(shingles(batch.column(text)))
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(flat, np.array([len(s) for s in sets], np.int64), pa.int64())], ["id", "shingles"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), text)
    return rows.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(1 << _FLAG_BITS))).mapInArrow(run, "id bigint, shingles array<bigint>")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose estimate from the registers is high enough."""
    own = reps.select("id", "registers", "n_shingles")
    joined = pairs.join(own.toDF("a", "registers_a", "n_a"), "a").join(own.toDF("b", "registers_b", "n_b"), "b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * NEEDED  # the intersection is no larger than the smaller set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
            good = estimate(a, b, batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float)) >= LIKELY
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return joined.where(fits).select("a", "b", "registers_a", "registers_b", "n_a", "n_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * NEEDED).select("a", "b")


def _across(shared: DataFrame, found: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect documents of one bucket that are in different components so far.

    The documents outside the bucket's largest component meet the others in blocks of SLICE by SLICE. A block compares them on
    their registers, verifies what is likely on the full sets, and returns only links that join two components, hence
    fewer than it has documents.
    """
    member = shared.where("n > 2").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sizes = member.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = (
        sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("hub"), F.count("*").alias("parts")).where("parts > 1")
        .select("bucket", F.col("hub.component").alias("hub"), *(F.ceil(x / SLICE).cast("int").alias(y) for x, y in ((F.col("n"), "slices"), (F.col("n") - F.col("hub.n"), "blocks"))))
    )
    own = reps.select("id", "registers").join(sets, "id")
    member = member.join(several, "bucket").join(own, "id")
    columns = ["bucket", "id", "component", "registers", "shingles"]

    def place(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    seen = member.select(*columns, place("slices").alias("slice"), every("blocks").alias("block"), F.lit(False).alias("asks"))
    asks = member.where("component <> hub").select(*columns, every("slices").alias("slice"), place("blocks").alias("block"), F.lit(True).alias("asks"))

    def run(group: pa.Table) -> pa.Table:
        id_, part, asking = (group.column(c).to_numpy() for c in ("id", "component", "asks"))
        flat_, size = flat(group.column("shingles"))
        first = np.cumsum(size) - size
        own = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        bucket = np.int64(group.column("bucket")[0].as_py()).view(np.uint64)
        bands = own.view(np.uint64)
        band = int(np.flatnonzero(mixed(bands[0] + mixed(np.arange(bands.shape[1], dtype=np.uint64))) == bucket)[0])
        part, seen, out = part.copy(), np.flatnonzero(~asking), []
        for row in np.flatnonzero(asking):
            to = seen[part[seen] != part[row]]
            small, big = np.minimum(size[to], size[row]), np.maximum(size[to], size[row])
            to = to[small * 100 >= big * NEEDED]  # the intersection is no larger than the smaller set
            to = to[~(bands[to, :band] == bands[row, :band]).any(1)]  # a pair belongs to the first band it shares
            if not len(to):
                continue
            score = estimate(np.repeat(own[row][None], len(to), 0), own[to], np.full(len(to), float(size[row])), size[to].astype(float))
            to = to[np.argsort(-score, kind="stable")[: int((score >= LIKELY).sum())]]
            mine = np.sort(flat_[first[row] : first[row] + size[row]])
            while len(to):  # the likeliest first; what they connect need not be verified any more
                now, to = to[:64], to[64:]
                theirs = np.concatenate([flat_[first[t] : first[t] + size[t]] for t in now])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[now]) - size[now])
                for t in now[common * 100 >= (size[row] + size[now] - common) * NEEDED]:
                    if part[t] != part[row]:
                        out.append((int(id_[row]), int(id_[t])))
                        part[part == part[t]] = part[row]
                to = to[part[to] != part[row]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return seen.union(asks).groupBy("bucket", "slice", "block").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    A null or empty text has no shingles and no links. Rows of one id are one document. A row without an id is linked with equal
    sets only and takes the smallest id among them.
    """
    sketched = stored(sketches(docs, text), "sketches")
    classes = sketched.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"))
    one = sketched.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "n_shingles", "registers", "bands"), "doc_id").alias("r"))
    reps = stored(one.select("r.*"), "sketch-classes")
    entries = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    shared = stored(entries.join(buckets, "bucket"), "sketch-buckets")
    sets = stored(_sets(docs, shared.select("id").distinct(), text), "shingle-sets")

    first = _likely(shared.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), reps)
    links = stored(_verified(first, sets), "links")
    found = components(links)
    more = _across(shared, found, reps, sets)
    found = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))
    of_class = classes.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "doc_id")
    return sketched.select("doc_id", "n_shingles", "key").join(of_class, "key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def distinct_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; rows without an id stay."""
    gone = stored(near_duplicates(docs, text).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
