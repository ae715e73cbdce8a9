"""A Merkle manifest of a table as logs of hash trees in postorder.

Each group of rows (a source) is a tree over its rows' digests: WIDE consecutive nodes have their digest of digests as parent, up to one node.
The groups' roots are the leaves of one more tree. A tree is written as a log: a node stands right behind its last descendant, as if
nodes were appended when they are complete. So the position of a node follows from its level, its index and the number of
leaves alone, and every node of the tree can be addressed without a search.

Builders work on aligned blocks of WIDE ** TIER nodes, TIER levels at a time, so that the largest group is as many tasks as it has
blocks; the roots of blocks are the input of the next tier. A proof is extracted per block as well: the siblings of its nodes are
read from the block's part of the log by their positions, and those above it come from the tier above, once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdlake.session import stored

WIDE, TIER = 16, 3
_BITS = 4
_STEPS = "array<struct<left string, right string>>"
_LOG = "tree string, n bigint, level int, i bigint, pos bigint, digest string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*values: Column) -> Column:
    """SHA-256 in lower-case hex of each value's length in bytes, a colon and the value, or of a dash for null."""
    parts = (F.coalesce(F.concat(F.octet_length(v.cast("string")), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return F.sha2(F.concat(*parts), 256)


def height(n: int) -> int:
    """The level of the root of a tree of ``n`` leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // WIDE), level + 1
    return level


def position(level: int, i: np.ndarray, n: int) -> np.ndarray:
    """Places of nodes in the log of a tree of ``n`` leaves, from 0.

    Before a node stand all nodes below the end of its subtree on lower levels, and on its own level and those above
    the ones that end before its subtree begins.
    """
    i = np.asarray(i, np.int64)
    end = np.minimum((i + 1) << (_BITS * level), n)
    lower = sum((-(-end >> (_BITS * j)) if j else end for j in range(level)), np.zeros_like(i))
    return lower + sum((i >> (_BITS * (j - level)) for j in range(level, height(n) + 1)), np.zeros_like(i))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (tree, ...) with ``i``, the number of a row in its tree by ``order``, and ``n``, the tree's rows.

    Rows are sorted over all partitions and counted per partition, so no tree is one task. Rows that agree in ``order`` are alike.
    """
    by = ["tree", *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").dictionary_encode()
            code = tree.indices.to_numpy()
            new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            before = np.zeros(len(new), np.int64)
            before[0] = seen if tree.dictionary[code[0]].as_py() == last else 0
            size = np.diff(np.append(new, len(code)))
            local = np.arange(len(code)) - np.repeat(new - before, size)
            last, seen = tree.dictionary[code[-1]].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part)), pa.array(local)], [*batch.schema.names, "_part", "_local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(dealt.mapInArrow(run, f"{schema}, _part bigint, _local bigint"), "merkle-rows")
    of = Window.partitionBy("tree")
    counts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_count"))
    starts = counts.select("tree", "_part", (F.sum("_count").over(of.orderBy("_part")) - F.col("_count")).alias("_start"), F.sum("_count").over(of).alias("n"))
    return placed.join(starts, ["tree", "_part"]).select(*rows.columns, (F.col("_start") + F.col("_local")).alias("i"), "n")


def _block(base: int, tier: int) -> Column:
    """The block of a node of a tier that starts at level ``base``."""
    return F.expr(f"shiftright(i, {_BITS} * ({base + tier} - level))")


def _builder(base: int, tier: int):
    """Appends the nodes of a block from level ``base`` on, ``tier`` levels, in the order in which they are complete."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        tree, n = group.column("tree")[0].as_py(), group.column("n")[0].as_py()
        i, digests = group.column("i").to_numpy(), group.column("digest").to_pylist()
        levels = [(base, i, digests)]
        for level in range(base, min(base + tier, height(n))):
            first = np.flatnonzero(np.append(True, (i[1:] >> _BITS) != (i[:-1] >> _BITS))).tolist()
            digests = [_hash("".join(digests[a:b])) for a, b in zip(first, [*first[1:], len(digests)])]
            i = i[first] >> _BITS
            levels.append((level + 1, i, digests))
        level = np.concatenate([np.full(len(x), k, np.int32) for k, x, _ in levels])
        at = np.concatenate([position(k, x, n) for k, x, _ in levels])
        order = np.argsort(at)
        return pa.table({
            "tree": pa.array([tree] * len(at), pa.string()), "n": np.full(len(at), n), "level": level[order], "i": np.concatenate([x for _, x, _ in levels])[order],
            "pos": at[order], "digest": pa.array([d for _, _, x in levels for d in x], pa.string()).take(pa.array(order)),
        })

    return run


def build(nodes: DataFrame, tier: int = TIER) -> list[DataFrame]:
    """The logs of the trees over ``nodes`` (tree, n, i, digest), one table (tree, n, level, i, pos, digest) per ``tier`` levels.

    The log of a tree is the union of the tables; a table's highest level is the next one's lowest and stands in both.
    """
    tiers: list[DataFrame] = []
    nodes = nodes.select("tree", "n", F.lit(0).alias("level"), "i", "digest")
    while True:
        base = tier * len(tiers)
        tiers.append(stored(nodes.groupBy("tree", _block(base, tier).alias("block")).applyInArrow(_builder(base, tier), _LOG), "merkle-log"))
        nodes = tiers[-1].where((F.col("level") == base + tier) & (F.col("n") > 1 << (_BITS * (base + tier)))).drop("pos")
        if nodes.isEmpty():
            return tiers


def roots(tiers: list[DataFrame], tier: int = TIER) -> DataFrame:
    """(tree, n, digest) of the trees' roots: a root is the last node of its log."""
    found = []
    for k, log in enumerate(tiers):
        rows = log.where((F.col("n") <= 1 << (_BITS * tier * (k + 1))) & (F.col("n") > (1 << (_BITS * tier * k) if k else 0)))
        found.append(rows.groupBy("tree", "n").agg(F.max_by("digest", "pos").alias("digest")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _siblings(log: pa.Table, base: int, tier: int, n: int, i: np.ndarray) -> list[list[dict[str, str]]]:
    """For the nodes ``i`` of level ``base`` of one block: on each level of the tier, the digests before and after theirs in their run."""
    at, digests = log.column("pos").to_numpy(), log.column("digest").to_pylist()
    order = np.argsort(at)
    at = at[order]
    steps: list[list[dict[str, str]]] = [[] for _ in range(len(i))]
    for level in range(base, min(base + tier, height(n))):
        own = i >> (_BITS * (level - base))
        last = -(-n >> (_BITS * level)) - 1
        runs = {}
        for run in np.unique(own >> _BITS).tolist():
            nodes = np.arange(run << _BITS, min((run << _BITS) + WIDE - 1, last) + 1)
            runs[run] = [digests[order[k]] for k in np.searchsorted(at, position(level, nodes, n))]
        for step, node in zip(steps, own.tolist()):
            run = runs[node >> _BITS]
            k = node & (WIDE - 1)
            step.append({"left": "".join(run[:k]), "right": "".join(run[k + 1 :])})
    return steps


def _addressed(tiers: list[DataFrame], k: int, outer: DataFrame, tier: int) -> DataFrame:
    """What proofs of tier ``k`` read: the log of each block, and one row per block with the steps above it.

    ``outer`` (tree, n, steps, subroot) has the steps above the trees' roots.
    """
    base = tier * k
    log = tiers[k].where((F.col("level") >= base) & (F.col("level") < base + tier))
    log = log.select("tree", _block(base, tier).alias("block"), "n", "level", "i", "pos", "digest", F.lit(None).cast(_STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"))
    end = outer.where(F.col("n") <= 1 << (_BITS * (base + tier))).where(F.col("n") > (1 << (_BITS * base) if k else 0)).select("tree", F.lit(0).cast("bigint").alias("block"), "n", "steps", "subroot")
    if k + 1 < len(tiers):
        end = end.union(steps(tiers, outer, k + 1, tier).select("tree", F.col("i").alias("block"), "n", "steps", "subroot"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("i", "bigint"), ("pos", "bigint"), ("digest", "string"))]
    return log.union(end.select("tree", "block", "n", *none, "steps", "subroot"))


def _split(group: pa.Table) -> tuple[pa.Table, list, str]:
    """The log of a block, the steps above it and the root of its tree."""
    above = group.column("pos").is_null()
    end = group.filter(above)
    return group.filter(group.column("pos").is_valid()), end.column("steps")[0].as_py(), end.column("subroot")[0].as_py()


def steps(tiers: list[DataFrame], outer: DataFrame, k: int = 0, tier: int = TIER) -> DataFrame:
    """(tree, n, i, steps, subroot) of all nodes of the lowest level of tier ``k``: their siblings from there to the root of all."""
    base = tier * k

    def run(group: pa.Table) -> pa.Table:
        log, end, subroot = _split(group)
        tree, n = log.column("tree")[0].as_py(), log.column("n")[0].as_py()
        i = log.column("i").to_numpy()[log.column("level").to_numpy() == base]
        own = [s + end for s in _siblings(log, base, tier, n, i)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"tree": pa.array([tree] * len(i), pa.string()), "n": np.full(len(i), n), "i": i, "steps": pa.array(own, kind), "subroot": pa.array([subroot] * len(i), pa.string())})

    return _addressed(tiers, k, outer, tier).groupBy("tree", "block").applyInArrow(run, f"tree string, n bigint, i bigint, steps {_STEPS}, subroot string")


def folded(digest: str, path: list[dict[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in path:
        digest = _hash(step["left"] + digest + step["right"])
    return digest


def verified(rows: DataFrame, tier: int = TIER) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of ``rows`` (source, doc_id, leaf, changed).

    Trees are built from ``leaf``; each row is folded to the root from ``changed``, or from its leaf where that is null. Leaves of a source ascend
    by id (null first) and leaf; a null source comes before all others. An empty table has no tree and no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # orders as sources do, null first
    leaves = stored(numbered(rows.select(tree.alias("tree"), "doc_id", "leaf", "changed"), "doc_id", "leaf"), "merkle-leaves")
    tiers = build(leaves.select("tree", "n", "i", F.col("leaf").alias("digest")), tier)
    tops = stored(numbered(roots(tiers, tier).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "digest"), "name"), "merkle-tops")
    top_tiers = build(tops, tier)
    top = roots(top_tiers, tier)
    root = top.first()
    outer = top.select("tree", "n", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("subroot"))
    above = steps(top_tiers, outer, 0, tier).select("i", "steps")
    outer = stored(tops.join(above, "i").select(F.col("name").alias("tree"), F.col("leaves").alias("n"), "steps", F.col("digest").alias("subroot")), "merkle-outer")
    root = root.digest if root else None

    def run(own: pa.Table, group: pa.Table) -> pa.Table:
        log, end, subroot = _split(group)
        found = _siblings(log, 0, tier, log.column("n")[0].as_py(), own.column("i").to_numpy())
        proof, ended = [], []
        for leaf, changed, path in zip(own.column("leaf").to_pylist(), own.column("changed").to_pylist(), found):
            path = path + end
            proof.append(_hash("".join(s["left"] + s["right"] for s in path)))
            ended.append(folded(leaf if changed is None else changed, path))
        return pa.table({
            "doc_id": own.column("doc_id"), "leaf": own.column("leaf"), "subroot": pa.array([subroot] * len(proof), pa.string()), "root": pa.array([root] * len(proof), pa.string()),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(ended, pa.string()), "verified": pa.array([e == root for e in ended], pa.bool_()),
        })

    blocks = leaves.withColumn("level", F.lit(0)).withColumn("block", _block(0, tier)).drop("level")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return blocks.groupBy("tree", "block").cogroup(_addressed(tiers, 0, outer, tier).groupBy("tree", "block")).applyInArrow(
        run, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def tampered(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, changed): the documents' leaves, and what they become if A-Z of every fifth text, by a checksum of its id, turn to lower case."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(fifth, digest_of(*fields, F.translate("text", _UPPER, _LOWER)))
    return docs.select("source", "doc_id", digest_of(*fields, F.col("text")).alias("leaf"), changed.alias("changed"))
