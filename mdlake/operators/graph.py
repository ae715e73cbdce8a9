"""Neighbourhoods and node properties of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdlake.conventions import DEGREE_WEIGHT, OTHER_WEIGHT, USE_CASE_WEIGHT
from mdlake.operators.aggregates import inbound_degree, total_degree
from mdlake.operators.edges import keep_between
from mdlake.operators.filters import visible_nodes
from mdlake.operators.joins import Hot, skew_join
from mdlake.session import stored

WORDS = 16  # of 64 bits in a bitmap of seeds

def graph_nodes(edges: DataFrame, pages: DataFrame) -> DataFrame:
    nodes = pages.select("path", F.col("title").alias("label"), F.col("page_type").alias("type"), "tags")
    return nodes.join(inbound_degree(edges, pages), "path").select(
        "path", "label", "type", "tags", (F.col("inbound") == 0).alias("orphan")
    )


def orphan_pages(edges: DataFrame, pages: DataFrame) -> DataFrame:
    linked = edges.select(F.col("dst").alias("path")).distinct()
    return pages.select("path", "title").join(linked, "path", "left_anti")


def node_weight(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """A base by type plus a share of the root of the degree."""
    nodes = pages.select("path", "page_type").join(total_degree(edges, pages), "path")
    base = F.when(F.col("page_type") == "use-case", USE_CASE_WEIGHT).otherwise(OTHER_WEIGHT)
    return nodes.select("path", (base + DEGREE_WEIGHT * F.sqrt(F.col("degree").cast("double"))).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(at, to): every edge in either direction, once."""
    turned = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(turned).alias("e")).select(F.col("e.src").alias("at"), F.col("e.dst").alias("to")).distinct()


def k_hop(links: DataFrame, seeds: DataFrame, hops: int, hot: Hot | None = None) -> DataFrame:
    """(seed, path, hop): pages within ``hops`` steps along ``links(at, to)`` of each ``seeds(path)``.

    One equi-join per hop; hubs are joined by slices. ``links`` is read once per hop and should be a stored table.
    """
    reached = seeds.select(F.col("path").alias("seed"), "path", F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        at = frontier.select("seed", F.col("path").alias("at"))
        found = skew_join(links, at, "at", "inner", "to", hot=hot).select("seed", F.col("to").alias("path")).distinct()
        fresh = found.join(reached.select("seed", "path"), ["seed", "path"], "left_anti")
        frontier = stored(fresh.withColumn("hop", F.lit(hop)), f"hop{hop}")
        reached = reached.unionByName(frontier)
    return reached


def numbered_seeds(seeds: DataFrame) -> DataFrame:
    """(seed, number): distinct ``seeds(path)`` numbered from 0 without gaps, counted per partition of a range sort."""
    placed = seeds.select(F.col("path").alias("seed")).distinct().repartitionByRange("seed").sortWithinPartitions("seed")
    placed = stored(placed.withColumn("id", F.monotonically_increasing_id()), "seeds")
    part = F.shiftright("id", 33).alias("part")  # the partition is in the upper bits
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row a partition
    number = F.col("start") + F.col("id") - F.shiftleft(F.col("part"), 33)
    return placed.select("*", part).join(starts, "part").select("seed", number.alias("number"))


def _bit_columns(seeds: int) -> list[str]:
    return [f"b{k}" for k in range(min(WORDS, -(-seeds // 64)))]


def k_hop_many(links: DataFrame, seeds: DataFrame, hops: int, hot: Hot | None = None) -> tuple[DataFrame, DataFrame]:
    """The pages within ``hops`` steps of each of many seeds, as bitmaps.

    Returns (seed, number) and (path, hop, block, b0, b1, …): the seeds, 64 * WORDS to a block, that reach a page in ``hop`` steps and not in fewer are
    set bits. A hop joins the rows of the last one with ``links`` and puts bitmaps together by OR, so it has at most a row per page and
    block, however many of the block's seeds meet there.
    """
    numbers = stored(numbered_seeds(seeds), "seed-numbers")
    bits = _bit_columns(max(1, numbers.count()))
    word = F.floor(F.col("number") / 64)
    start = numbers.select(
        F.col("seed").alias("path"), F.lit(0).alias("hop"), F.floor(word / WORDS).alias("block"),
        *(F.when(word % WORDS == k, F.expr("shiftleft(1L, cast(number % 64 as int))")).otherwise(F.lit(0).cast("bigint")).alias(b) for k, b in enumerate(bits)),
    )
    either = [F.bit_or(b).alias(b) for b in bits]
    frontier = stored(start.groupBy("path", "hop", "block").agg(*either), "hop0")
    found, seen = frontier, frontier.drop("hop")
    for hop in range(1, hops + 1):
        at = frontier.select(F.col("path").alias("at"), "block", *bits)
        met = skew_join(links, at, "at", "inner", "to", hot=hot).groupBy(F.col("to").alias("path"), "block").agg(*either)
        known = seen.select("path", "block", *(F.col(b).alias(f"seen_{b}") for b in bits))
        new = [F.expr(f"{b} & ~coalesce(seen_{b}, 0L)").alias(b) for b in bits]
        fresh = met.join(known, ["path", "block"], "left").select("path", F.lit(hop).alias("hop"), "block", *new)
        frontier = stored(fresh.where(" OR ".join(f"{b} <> 0" for b in bits)), f"hop{hop}")
        found = found.unionByName(frontier)
        if hop < hops:
            seen = stored(seen.unionByName(frontier.drop("hop")).groupBy("path", "block").agg(*either), "seen")
    return numbers, found


def reached_pairs(numbers: DataFrame, found: DataFrame) -> DataFrame:
    """(seed, path, hop): what :func:`k_hop_many` found, one row per seed and page."""
    bits = [c for c in found.columns if c.startswith("b") and c != "block"]
    words = F.array(*(F.struct(F.lit(k).alias("k"), F.col(b).alias("bits")) for k, b in enumerate(bits)))
    rows = found.select("path", "hop", "block", F.inline(words)).where("bits <> 0")
    rows = rows.select("path", "hop", "block", "k", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")).alias("i"))
    return rows.select("path", "hop", ((F.col("block") * WORDS + F.col("k")) * 64 + F.col("i")).alias("number")).join(numbers, "number").select("seed", "path", "hop")


def reach_counts(found: DataFrame) -> DataFrame:
    """(path, hop, n_seeds): how many seeds reach a page in ``hop`` steps and not in fewer."""
    bits = [c for c in found.columns if c.startswith("b") and c != "block"]
    return found.groupBy("path", "hop").agg(F.sum(F.expr(" + ".join(f"bit_count({b})" for b in bits))).cast("bigint").alias("n_seeds"))


def edge_highlight(edges: DataFrame, ball: DataFrame, seed: str, hot: Hot | None = None) -> DataFrame:
    """Edges by their place: at the seed, inside the ball, or outside."""
    inside = ball.select(F.col("path").alias("node"), F.lit(True).alias("in_ball")).distinct()
    at_src = skew_join(edges, inside.select(F.col("node").alias("src"), F.col("in_ball").alias("src_in")), "src", "left", "dst", hot=hot)
    both = skew_join(at_src, inside.select(F.col("node").alias("dst"), F.col("in_ball").alias("dst_in")), "dst", "left", "src", hot=hot)
    place = (
        F.when((F.col("src") == seed) | (F.col("dst") == seed), "incident")
        .when(F.col("src_in") & F.col("dst_in"), "inside")
        .otherwise("outside")
    )
    return both.select("src", "dst", place.alias("place"))


def visible_subgraph(edges: DataFrame, pages: DataFrame, hot: Hot | None = None, **conditions) -> DataFrame:
    """Edges between visible pages."""
    return keep_between(edges, visible_nodes(pages, **conditions), hot)
