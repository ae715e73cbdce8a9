"""URL filters: host and path rules, and a ratio of character models for what no rule decides.

Two smoothed Markov models of variable order, one of URLs that the rules accept and
one of those they block, are counted from the URLs themselves. A context of two characters is
interpolated with one of one and of none, each with the weight of what was seen of it.
A URL is judged by the difference of its log-likelihoods per character.

Everything is DataFrame work. URLs are reduced to an alphabet of 40 symbols, so that
the models are a table of 40**3 cells whatever the data; it becomes one constant that
every row is scored against in place. No row moves for scoring.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.llm.tables import free_name

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "0./-_?=&:%#"
SYMBOLS = 40  # 0: start and end, 1: any other character, then the alphabet; digits are one symbol
_WEIGHT = 5.0  # pseudo-counts of the shorter context
STEPS = 1000  # log ratios are kept to a thousandth
BLOCK_SHARE = 0.02  # of accepted held-out URLs that the threshold lets be blocked, at most


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """A null URL or one without :// has an empty host and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. Of equally long ones, the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, of_host, of_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last that fits stays
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        name = F.when(fits, F.lit(of_host + of_path)).otherwise(name)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """The URL as an array of symbols between two of start and one of end."""
    plain = F.translate(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "123456789", "000000000")
    codes = F.transform(F.split(plain, ""), lambda c: F.when(c == "", -1).otherwise(F.position(c, F.lit(_ALPHABET)) + 1))
    return F.concat(F.array(F.lit(0), F.lit(0)), F.filter(codes, lambda s: s > 0), F.array(F.lit(0)))


def cells(s: Column) -> Column:
    """The cell (two symbols of context and the next) of each position."""
    return _let(
        s,
        lambda s: F.transform(
            F.sequence(F.lit(0), F.size(s) - 3), lambda i: (F.get(s, i) * SYMBOLS + F.get(s, i + 1)) * SYMBOLS + F.get(s, i + 2)
        ),
    )


def ratio_table(labelled: DataFrame) -> DataFrame:
    """One row, one array: log P(accepted) - log P(blocked) of each of the SYMBOLS**3 cells.

    ``labelled`` has (cells, verdict). P(c|ab) = (n(abc) + w P(c|b)) / (n(ab) + w), and so on down to a uniform model.
    """
    counted = (
        labelled.select(F.explode("cells").alias("cell"), "verdict").groupBy("cell")
        .agg(*(F.count(F.when(F.col("verdict") == v, 1)).cast("double").alias(v) for v in ("allow", "block")))
    )  # at most SYMBOLS**3 rows, as all that follows
    every = labelled.sparkSession.range(SYMBOLS**3).select(F.col("id").cast("int").alias("cell"))
    table = every.join(counted, "cell", "left").select(
        "cell", (F.col("cell") % SYMBOLS).alias("c"), (F.floor(F.col("cell") / SYMBOLS) % SYMBOLS).alias("b"), F.floor(F.col("cell") / SYMBOLS**2).alias("a"),
        *(F.coalesce(v, F.lit(0.0)).alias(v) for v in ("allow", "block")),
    )

    def totals(*keys):
        return table.groupBy(*keys).agg(*(F.sum(v).alias(f"{v}_{''.join(keys)}") for v in ("allow", "block")))

    for keys in (("c",), ("b",), ("b", "c"), ("a", "b")):
        table = table.join(totals(*keys), list(keys))
    whole = totals().first()

    def model(v: str) -> Column:
        none = (F.col(f"{v}_c") + _WEIGHT / SYMBOLS) / (float(whole[f"{v}_"] or 0) + _WEIGHT)
        one = (F.col(f"{v}_bc") + _WEIGHT * none) / (F.col(f"{v}_b") + _WEIGHT)
        return F.log((F.col(v) + _WEIGHT * one) / (F.col(f"{v}_ab") + _WEIGHT))

    ratio = (model("allow") - model("block")).alias("ratio")
    ordered = F.sort_array(F.collect_list(F.struct("cell", ratio)))
    return table.agg(F.transform(ordered, lambda r: r["ratio"]).alias("table"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the log-likelihood difference per character).

    The longest fitting rule decides. Of the URLs a rule decides, nine tenths (by a hash of the key and URL) train the models;
    on the rest the threshold is set, at or below 0, so that at most BLOCK_SHARE of the accepted would be blocked.
    Without a rule, a URL below the threshold is blocked. Null URLs and those without any training are allowed.
    """
    host, path = host_and_path(F.col(url))
    names = [free_name(pages, n) for n in ("host", "path", "rule", "verdict", "score")]
    ruled_as, tenth = free_name(pages, "_ruled"), free_name(pages, "_tenth")
    split = pages.select("*", host.alias(names[0]), path.alias(names[1]))
    rule, verdict = rule_columns(F.col(names[0]), F.col(names[1]), RULES if rules is None else rules)
    ruled = split.select("*", rule.alias(names[2]), verdict.alias(ruled_as), F.pmod(F.xxhash64(key, url), F.lit(10)).alias(tenth))
    labelled = ruled.where(F.col(ruled_as).isNotNull())
    table = ratio_table(labelled.where(F.col(tenth) > 0).select(cells(symbols(F.col(url))).alias("cells"), F.col(ruled_as).alias("verdict")))
    steps = np.rint(np.array(table.first()["table"]) * STEPS) + 32768
    ratios = F.lit(steps.clip(0, 65535).astype(">u2").tobytes())  # one constant of two bytes per cell

    def ratio_of(cell: Column) -> Column:
        return (F.conv(F.hex(F.substring(ratios, cell * 2 + 1, F.lit(2))), 16, 10).cast("double") - 32768) / STEPS

    def scored(df: DataFrame) -> DataFrame:
        mean = _let(cells(symbols(F.col(url))), lambda own: F.aggregate(own, F.lit(0.0), lambda sum_, cell: sum_ + ratio_of(cell)) / F.size(own))
        return df.select("*", F.explode(F.array(mean)).alias(names[4]))  # a one-row generator: not computed again for the verdict

    held_out = scored(labelled.where((F.col(tenth) == 0) & (F.col(ruled_as) == "allow"))).agg(F.percentile_approx(names[4], BLOCK_SHARE, 10_000)).first()[0]
    least = min(0.0, held_out) if held_out is not None else 0.0
    blocked = F.col(url).isNotNull() & (F.col(names[4]) < least)
    return scored(ruled).select(
        *pages.columns, *names[:3], F.coalesce(ruled_as, F.when(blocked, "block").otherwise("allow")).alias(names[3]), names[4]
    )
