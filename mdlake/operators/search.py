"""Full-text search over the four page fields, scored by BM25+ per field.

An index has four tables. Postings lie in blocks, one per term, field and part of the documents, with the largest contribution of
any of them; parts are of about PART documents, by a hash. The vocabulary has a term's document count per field, and neighbours are keys
that a term shares with all terms that few edits away.

A query's words are matched against the vocabulary and the neighbours, never against postings. All matching documents are scored by
:func:`search`. :func:`best` returns the best ones only: a part's bound is the weighted sum of its blocks' largest contributions;
parts with the highest bounds are scored first, and then those whose bound reaches the lowest score that is found.

An index that serves known queries only (``build_index(docs, queries)``) holds the postings of the terms that a word of theirs can match, by the
kinds of match that are asked for. They are cut out of a text by one pattern, and the other terms are only counted, not split off. Lengths and
numbers of documents are those of the whole texts, so scores are the same.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.functions.columns import once
from mdlake.operators.projections import provenance
from mdlake.session import stored

# Published BM25+ parameters and the weights of the search options.
K1, B, DELTA = 1.2, 0.7, 0.5
TITLE_BOOST = 2.0
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45
FUZZY_SHARE = 0.2
TOP = 30
PART = 128  # documents of a part, on average
GROUP = 1 << 20  # documents that one task of the build takes for the terms of a bucket
BUCKET = 50_000  # postings of a bucket within such a group, or keys of a bucket of neighbours, on average
LISTED = 1000  # terms or parts that are named in a scan's filter; more of them meet the table in a join
EDITS = 2  # up to so many edits are found by deletions, more by pieces
IN_TERM = r"\p{L}\p{N}"
SEPARATORS = rf"[^{IN_TERM}]+"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS, -1), lambda t: t != "")


def _field_texts(search_docs: DataFrame, name: str, of: Callable[[Column], Column]) -> DataFrame:
    """(doc, field, ``name``): what is made of each field's text, one row per document and field."""
    texts = {
        "title": F.col("title"), "body": F.col("body"),
        "tags": F.array_join("tags", " "), "category": F.col("category"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), of(t).alias(name)) for n, t in texts.items()])
    return search_docs.select(F.col("id").alias("doc"), F.inline(pairs).alias("field", name))


def field_terms(search_docs: DataFrame) -> DataFrame:
    """(doc, field, terms): one row per document and field."""
    return _field_texts(search_docs, "terms", _terms)


def tokens(search_docs: DataFrame) -> DataFrame:
    """(doc, field, pos, term): every occurrence."""
    return field_terms(search_docs).select("doc", "field", F.posexplode("terms").alias("pos", "term"))


def _n_terms(text: Column) -> Column:
    """How many terms a text has, without an array of them: each becomes one character, and one more term ends the last separators."""
    ended = F.concat(text, F.lit(" a"))
    return F.length(F.regexp_replace(ended, rf"[^{IN_TERM}]*+[{IN_TERM}]++", "-")) - 1


def _by_letter(text: Column) -> Column:
    """A text that can be lower-cased term by term: what becomes of these two letters is more than one, or depends on those around them."""
    return F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u03a3")), F.lower(text)).otherwise(text)


@cache
def _capitals() -> dict[str, str]:
    """Per letter, the letters that it is the lower case of."""
    found: dict[str, str] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.lower() != c:
            found[c.lower()] = found.get(c.lower(), "") + c
    return found


def _candidates(text: Column, words: frozenset[str], fuzzy: bool) -> Column:
    """The terms that hold one of the :func:`_pieces` of the words, in lower case. What stands behind a letter is no start of a term."""
    pieces = sorted({p for word in words for p in _pieces(word, fuzzy)})
    if not pieces:
        return F.array().cast("array<string>")
    either = "|".join("".join(f"[{c}{_capitals().get(c, '')}]" for c in p) for p in pieces)
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![{IN_TERM}])(?=[{IN_TERM}]*?(?:{either}))[{IN_TERM}]++"), F.lit(0)), F.lower)


def counted_terms(search_docs: DataFrame, words: frozenset[str] | None = None, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """(doc, field, field_len, found): the terms of a field, or those that one of ``words`` can match, with their counts, without a shuffle.

    All occurrences of a term in a field stand in one row, so they are counted there: the terms are sorted, and every run of equal
    terms is one. A field without terms is a row too.
    """
    if words is None:
        rows = once(field_terms(search_docs), run=F.sort_array("terms"), field_len=F.size("terms"))
    else:
        texts = _field_texts(search_docs, "text", _by_letter)
        kept = F.filter(_candidates(F.col("text"), words, fuzzy), lambda t: _can_match(t, words, prefix, fuzzy))
        rows = once(texts, run=F.sort_array(kept), field_len=_n_terms(F.col("text")))
    here = F.when(F.size("run") > 0, F.sequence(F.lit(0), F.size("run") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(here, lambda i: (i == 0) | (F.get("run", i) != F.get("run", i - 1)))
    rows = once(rows, start=starts)
    ends = F.when(F.size("run") > 0, F.concat(F.filter("start", lambda i: i > 0), F.array(F.size("run")))).otherwise(F.col("start"))
    found = F.zip_with(
        "start", ends, lambda a, b: F.struct(F.get("run", a).alias("term"), (b - a).alias("tf"))
    )
    return once(rows, found=found).select("doc", "field", "field_len", "found")


def _postings(counted: DataFrame) -> DataFrame:
    return counted.select("doc", "field", "field_len", F.explode("found").alias("p")).select("p.term", "field", "doc", "p.tf", "field_len")


def inverted_index(search_docs: DataFrame) -> DataFrame:
    """(term, field, doc, tf, field_len)."""
    return _postings(counted_terms(search_docs))


@dataclass
class Index:
    """The tables of an index, and per field the number of documents and their mean length."""

    blocks: DataFrame  # (term, field, part, n, most, entries, bucket)
    vocabulary: DataFrame  # (term, field, df)
    neighbours: DataFrame  # (key, term, fields, bucket)
    fields: DataFrame  # (field, docs, avg_len, buckets, key_buckets)
    words: frozenset[str] | None = None  # what may be asked for, if not everything
    prefix: bool = True  # by these kinds of match, besides the exact one
    fuzzy: bool = True

    def __post_init__(self):
        rows = self.fields.collect()  # one row per field
        self.stats = {r.field: (r.docs, r.avg_len) for r in rows}
        self.buckets, self.key_buckets = (rows[0].buckets, rows[0].key_buckets) if rows else (1, 1)


def _of_field(stats: dict[str, tuple[int, float]], place: int) -> Column:
    """One of a field's numbers."""
    return F.coalesce(*(F.when(F.col("field") == f, F.lit(float(v[place]))) for f, v in stats.items()), F.lit(None).cast("double"))


def _contribution(stats: dict[str, tuple[int, float]]) -> Column:
    """What a posting adds to the score, before weights."""
    tf, length = F.col("tf"), F.col("field_len") / _of_field(stats, 1)
    return DELTA + tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))


def _bucket(of: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def _blocks(counted: DataFrame, stats: dict[str, tuple[int, float]], docs: int, buckets: int) -> DataFrame:
    """Postings by bucket and group of documents, so that a frequent term is many tasks, and by term within."""
    parts = max(1, ceil(docs / PART))
    rows = _postings(counted).withColumn("contribution", _contribution(stats))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts))).withColumn("bucket", _bucket(F.col("term"), buckets))
    rows = rows.withColumn("group", F.floor(F.col("part") / F.lit(max(1, GROUP // PART)))).repartition("bucket", "group")
    blocks = rows.groupBy("bucket", "group", "term", "field", "part").agg(
        F.count("*").alias("n"), F.max("contribution").alias("most"), F.collect_list(F.struct("doc", "tf", "field_len")).alias("entries")
    )
    return blocks.drop("group").sortWithinPartitions("bucket", "term", "field", "part")


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def _deletions(words: Column) -> Column:
    """What is left of words without one letter, for an array of words."""
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda i: _without(w, i))))


def _shortest(edits: int) -> int:
    """The length of the shortest word for which that many edits are allowed."""
    return next(n for n in range(1000) if _reach(n) >= edits)


def _reach(n: int) -> int:
    """How many edits are allowed for a word of ``n`` letters."""
    return int(FUZZY_SHARE * n + 0.5)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(key, term, fields): keys that a term shares with every word that it is a fuzzy match of; ``fields`` are its (field, df).

    Words at most EDITS edits apart have a common rest after as many deletions from each. With more edits r, which longer words are
    allowed, one of r + 1 pieces of the word stands unchanged in the term, at most r letters from its place: keys are all
    three letters of a term with their place.
    """
    terms = vocabulary.groupBy("term").agg(F.collect_list(F.struct("field", "df")).alias("fields"))
    n, itself = F.length("term"), F.array("term")
    one = F.array_distinct(_deletions(itself))
    least = [_shortest(r) - r for r in range(EDITS + 2)]  # a term may be so short and be within r edits of a word
    last = _shortest(EDITS + 1) - 1 + EDITS  # and so long
    short = F.when(n < least[1], F.array().cast("array<string>")).when(n < least[2], F.concat(itself, one)).when(n <= last, F.concat(itself, one, _deletions(one)))
    places = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), F.substring("term", i + 1, F.lit(3))))
    long = F.when(n >= least[EDITS + 1], places)
    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.transform(F.concat(F.coalesce(short, none), F.coalesce(long, none)), lambda k: F.xxhash64(k)))
    return once(terms, keys=keys).select(F.explode("keys").alias("key"), "term", "fields")


def _keys(word: str) -> list[str]:
    """The keys that a query word shares with its fuzzy matches."""
    r = _reach(len(word))
    if r > EDITS:
        cuts = [len(word) * k // (r + 1) for k in range(r + 1)]
        return list(dict.fromkeys(f"\n{at}\n{word[c : c + 3]}" for c in cuts for at in range(max(0, c - r), c + r + 1)))
    rests = {word}
    for _ in range(r):
        rests |= {w[:i] + w[i + 1 :] for w in rests for i in range(len(w))}
    return sorted(rests)


def build_index(search_docs: DataFrame, queries: tuple[str, ...] | None = None, prefix: bool = True, fuzzy: bool = True) -> Index:
    """Write the index tables to the shared folder; the texts are read once.

    With ``queries``, the index serves their words only, and of them only the kinds of match that are named.
    """
    words = None if queries is None else frozenset(w for q in queries for w in query_terms(q))
    counted = stored(counted_terms(search_docs, words, prefix, fuzzy), "counted-terms")
    # one row per field, and in each every document is counted
    totals = counted.groupBy("field").agg(F.count("*").alias("docs"), F.sum("field_len").alias("length"), F.sum(F.size("found")).alias("postings")).collect()
    docs, postings = max((r.docs for r in totals), default=0), sum(r.postings for r in totals)
    stats = {r.field: (docs, r.length / docs) for r in totals if r.length}
    buckets = max(1, ceil(postings / BUCKET / max(1, ceil(docs / GROUP))))
    blocks = stored(_blocks(counted, stats, docs, buckets), "postings", "bucket")
    vocabulary = stored(blocks.groupBy("term", "field").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term"), "vocabulary")
    near = neighbours(vocabulary)
    terms = vocabulary.count()
    key_buckets = max(1, ceil(40 * terms / (20 * BUCKET)))  # about 40 keys a term
    near = near.withColumn("bucket", F.pmod("key", F.lit(key_buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "key")
    near = stored(near, "neighbours", "bucket")
    schema = "field string, docs bigint, avg_len double, buckets int, key_buckets int"
    fields = search_docs.sparkSession.createDataFrame([(f, n, mean, buckets, key_buckets) for f, (n, mean) in stats.items()], schema)
    return Index(blocks, vocabulary, near, stored(fields, "fields"), words, words is None or prefix, words is None or fuzzy)


def save_index(index: Index, path: str) -> None:
    if index.words is not None:
        raise ValueError("an index of known queries serves the application that built it")
    for name, table, order in (("blocks", index.blocks, ("term", "field", "part")), ("neighbours", index.neighbours, ("key",))):
        table.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.fields.write.mode("overwrite").parquet(f"{path}/fields")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("blocks", "vocabulary", "neighbours", "fields")])


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, split like the texts."""
    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in query.lower()).split()
    return list(dict.fromkeys(words))


def _weight(term: Column, word: str, prefix: bool, fuzzy: bool) -> Column:
    """What a query word gives a term, NULL without a match."""
    n = F.length(term)
    found = [F.when(term == word, 1.0)]
    if prefix:
        far = (n - len(word)).cast("double")
        found.append(F.when(F.startswith(term, F.lit(word)), PREFIX_WEIGHT * n / (n + 0.3 * far)))
    reach = _reach(len(word))
    if fuzzy and reach:
        # the distance is only computed in the band of lengths it can be met in
        far = F.when(F.abs(n - len(word)) <= reach, F.levenshtein(term, F.lit(word), reach))
        found.append(F.when(far >= 0, FUZZY_WEIGHT * n / (n + far)))
    # exact beats prefix beats fuzzy
    return F.coalesce(*found)


def _pieces(word: str, fuzzy: bool) -> list[str]:
    """Strings one of which stands in every term that the word can match: each edit changes one of them at most."""
    parts = _reach(len(word)) + 1 if fuzzy else 1
    cuts = [len(word) * k // parts for k in range(parts + 1)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def _can_match(term: Column, words: frozenset[str], prefix: bool = True, fuzzy: bool = True) -> Column:
    """Does any of the words give the term a weight, by one of these kinds of match?"""
    hit = F.lit(False)
    for word in sorted(words):
        hit = hit | (F.startswith(term, F.lit(word)) if prefix else term == word)
        reach = _reach(len(word))
        if fuzzy and reach:
            pieces = [F.contains(term, F.lit(p)) for p in _pieces(word, fuzzy)]
            near = F.abs(F.length(term) - len(word)) <= reach
            hit = hit | (reduce(Column.__or__, pieces) & near & (F.levenshtein(term, F.lit(word), reach) >= 0))
    return hit


def expand(index: Index, query: str, prefix: bool = False, fuzzy: bool = False) -> DataFrame:
    """(term, field, df, weight): vocabulary terms that match, best weight per query term.

    Exact and prefix matches are a range of the sorted vocabulary. Fuzzy ones come from the keys they share with a query word; only
    for terms with a common key is an edit distance computed.
    """
    term, words = F.col("term"), query_terms(query)
    known = getattr(index, "words", None)
    if known is not None and not known.issuperset(words):
        raise ValueError(f"the index was built for other words: {sorted(set(words) - known)}")
    if (prefix and not getattr(index, "prefix", True)) or (fuzzy and not getattr(index, "fuzzy", True)):
        raise ValueError("the index was built for other kinds of match")
    if not words:
        return index.vocabulary.where("false").withColumn("weight", F.lit(0.0))
    plain = term.isin(*words)
    for word in words if prefix else ():
        plain = plain | F.startswith(term, F.lit(word))
    matched = index.vocabulary.where(plain)
    keys = [k for word in words if fuzzy and _reach(len(word)) for k in _keys(word)]
    if keys:
        hashes = [F.xxhash64(F.lit(k)) for k in dict.fromkeys(keys)]
        near = index.neighbours.where(F.col("bucket").isin(*(F.pmod(h, F.lit(index.key_buckets)).cast("int") for h in hashes)) & F.col("key").isin(*hashes))
        near = near.where(~plain).select("term", "fields").groupBy("term").agg(F.any_value("fields").alias("fields"))
        matched = matched.union(near.select("term", F.inline("fields")))
    weights = F.array_compact(F.array(*[_weight(term, w, prefix, fuzzy) for w in words]))
    return matched.withColumn("weight", F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)).where("weight > 0")


def _lists(index: Index, expansion: DataFrame) -> DataFrame:
    """The blocks of the expanded terms with the terms' weights ``w``.

    Up to LISTED terms are named in the scan, which then reads their buckets and row groups only. More of them are joined.
    """
    boost = F.when(F.col("field") == "title", TITLE_BOOST).otherwise(1.0)
    docs = _of_field(index.stats, 0)
    idf = F.ln(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    spark = expansion.sparkSession
    few = expansion.limit(LISTED + 1).collect()
    if not few:
        return index.blocks.where("false").withColumn("w", F.lit(0.0))
    if len(few) <= LISTED:
        expansion = spark.createDataFrame(few, expansion.schema)
    weighted = expansion.select("term", "field", (F.col("weight") * boost * idf).alias("w")).where("w > 0")
    if len(few) > LISTED:
        weighted = stored(weighted.withColumn("bucket", _bucket(F.col("term"), index.buckets)), "expansion")
        return index.blocks.join(weighted, ["bucket", "term", "field"])
    terms = sorted({r.term for r in few})
    own = index.blocks.where(F.col("bucket").isin(*(_bucket(F.lit(t), index.buckets) for t in terms)) & F.col("term").isin(*terms))
    return own.join(F.broadcast(weighted), ["term", "field"])  # at most LISTED rows


def _scored(index: Index, lists: DataFrame) -> DataFrame:
    """(doc, score) of the documents in blocks."""
    hits = lists.select("field", "w", F.inline("entries"))
    return hits.groupBy("doc").agg(F.sum(F.col("w") * _contribution(index.stats)).alias("score"))


def search(index: Index, query: str, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """(doc, score) of all documents that hold a matching term."""
    return _scored(index, _lists(index, expand(index, query, prefix, fuzzy)))


def top(scored: DataFrame, n: int = TOP) -> DataFrame:
    """The best ``n``, ties by path."""
    return scored.orderBy(F.desc(F.round("score", 6)), "doc").limit(n)


@dataclass
class Best:
    """The best documents (doc, score), and how many of the postings of the query's terms were read for them."""

    hits: DataFrame
    postings: int
    read: int


def best(index: Index, query: str, n: int = TOP, prefix: bool = True, fuzzy: bool = True) -> Best:
    """The same as the :func:`top` of :func:`search`, from the parts of the documents that can hold them."""
    lists = _lists(index, expand(index, query, prefix, fuzzy))
    bounds = lists.groupBy("part").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.sum("n").alias("n"))
    total = bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = bounds.orderBy(F.desc("bound"), "part").limit(n).collect()
    scored = _scored(index, lists.where(F.col("part").isin(*(r.part for r in first))))
    found = top(scored, n).collect()  # n rows
    # scores that are equal to six places are ordered by path, so a bound may fall short by that much
    least = found[-1].score - 2e-6 if len(found) == n else 0.0
    seen = F.col("part").isin(*(r.part for r in first))
    more = bounds.where((F.col("bound") >= least) & ~seen)
    few = more.limit(LISTED + 1).collect()
    read = sum(r.n for r in first)
    if not few:
        spark = lists.sparkSession
        return Best(top(spark.createDataFrame(found, scored.schema), n), total, read)
    if len(few) <= LISTED:
        rest = lists.where(F.col("part").isin(*(r.part for r in few)))
        read += sum(r.n for r in few)
    else:
        rest = lists.join(more.select("part"), "part", "left_semi")
        read += more.agg(F.sum("n")).first()[0]
    # a document's postings are all in one part, so its score is from one side
    return Best(top(scored.union(_scored(index, rest)), n), total, read)


def search_hits(scored: DataFrame, pages: DataFrame, n: int = TOP) -> DataFrame:
    """The best ``n`` with title, category and provenance."""
    best = top(scored, n)
    # n rows
    near = pages.select(F.col("path").alias("doc"), "title", "category", provenance().alias("provenance")).join(
        F.broadcast(best.select("doc")), "doc", "left_semi"
    )
    return best.join(near, "doc", "left")
