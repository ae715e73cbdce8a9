"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.llm import decontaminate, knn, lm, merkle, neardup, pii, secrets, sentencepieces, spelling, substrings, toxicity, urls, warc
from mdlake.llm.tables import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity", "grade", "p_toxic", (F.col("p_toxic") >= model.limit).alias("rejected"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents"), ["doc_id"]))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), ["doc_id"], verify=True)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.top_products(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"]))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.tampered(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_topk": op5_topk,
    "op6_urls": op6_urls,
    "op7_decontamination": op7_decontamination,
    "op8_lm": op8_lm,
    "op9_neardup": op9_neardup,
    "op10_secrets": op10_secrets,
    "op11_substrings": op11_substrings,
    "op12_spelling": op12_spelling,
    "op13_manifest": op13_manifest,
}



def _crc32(codes: str) -> str:
    """SQL for the unsigned CRC-32 of a list of byte values, taken bit by bit."""
    bits = f"flatten(list_transform({codes}, lambda b: list_transform(range(0, 8), lambda k: (b >> k) & 1)))"
    step = "lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), {step}), 4294967295)"


_UTF8 = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str) -> str:
    """SQL for the words of ``text`` in lower case."""
    return f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{pattern}')"

ORACLE: dict[str, str] = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY sha1(h)) AS top FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, (k // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM x
    """,
    "op7_decontamination": f"""
        WITH d AS (SELECT doc_id, {_words(_LETTERED)} AS w FROM documents),
        b AS (SELECT item_id, {_words(_LETTERED)} AS w FROM benchmark),
        bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS i, w FROM b WHERE len(w) > 0),
        bk AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM bw),
        dw AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM d JOIN (SELECT DISTINCT n FROM bk) ON len(w) >= n),
        dk AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k FROM dw),
        m AS (SELECT doc_id, n, i, item_id FROM dk JOIN bk USING (n, k)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
        it AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op9_neardup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACED)} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, sha256(array_to_string(w[i + 1 : i + 5], ' ')) AS k
            FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met.n >= 75 * (x.n + y.n - met.n)),
        reach AS (SELECT doc_id AS id, doc_id AS far FROM d UNION SELECT id, b FROM reach JOIN link ON a = far),
        c AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d JOIN c ON c.id = doc_id LEFT JOIN n USING (doc_id)
    """,
    "op11_substrings": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(range(0, len(w) - 19)) AS pos, w FROM d WHERE len(w) >= 20
        ), k AS (
            SELECT doc_id, pos, sha256(array_to_string(w[pos + 1 : pos + 20], ' ')) AS k FROM s
        ), later AS (
            SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM k) WHERE n > 1
        ), gone AS (
            SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 20)) AS p FROM later) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
            sha256(array_to_string(CASE WHEN gone IS NULL THEN w
                ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: w[i]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op12_spelling": f"""
        WITH RECURSIVE t AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents
        ), c AS (SELECT id, run, count(*) AS n FROM t WHERE length(run) >= 5 GROUP BY ALL),
        h AS (SELECT run, n, {_crc32(_UTF8.format("id || run"))} AS h FROM c),
        r AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        less AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM v)),
        near AS (
            SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
            UNION SELECT less.word, v.word, v.n FROM less JOIN v ON less.rest = v.word
            UNION SELECT v.word, less.word, less.n FROM less JOIN v ON less.rest = v.word
        ), best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
        one AS (SELECT b.word, b.n_near, b.most, min(near.near) AS near FROM best b JOIN near ON near.word = b.word AND near.n = b.most GROUP BY ALL),
        f AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN near END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n
            FROM v LEFT JOIN one USING (word)
        ), up AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT up.word, f.form, far + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, far) AS root FROM up GROUP BY word) USING (word)
    """,
    "op13_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format("text")} AS leaf,
                CASE WHEN {_crc32(_UTF8.format("CAST(doc_id AS VARCHAR)"))} % 5 = 0 THEN {_LEAF.format(_LOWER.format("text"))} ELSE {_LEAF.format("text")} END AS changed FROM documents
        ), l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        t AS (
            SELECT tree, 0 AS level, list(leaf ORDER BY i) AS nodes FROM l GROUP BY tree
            UNION ALL
            SELECT tree, level + 1, list_transform(range(0, len(nodes), 16), lambda k: sha256(array_to_string(nodes[k + 1 : k + 16], ''))) FROM t WHERE len(nodes) > 1
        ), s AS (SELECT tree, nodes[1] AS digest, row_number() OVER (ORDER BY tree) - 1 AS i FROM t WHERE len(nodes) = 1),
        u AS (
            SELECT 0 AS level, list(digest ORDER BY i) AS nodes FROM s
            UNION ALL
            SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda k: sha256(array_to_string(nodes[k + 1 : k + 16], ''))) FROM u WHERE len(nodes) > 1
        ), runs AS (
            SELECT tree, level, unnest(range(0, len(nodes), 16)) // 16 AS run, nodes FROM t WHERE len(nodes) > 1
        ), cut AS (SELECT tree, level, run, nodes[run * 16 + 1 : run * 16 + 16] AS ds FROM runs),
        low AS (
            SELECT l.tree, l.i, list({{'l': array_to_string(ds[1 : (l.i >> (4 * level)) & 15], ''), 'r': array_to_string(ds[((l.i >> (4 * level)) & 15) + 2 :], '')}} ORDER BY level) AS steps
            FROM l JOIN cut ON cut.tree = l.tree AND cut.run = l.i >> (4 * level + 4) GROUP BY ALL
        ), high AS (
            SELECT s.tree, list({{'l': array_to_string(nodes[(s.i >> (4 * level + 4)) * 16 + 1 : s.i >> (4 * level)], ''),
                'r': array_to_string(nodes[(s.i >> (4 * level)) + 2 : (s.i >> (4 * level + 4)) * 16 + 16], '')}} ORDER BY level) AS steps
            FROM s JOIN u ON len(nodes) > 1 GROUP BY s.tree
        ), p AS (
            SELECT doc_id, leaf, changed, s.digest AS subroot, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
            FROM l JOIN s USING (tree) LEFT JOIN low ON low.tree = l.tree AND low.i = l.i LEFT JOIN high ON high.tree = l.tree
        ), f AS (
            SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root,
                sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) AS proof_sha256,
                list_reduce(list_prepend({{'l': changed, 'r': ''}}, steps), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
            FROM p
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
    """,
}
