"""One SQL text per query."""

from __future__ import annotations

from oracle.base import AS_OF, BASE

_SELECTS: dict[str, str] = {}


def _add(**selects: str) -> None:
    _SELECTS.update(selects)


_LIST_OF_KINDS = """
  SELECT path, 'title' AS field, fm_title AS value FROM parts WHERE is_page AND fm_title IS NOT NULL
  UNION ALL SELECT path, 'category', category FROM parts WHERE is_page AND category IS NOT NULL
  UNION ALL SELECT path, 'status', status FROM parts WHERE is_page
  UNION ALL SELECT path, 'owner', owner FROM parts WHERE is_page
  UNION ALL SELECT path, 'created', created::VARCHAR FROM parts WHERE is_page
  UNION ALL SELECT path, 'last_reviewed', last_reviewed::VARCHAR FROM parts WHERE is_page AND last_reviewed IS NOT NULL
  UNION ALL SELECT path, 'source', source FROM parts WHERE is_page AND source IS NOT NULL
  UNION ALL SELECT path, f, CASE f WHEN 'title' THEN title WHEN 'type' THEN kind WHEN 'category' THEN 'Entities & Concepts'
      WHEN 'status' THEN 'Active' WHEN 'owner' THEN 'team-' || n % 10 WHEN 'created' THEN '2024-01-01'
      ELSE (DATE '2024-06-01' + CAST(n % 100 AS INTEGER))::VARCHAR END
  FROM ents, (VALUES ('title'), ('type'), ('category'), ('status'), ('owner'), ('created'), ('last_reviewed')) v(f)
  UNION ALL SELECT path, f, CASE f WHEN 'type' THEN 'concept' WHEN 'category' THEN 'Meta notes' END
  FROM notes, (VALUES ('type'), ('category'), ('source'), ('status')) v(f)
"""

_add(
    scan_documents="SELECT path, length(text)::INT AS n_chars, md5(text) AS digest FROM doc",
    scan_excluded="SELECT path FROM ptext UNION ALL SELECT path FROM ents UNION ALL SELECT path FROM notes",
    frontmatter=_LIST_OF_KINDS,
    body_split="""
      SELECT path, length(body)::INT AS n_chars, md5(body) AS digest FROM (
        SELECT path, body FROM pbody
        UNION ALL SELECT path, CASE k % 212 WHEN 0 THEN E'\\n' || body WHEN 53 THEN front || E'\\n' || body ELSE body END FROM ptext WHERE k % 53 = 0
        UNION ALL SELECT path, head || body FROM stext
        UNION ALL SELECT path, E'Not a page.\\n' FROM xtext)""",
    page_table="""
      SELECT path, title, page_type, type, category, status, owner, source, split_part(source, '/', 2) AS source_name,
             array_to_string(tags, ',') AS tags,
             coalesce((SELECT string_agg(raw, ',' ORDER BY i) FROM ments WHERE ments.path = pg.path), '') AS mentioned_in,
             created, last_reviewed, length(body)::INT AS n_body FROM pg JOIN pbody USING (path)""",
    rejected_pages="""
      SELECT path, CASE k % 212 WHEN 0 THEN 'no_frontmatter' WHEN 53 THEN 'unterminated' WHEN 106 THEN 'empty' ELSE 'not_mapping' END AS reason
      FROM parts WHERE NOT is_page""",
    source_files="SELECT name FROM files",
    index_entries="SELECT entry FROM ix",
    change_log="SELECT line_no, part, date, log_date, action, detail FROM logrows",
    source_headers="""
      SELECT name, CASE WHEN d % 9 <> 0 THEN 'feed ' || source END AS source_type,
             CASE WHEN d % 9 <> 0 AND d % 2 = 0 THEN 'https://example.org/doc/' || d END AS url,
             CASE WHEN d % 9 <> 0 AND d % 10 <> 3 THEN DATE '2024-01-01' + CAST(d % 300 AS INTEGER) END AS fetched FROM srcs""",
    page_lines="""
      SELECT path, (i - 1)::INT AS pos, lines[i] AS line FROM (
        SELECT path, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT path, string_split(CASE WHEN text LIKE E'%\\n' THEN left(text, -1) ELSE text END, E'\\n') AS lines FROM doc))""",
    manifest="""
      SELECT path FROM doc
      UNION ALL SELECT 'sources/scan-' || d || '.pdf' FROM srcs WHERE d % 20 = 0
      UNION ALL SELECT 'sources/img/fig-' || d || '.png' FROM srcs WHERE d % 25 = 0
      UNION ALL SELECT 'sources/.draft-' || d FROM srcs WHERE d % 30 = 0""",
    log_stream="SELECT DISTINCT date, action, detail FROM logrows WHERE log_date IS NOT NULL",
    log_stream_rejected="SELECT date, action, detail FROM logrows WHERE log_date IS NULL",
)

_SUMMARY = """
  SELECT path AS file, coalesce(left(fm_title, 50), '') AS title, coalesce(category, '') AS category,
         coalesce(status, '') AS status, coalesce(last_reviewed::VARCHAR, '') AS last_reviewed FROM pg"""
_SUMMARY_OF_ALL = f"{_SUMMARY} UNION ALL SELECT path, 'Copy ' || k, '', '', '' FROM extra"  # a query sees more folders than a reader
_RECORD = """
  SELECT path, title, page_type AS type, coalesce(category, '') AS category, coalesce(status, '') AS status,
         coalesce(owner, '') AS owner, coalesce(source, '') AS source, {tags} AS tags,
         coalesce(created::VARCHAR, '') AS created, coalesce(last_reviewed::VARCHAR, '') AS last_reviewed, {body} AS body
  FROM pg JOIN pbody USING (path)"""
_PROVENANCE = "CASE WHEN source IS NULL THEN 'synthesized' ELSE 'source' END AS provenance"
_DAYS = f"date_diff('day', last_reviewed, {AS_OF})"

_add(
    page_summary=_SUMMARY_OF_ALL,
    page_record=_RECORD.format(tags="array_to_string(tags, ',')", body="md5(body)"),
    title_fallback="""
      SELECT path, CASE WHEN path LIKE 'notes/%' THEN split_part(split_part(path, '/', 2), '.', 1)
        ELSE upper(substr(split_part(path, '/', 2), 1, 1)) || substr(replace(split_part(split_part(path, '/', 2), '.', 1), '-', ' '), 2) END AS title FROM pg""",
    page_type="""
      SELECT path, page_type, coalesce(category, '') LIKE 'Meta%' AS lint_exempt_meta FROM pg""",
    provenance=f"SELECT path, {_PROVENANCE} FROM pg",
    review_age=f"""
      SELECT path, CASE WHEN last_reviewed IS NULL THEN '' WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday'
        WHEN n < 30 THEN n || ' days ago' WHEN n < 365 THEN (n // 30) || ' months ago' ELSE (n // 365) || ' years ago' END AS reviewed
      FROM (SELECT path, last_reviewed, {_DAYS} AS n FROM pg)""",
    page_blurb="""
      SELECT path, CASE WHEN k % 47 = 6 THEN array_to_string([('w' || i) FOR i IN range(40)], E'\n') ELSE left('Part ' || k || ' of ' || p_brand || '.' || CASE WHEN k % 6 = 1 THEN ' See sources/doc-' || d || '.md' ELSE '' END
        || CASE WHEN k % 12 = 7 THEN ' and sources/doc-' || (k + 1) % n_docs || '.md and sources/doc-' || (k + 2) % n_docs || '.md and sources/doc-' || (k + 3) % n_docs || '.md' ELSE '' END
        || CASE WHEN k % 6 = 1 THEN ' for details.' ELSE '' END, 180) END AS blurb FROM parts WHERE is_page
      UNION ALL SELECT path, title || '.' FROM ents UNION ALL SELECT path, '' FROM notes""",
    format_date="SELECT path AS file, coalesce(last_reviewed::VARCHAR, '') AS last_reviewed FROM pg",
    label_truncate="SELECT path, CASE WHEN length(title) > 35 THEN left(title, 33) || '…' ELSE title END AS label FROM pg",
    column_widths=f"""
      SELECT greatest(4, max(length(file)))::INT AS file, greatest(5, max(length(title)))::INT AS title, greatest(8, max(length(category)))::INT AS category,
             greatest(6, max(length(status)))::INT AS status, greatest(13, max(length(last_reviewed)))::INT AS last_reviewed FROM ({_SUMMARY_OF_ALL})""",
    table_lines=f"""
      SELECT '| ' || rpad(file, w1, ' ') || ' | ' || rpad(title, w2, ' ') || ' | ' || rpad(category, w3, ' ') || ' | ' || rpad(status, w4, ' ')
             || ' | ' || rpad(last_reviewed, w5, ' ') || ' |' AS line
      FROM ({_SUMMARY_OF_ALL}), (SELECT greatest(4, max(length(file)))::INT AS w1, greatest(5, max(length(title)))::INT AS w2,
        greatest(8, max(length(category)))::INT AS w3, greatest(6, max(length(status)))::INT AS w4, greatest(13, max(length(last_reviewed)))::INT AS w5 FROM ({_SUMMARY_OF_ALL}))""",
    search_docs="SELECT id, title, category, array_to_string(tags, ',') AS tags, md5(body) AS body FROM sdoc",
    filter_status="SELECT path FROM pg WHERE status = 'Draft'",
    filter_category="SELECT path FROM pg WHERE category LIKE '%Brand#1%'",
    filter_type="SELECT path FROM pg WHERE page_type = 'meta'",
    filter_tag="SELECT path FROM pg WHERE list_contains(tags, 'widget')",
    filter_stale=f"SELECT path FROM pg WHERE coalesce({_DAYS}, 0) >= 250",
    filter_all=f"""{_SUMMARY} WHERE status = 'Draft' AND category LIKE '%Brand%' AND page_type = 'use-case'
      AND list_contains(tags, 'small') AND coalesce({_DAYS}, 0) >= 200""",
    open_status="SELECT path, pos, mark <> 1 AS holds, mark <> 1 AS leads FROM risks",
    entity_pages="SELECT path, page_type FROM pg WHERE page_type IN ('entity', 'concept')",
    filename_convention="""
      SELECT path, reason FROM notes, (VALUES ('not_kebab_case'), ('entity_outside_entities')) v(reason)""",
    headings="""
      SELECT path, (i - 1)::INT AS pos, h[i] AS heading FROM (SELECT path, h, unnest(range(1, len(h) + 1)) AS i FROM (
        SELECT path, list_filter(CASE WHEN k % 3 = 0 THEN ['reviewed by hand'] ELSE [] END || ['Part ' || k, 'What This Is', 'How It Works', 'Risk Register',
          CASE WHEN k % 41 <> 0 THEN 'Prerequisites' END, CASE WHEN k % 8 = 0 THEN 'Appendix A' END], lambda x: x IS NOT NULL) AS h FROM parts WHERE is_page
        UNION ALL SELECT path, CASE WHEN has_where THEN ['What It Is', 'How We Use It', 'Where It Appears'] ELSE ['What It Is', 'How We Use It'] END FROM ents))""",
    risk_rows="SELECT path, page_title, pos, risk, likelihood, impact, mitigation, status FROM risks",
    open_risks="""
      SELECT path, page_title, pos, risk, likelihood, impact, mitigation, status, CASE mark WHEN 0 THEN '⚠️' ELSE '🔲' END AS status_symbol
      FROM risks WHERE mark <> 1""",
    open_risks_query="SELECT path AS file, risk, likelihood, impact, status FROM risks WHERE mark <> 1 AND k % 37 <> 0",
    open_risks_lint="SELECT path, left(risk, 80) AS risk FROM risks WHERE mark = 2 AND k % 37 <> 0",
    open_questions="SELECT path, page_title, seq, question FROM qs",
    raw_links="SELECT src, target FROM links",
    mentions="SELECT CASE WHEN raw LIKE './%' THEN substr(raw, 3) ELSE raw END AS referrer, path FROM ments",
    source_refs="""
      SELECT path, len(r)::INT AS n_refs, array_to_string(r[1:3], ', ') || CASE WHEN len(r) > 3 THEN '…' ELSE '' END AS preview
      FROM (SELECT path, refs AS r FROM refs UNION ALL SELECT path, [source] FROM parts WHERE is_page AND source IS NOT NULL)""",
    page_tags="SELECT path, unnest(tags) AS tag FROM pg",
    risk_status_mix="""
      SELECT path, count(*) FILTER (mark = 0) AS action_required, count(*) FILTER (mark = 2) AS not_addressed,
             count(*) FILTER (mark = 1) AS handled, CAST(0 AS BIGINT) AS other FROM risks GROUP BY path""",
    risks_sorted="SELECT page_title, risk, likelihood, impact, status, path, pos FROM risks WHERE mark <> 1",
    resolved_links="SELECT DISTINCT src, target AS dst FROM links WHERE good",
    resolved_mentions="SELECT src, dst FROM back",
    edges="SELECT src, dst FROM edges",
    edge_list="SELECT src, dst FROM edges ORDER BY src, dst",
    mention_titles="""
      SELECT e.src AS path, 'mentions' AS direction, e.dst AS other, title FROM edges e JOIN pg ON pg.path = e.dst
      UNION ALL SELECT e.dst, 'mentioned_by', e.src, title FROM edges e JOIN pg ON pg.path = e.src""",
    shared_entity_groups="""
      SELECT dst AS entity, src AS page, n_pages FROM edges JOIN (SELECT dst, count(*) AS n_pages FROM edges GROUP BY dst HAVING count(*) >= 2) USING (dst)
      WHERE dst IN (SELECT path FROM pg WHERE page_type IN ('entity', 'concept'))""",
    inbound_degree="SELECT path, count(src) AS inbound FROM pg LEFT JOIN edges ON dst = path GROUP BY path",
    total_degree="""
      SELECT path, count(e) AS degree FROM pg LEFT JOIN (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges) ON e = path GROUP BY path""",
    graph_stats="""
      SELECT (SELECT count(*) FROM pg) AS pages, (SELECT count(*) FROM edges) AS links,
             (SELECT count(*) FROM pg WHERE path NOT IN (SELECT dst FROM edges)) AS orphans""",
    graph_nodes="""
      SELECT path, title AS label, page_type AS type, array_to_string(tags, ',') AS tags, path NOT IN (SELECT dst FROM edges) AS orphan FROM pg""",
    orphan_pages="SELECT path, title FROM pg WHERE path NOT IN (SELECT dst FROM edges)",
    node_weight="""
      SELECT path, round(CASE WHEN page_type = 'use-case' THEN 12.0 ELSE 9.0 END + 2.5 * sqrt(count(e)::DOUBLE), 6)::DOUBLE AS weight
      FROM pg LEFT JOIN (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges) ON e = path GROUP BY path, page_type""",
    entity_mentions="""
      SELECT path, title, page_type, count(src) AS mentions FROM pg LEFT JOIN edges ON dst = path
      WHERE page_type IN ('entity', 'concept') GROUP BY path, title, page_type""",
)


def _visible(tags: str, text: str | None = None) -> str:
    where = f"page_type IN ('use-case', 'entity') AND list_has_any(tags, [{tags}])"
    if text:
        where += f" AND (lower(title) LIKE '%{text}%' OR lower(path) LIKE '%{text}%')"
    return f"SELECT path FROM pg WHERE {where}"


def _between(nodes: str) -> str:
    return f"SELECT src, dst FROM edges WHERE src IN ({nodes}) AND dst IN ({nodes})"


_NODES = _visible("'small', 'widget', 'supplier'", "1")
_BALL = """
  SELECT path, min(hop) AS hop FROM (
    SELECT 'parts/part-1.md' AS path, 0 AS hop
    UNION ALL SELECT b, 1 FROM und WHERE a = 'parts/part-1.md'
    UNION ALL SELECT u2.b, 2 FROM und u1 JOIN und u2 ON u2.a = u1.b WHERE u1.a = 'parts/part-1.md') GROUP BY path"""
_UND = ", und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"

_add(
    visible_nodes=_NODES,
    visible_edges=_between(_NODES),
    visible_subgraph=_between(_visible("'widget', 'nation'")),
    k_hop=f"{_UND} SELECT 'parts/part-1.md' AS seed, path, hop FROM ({_BALL})",
    k_hop_many=f"""{_UND}, near AS (
        SELECT path AS seed, path, 0 AS hop FROM pg WHERE page_type IN ('entity', 'concept')
        UNION ALL SELECT p.path, u.b, 1 FROM pg p JOIN und u ON u.a = p.path WHERE page_type IN ('entity', 'concept')
        UNION ALL SELECT p.path, v.b, 2 FROM pg p JOIN und u ON u.a = p.path JOIN und v ON v.a = u.b WHERE page_type IN ('entity', 'concept')
      ) SELECT path, hop, count(*) AS n_seeds FROM (SELECT seed, path, min(hop) AS hop FROM near GROUP BY ALL) GROUP BY ALL""",
    edge_highlight=f"""{_UND}, ball AS ({_BALL})
      SELECT src, dst, CASE WHEN src = 'parts/part-1.md' OR dst = 'parts/part-1.md' THEN 'incident'
        WHEN src IN (SELECT path FROM ball) AND dst IN (SELECT path FROM ball) THEN 'inside' ELSE 'outside' END AS place FROM edges""",
)

_LABELS = {
    "frontmatter": "Frontmatter", "source_missing": "Broken source ref", "likely_missing_source": "Likely missing source field",
    "missing_section": "Missing section", "open_risk": "Open risk", "mentioned_in_missing": "Broken mentioned_in",
    "not_in_index": "Not in index", "orphan_source": "Orphan source", "index_dead_link": "Dead index link",
}
_LABEL = 'CASE "check" ' + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " END AS label"

for _check in _LABELS:
    _SELECTS[f"check_{_check}"] = f"""SELECT file, "check", detail FROM found WHERE "check" = '{_check}'"""

_RAW = "CASE WHEN raw LIKE './%' THEN substr(raw, 3) ELSE raw END"
_add(
    check_mentioned_in_missing_stripped=f"""
      SELECT path AS file, 'mentioned_in_missing' AS "check", 'mentioned_in: ''' || {_RAW} || ''' does not exist' AS detail
      FROM ments WHERE k IS NULL OR k % 53 = 0 OR k >= (SELECT count(*) FROM part)""",
)

_JSON = {
    "pages": _RECORD.format(tags="tags", body="body"),
    "edges": "SELECT src, dst FROM edges",
    "log": "SELECT date, action, detail FROM logrows",
    "risks": """SELECT path AS page, page_title, CASE mark WHEN 0 THEN '⚠️' ELSE '🔲' END AS status_symbol, risk, likelihood, impact, mitigation, status
                FROM risks WHERE mark <> 1""",
    "open_qs": "SELECT path AS page, page_title, question FROM qs",
    "search": "SELECT id, title, category, tags, body FROM sdoc",
}

_add(
    findings='SELECT file, "check", detail FROM found',
    findings_by_check=f'SELECT "check", {_LABEL}, count(*) AS n_findings FROM found GROUP BY "check"',
    findings_totals="""
      SELECT count(*) AS total, count(*) FILTER ("check" = 'open_risk') AS open_risks, count(*) FILTER ("check" <> 'open_risk') AS structural FROM found""",
    findings_json="""SELECT json_object('file', file, 'check', "check", 'detail', detail)::VARCHAR AS json FROM found""",
    findings_report=f"""SELECT "check", {_LABEL}, '- [ ] `' || file || '` — ' || detail AS item FROM found""",
    page_count="SELECT count(*) AS n_pages FROM pg WHERE status = 'Draft'",
    risk_totals="SELECT count(*) AS n_rows, count(DISTINCT path) AS n_pages FROM risks WHERE mark <> 1 AND k % 37 <> 0",
    pages_by_category=f"SELECT coalesce(category, 'Uncategorized') AS category, path, title, status, {_PROVENANCE} FROM pg",
    category_tree="SELECT coalesce(category, 'Uncategorized') AS category, title, path FROM pg",
    category_sizes="SELECT coalesce(category, 'Uncategorized') AS category, count(*) AS n_pages FROM pg GROUP BY 1",
    distinct_types="SELECT DISTINCT page_type FROM pg",
    distinct_tags="SELECT DISTINCT unnest(tags) AS tag FROM pg",
    view_counts="""
      SELECT 'risks' AS view, count(*) AS n FROM risks WHERE mark <> 1 UNION ALL SELECT 'open_questions', count(*) FROM qs
      UNION ALL SELECT 'entities', count(*) FROM pg WHERE page_type IN ('entity', 'concept')""",
    order_by_path="SELECT path FROM pg",
    recent_changes="SELECT line_no, part, date, log_date, action, detail FROM logrows",
    reader_bundle="\nUNION ALL ".join(
        f"SELECT '{name}' AS collection, to_json(x)::VARCHAR AS json FROM ({rows}) x" for name, rows in _JSON.items()
    ),
)

# Search: the same published formula, term by term.

_TOK = r"""
, ft AS (
  SELECT id AS doc, field, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms
  FROM (SELECT id, 'title' AS field, title AS text FROM sdoc UNION ALL SELECT id, 'body', body FROM sdoc
        UNION ALL SELECT id, 'tags', array_to_string(tags, ' ') FROM sdoc UNION ALL SELECT id, 'category', category FROM sdoc)
),
post AS (
  SELECT term, field, doc, count(*)::INT AS tf, field_len FROM (SELECT doc, field, len(terms)::INT AS field_len, unnest(terms) AS term FROM ft)
  GROUP BY term, field, doc, field_len
)"""


def _weight(word: str, prefix: bool, fuzzy: bool) -> str:
    n, reach = len(word), int(0.2 * len(word) + 0.5)
    ways = [f"CASE WHEN term = '{word}' THEN 1.0::DOUBLE END"]
    if prefix:
        ways.append(f"CASE WHEN starts_with(term, '{word}') THEN 0.375::DOUBLE * length(term) / (length(term) + 0.3::DOUBLE * (length(term) - {n})) END")
    if fuzzy and reach:
        ways.append(
            f"CASE WHEN abs(length(term) - {n}) <= {reach} AND levenshtein(term, '{word}') <= {reach} "
            f"THEN 0.45::DOUBLE * length(term) / (length(term) + levenshtein(term, '{word}')) END"
        )
    return f"coalesce({', '.join(ways)})"


def _scores(query: str, prefix: bool, fuzzy: bool) -> str:
    words = [_weight(w, prefix, fuzzy) for w in query.split()]
    total = " + ".join(f"coalesce({w}, 0)" for w in words)
    any_ = " OR ".join(f"{w} IS NOT NULL" for w in words)
    return f"""{_TOK},
    vocab AS (SELECT term, field, count(*) AS df FROM post GROUP BY term, field),
    stats AS (SELECT field, count(*) AS docs, avg(len(terms)::DOUBLE) AS avg_len FROM ft GROUP BY field),
    ex AS (SELECT term, field, avg_len, ({total}) * CASE WHEN field = 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
             * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w FROM vocab JOIN stats USING (field) WHERE {any_}),
    sc AS (SELECT doc, sum(w * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * field_len / avg_len)))) AS score
           FROM post JOIN ex USING (term, field) GROUP BY doc)"""


_BEST = "SELECT doc, score FROM sc ORDER BY round(score, 6) DESC, doc LIMIT 30"
_add(
    tokens=f"""{_TOK} SELECT doc, field, (i - 1)::INT AS pos, terms[i] AS term FROM (SELECT doc, field, terms, unnest(range(1, len(terms) + 1)) AS i FROM ft)""",
    inverted_index=f"{_TOK} SELECT term, field, doc, tf, field_len FROM post",
    search_exact=f"{_scores('small widget', False, False)} SELECT doc, round(score, 4) AS score FROM sc",
    search_prefix=f"{_scores('widg presu prereq', True, False)} SELECT doc, round(score, 4) AS score FROM sc",
    search_fuzzy=f"{_scores('widgit prerequisit', False, True)} SELECT doc, round(score, 4) AS score FROM sc",
    search_ranked=f"{_scores('smal widgit brand', True, True)} SELECT doc, round(score, 4) AS score FROM ({_BEST})",
    search_topk=f"{_scores('red widget', False, False)} SELECT doc, round(score, 4) AS score FROM ({_BEST})",
    search_hits=f"""{_scores('blue bolt economy', True, True)}
      SELECT doc, round(score, 4) AS score, title, category, {_PROVENANCE} FROM ({_BEST}) JOIN pg ON pg.path = doc""",
)

# Upkeep

_SHINGLES = """list_distinct(CASE WHEN len({w}) < 5 THEN [array_to_string({w}, ' ')]
   ELSE [array_to_string({w}[i:i + 4], ' ') FOR i IN range(1, len({w}) - 3)] END)"""
_add(
    source_drift=f"""
      SELECT name, round(similarity, 6) AS similarity FROM (
        SELECT name, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM (
          SELECT name, {_SHINGLES.format(w='u')} AS a, {_SHINGLES.format(w='v')} AS b FROM (
            SELECT name, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS u,
                   list_filter(regexp_split_to_array(CASE WHEN d % 8 = 0 THEN E'# Moved\\n\\n' || reverse(text)
                     ELSE concat('# Document ', d, E'\\n\\n## How It Works\\n\\n', text, E'\\n\\nOne more closing sentence was put here.\\n') END, '\\s+'), lambda x: x <> '') AS v
            FROM stext WHERE d % 4 = 0 AND d % 9 <> 0))) WHERE similarity < 0.8""",
    section_coverage="""
      SELECT path, 'doc-' || d || '.md' AS source_name, h AS heading FROM (
        SELECT path, d, unnest(['document ' || d] || CASE WHEN k % 8 <> 0 THEN ['appendix a'] ELSE [] END || CASE WHEN d % 4 = 0 THEN ['glossary'] ELSE [] END) AS h
        FROM parts WHERE is_page AND k % 4 = 0 AND k % 44 <> 0)""",
    coverage_ratio="""
      SELECT p.path, s.name AS source_name, round(length(p.body)::DOUBLE / length(s.body)::DOUBLE, 6) AS ratio
      FROM ptext p JOIN stext s ON s.d = p.d WHERE k % 53 <> 0 AND k % 4 = 0 AND k % 44 <> 0""",
    header_violations="""
      SELECT name, unnest(CASE WHEN d % 9 = 0 THEN ['source_type', 'fetched'] WHEN d % 10 = 3 THEN ['fetched'] ELSE [] END) AS missing FROM srcs""",
    log_violations="""
      SELECT event_id * 5 + 1 + (event_id = 0)::INT AS line_no, '## ' || strftime(ts, '%Y-%m-%d') || ' no brackets' AS line, 'no_entry' AS reason
      FROM events WHERE event_id % 100 = 0
      UNION ALL SELECT event_id * 5 + 1, '## [2024-13-45] ' || event_type || ' | no such day', 'impossible_date' FROM events WHERE event_id % 100 = 50""",
)

ORACLE: dict[str, str] = {name: f"{BASE}{select}" for name, select in _SELECTS.items()}
