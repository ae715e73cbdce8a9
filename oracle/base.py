"""Common table expressions: the derived corpus as seen by its generating columns.

None of them reads markdown: fields, links, risks and findings follow from the
keys. Only the queries about text itself (lines, terms, lengths) put the text
together.
"""

AS_OF = "DATE '2024-12-31'"

BASE = r"""
WITH part0 AS (
  SELECT p_partkey AS k, p_name, p_brand, p_type, p_size,
         p_partkey % (SELECT count(*) FROM documents) AS d,
         p_partkey % (SELECT count(*) FROM supplier) AS s,
         (SELECT count(*) FROM documents) AS n_docs,
         (SELECT count(*) FROM part) AS n_parts,
         DATE '2024-01-01' + CAST(p_partkey % 200 AS INTEGER) AS created
  FROM part
),
parts AS (
  SELECT *, 'parts/part-' || k || '.md' AS path, k % 53 <> 0 AS is_page,
         'Part ' || k || ' ' || p_name AS full_title,
         CASE WHEN k % 11 <> 0 THEN 'Part ' || k || ' ' || p_name END AS fm_title,
         CASE WHEN k % 17 = 0 THEN NULL WHEN k % 97 = 0 THEN 'Meta ' || p_brand ELSE p_brand END AS category,
         CASE WHEN k % 19 = 0 THEN '' WHEN k % 3 = 0 THEN 'Draft' WHEN k % 3 = 1 THEN 'Active' ELSE 'Deprecated' END AS status,
         'team-' || k % 10 AS owner,
         [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)] AS tags,
         CASE WHEN k % 23 <> 0 THEN created + p_size END AS last_reviewed,
         CASE WHEN k % 44 = 0 THEN 'sources/lost-' || k || '.md' WHEN k % 4 = 0 THEN 'sources/doc-' || d || '.md' END AS source
  FROM part0
),
ents AS (
  SELECT 'entities/nation-' || n_nationkey || '.md' AS path, CAST(n_nationkey AS BIGINT) AS n, 'entity' AS kind,
         n_name AS title, 'nation' AS tag, n_nationkey % 7 <> 0 AS has_where FROM nation
  UNION ALL
  SELECT 'entities/supplier-' || s_suppkey || '.md', s_suppkey, 'entity', s_name, 'supplier', s_suppkey % 7 <> 0 FROM supplier
  UNION ALL
  SELECT 'entities/region-' || r_regionkey || '.md', CAST(r_regionkey AS BIGINT), 'concept',
         array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(r_name, ' ')], ' '), 'region', true FROM region
),
ments AS (
  SELECT path, n, i, CASE i WHEN 1 THEN 'parts/part-' || n || '.md' WHEN 2 THEN './parts/part-' || (n + 25) || '.md'
                     ELSE 'parts/ghost-' || n || '.md' END AS raw,
         CASE i WHEN 1 THEN n WHEN 2 THEN n + 25 END AS k
  FROM ents, (VALUES (1), (2), (3)) v(i)
  WHERE kind = 'entity' AND (i < 3 OR n % 5 = 0)
),
notes AS (
  SELECT 'notes/Supplier_Note_' || s_suppkey || '.md' AS path, 'Supplier_Note_' || s_suppkey AS title
  FROM supplier WHERE s_suppkey % 10 = 3
),
pg AS (
  SELECT path, coalesce(fm_title, 'Part ' || k) AS title, fm_title,
         CASE WHEN category LIKE 'Meta%' THEN 'meta' ELSE 'use-case' END AS page_type, NULL AS type,
         category, status, owner, tags, created, last_reviewed, source FROM parts WHERE is_page
  UNION ALL
  SELECT path, title, title, kind, kind, 'Entities & Concepts', 'Active', 'team-' || n % 10, [tag],
         DATE '2024-01-01', DATE '2024-06-01' + CAST(n % 100 AS INTEGER), NULL FROM ents
  UNION ALL
  SELECT path, title, NULL, 'concept', 'concept', 'Meta notes', NULL, NULL, [], NULL, NULL, NULL FROM notes
),
links AS (
  SELECT path AS src, 'entities/nation-' || k % 25 || '.md' AS target, k, NULL::BIGINT AS to_k, true AS good FROM parts WHERE is_page
  UNION ALL SELECT path, 'entities/supplier-' || s || '.md', k, NULL, true FROM parts WHERE is_page
  UNION ALL SELECT path, 'parts/part-' || (k + 1) || '.md', k, k + 1, (k + 1) % 53 <> 0 AND k + 1 < n_parts FROM parts WHERE is_page
  UNION ALL SELECT path, path, k, k, false FROM parts WHERE is_page AND k % 13 = 0
  UNION ALL SELECT path, 'parts/part-' || (k - 2) || '.md', k, k - 2, (k - 2) % 53 <> 0 FROM parts WHERE is_page AND k % 29 = 0 AND k >= 2
),
back AS (
  SELECT 'parts/part-' || k || '.md' AS src, path AS dst FROM ments
  WHERE k IS NOT NULL AND k % 53 <> 0 AND k < (SELECT count(*) FROM part)
),
edges AS (SELECT src, target AS dst FROM links WHERE good UNION SELECT src, dst FROM back),
risks AS (
  SELECT path, k, coalesce(fm_title, 'Part ' || k) AS page_title, CAST(r - 1 AS INTEGER) AS pos, 'Risk ' || r || ' of part ' || k AS risk,
         CASE WHEN (k + r) % 2 = 0 THEN 'High' ELSE 'Low' END AS likelihood, 'Medium' AS impact, 'Plan ' || r AS mitigation,
         CASE (k + r) % 3 WHEN 0 THEN '⚠️ Action required' WHEN 1 THEN '✅ Handled' ELSE '🔲 Not yet addressed' END AS status,
         (k + r) % 3 AS mark
  FROM parts, (VALUES (1), (2), (3)) v(r) WHERE is_page AND r <= k % 3 + 1
),
qs AS (
  SELECT path, coalesce(fm_title, 'Part ' || k) AS page_title, CAST(0 AS INTEGER) AS seq,
         'Is size ' || p_size || ' right for part ' || k || '?' AS question
  FROM parts WHERE is_page AND p_size % 10 = 0
),
srcs AS (
  SELECT doc_id AS d, 'doc-' || doc_id || '.md' AS name, text, source FROM documents
),
files AS (
  SELECT name FROM srcs UNION ALL SELECT 'scan-' || d || '.pdf' FROM srcs WHERE d % 20 = 0
),
logrows AS (
  SELECT event_id * 5 + (event_id = 0)::INT AS line_no, 0 AS part, strftime(ts, '%Y-%m-%d') AS date,
         CAST(ts AS DATE) AS log_date, event_type AS action, 'user ' || user_id AS detail FROM events
  UNION ALL
  SELECT event_id * 5 + 1, 0, '2024-13-45', NULL, event_type, 'no such day' FROM events WHERE event_id % 100 = 50
  UNION ALL SELECT 0, 0, '2023-12-31', DATE '2023-12-31', 'init', 'Created'
),
ix AS (
  SELECT 'parts/part-' || k || '.md' AS entry, k FROM part0 WHERE k % 7 <> 0
  UNION ALL SELECT 'parts/group-' || k || '/README.md', NULL FROM part0 WHERE k % 50 = 0
  UNION ALL SELECT 'parts/gone-' || k || '.md', NULL FROM part0 WHERE k % 100 = 1
  UNION ALL SELECT 'parts/shown-' || k || '.md', NULL FROM part0 WHERE k % 100 = 3
  UNION ALL SELECT unnest(['parts/one-' || k || '.md', 'parts/wide-' || k || E'\n](./of several lines\npage.md', 'parts/last-' || k || '.md']), NULL
    FROM part0 WHERE k % 100 = 5
  UNION ALL SELECT 'parts/sewn-' || k || '.md', NULL FROM part0 WHERE k % 100 = 6
  UNION ALL SELECT 'entities/supplier-' || s_suppkey || '.md', NULL FROM supplier
),
refs AS (
  SELECT path, list_sort(list_distinct(CASE WHEN k % 12 = 7
           THEN [('sources/doc-' || (k + i) % n_docs || '.md') FOR i IN [0, 1, 2, 3]]
           ELSE ['sources/doc-' || d || '.md'] END)) AS refs, source, category
  FROM parts WHERE is_page AND k % 6 = 1
),
extra AS (
  SELECT 'docs/guide-' || k || '.md' AS path, k, true AS for_lint FROM part0 WHERE k % 50 = 7
  UNION ALL SELECT 'tests/case-' || k || '.md', k, true FROM part0 WHERE k % 50 = 8
  UNION ALL SELECT 'evals/run-' || k || '.md', k, false FROM part0 WHERE k % 50 = 9
),
found AS (
  SELECT path AS file, 'frontmatter' AS "check", 'missing field: ' || f AS detail
  FROM (SELECT path, unnest([CASE WHEN k % 11 = 0 THEN 'title' END, CASE WHEN k % 17 = 0 THEN 'category' END,
          CASE WHEN k % 19 = 0 THEN 'status' END, CASE WHEN k % 23 = 0 THEN 'last_reviewed' END]) AS f FROM parts WHERE is_page)
  WHERE f IS NOT NULL
  UNION ALL SELECT path, 'frontmatter', 'missing field: ' || f
  FROM notes, (VALUES ('title'), ('status'), ('owner'), ('tags'), ('created'), ('last_reviewed')) v(f)
  UNION ALL SELECT path, 'source_missing', 'source ''' || source || ''' not found in sources/' FROM parts WHERE is_page AND k % 44 = 0
  UNION ALL SELECT path, 'likely_missing_source', 'body references ' || array_to_string(refs[1:3], ', ')
            || CASE WHEN len(refs) > 3 THEN '…' ELSE '' END || ' but no source field — should this be set?'
  FROM refs WHERE source IS NULL AND coalesce(category, '') NOT LIKE 'Meta%'
  UNION ALL SELECT path, 'missing_section', 'use-case page missing section: Prerequisites'
  FROM parts WHERE is_page AND k % 41 = 0 AND coalesce(category, '') NOT LIKE 'Meta%'
  UNION ALL SELECT path, 'missing_section', 'entity page missing section: Where It Appears' FROM ents WHERE NOT has_where
  UNION ALL SELECT path, 'missing_section', 'entity page missing section: ' || f
  FROM notes, (VALUES ('What It Is'), ('How We Use It'), ('Where It Appears')) v(f)
  UNION ALL SELECT path, 'frontmatter', 'missing field: ' || f
  FROM extra, (VALUES ('category'), ('status'), ('owner'), ('tags'), ('created'), ('last_reviewed')) v(f) WHERE for_lint
  UNION ALL SELECT path, 'missing_section', 'use-case page missing section: ' || f
  FROM extra, (VALUES ('What This Is'), ('How It Works'), ('Risk Register'), ('Prerequisites')) v(f) WHERE for_lint
  UNION ALL SELECT path, 'not_in_index', 'not listed in index.md' FROM extra WHERE for_lint
  UNION ALL SELECT path, 'open_risk', '🔲 ' || risk FROM risks WHERE mark = 2 AND k % 37 <> 0
  UNION ALL SELECT path, 'mentioned_in_missing', 'mentioned_in: ''' || raw || ''' does not exist' FROM ments
  WHERE i > 1 OR k % 53 = 0 OR k >= (SELECT count(*) FROM part)
  UNION ALL SELECT path, 'not_in_index', 'not listed in index.md' FROM pg WHERE path NOT IN (SELECT entry FROM ix)
  UNION ALL SELECT 'sources/' || name, 'orphan_source', 'no wiki page has source pointing here' FROM files
  WHERE name NOT IN (SELECT 'doc-' || d || '.md' FROM parts WHERE is_page AND k % 4 = 0 AND k % 44 <> 0)
  UNION ALL SELECT 'index.md', 'index_dead_link', 'entry ''' || entry || ''' does not exist' FROM ix
  WHERE regexp_matches(entry, '^parts/(gone|shown|one|wide|last|sewn)-')
),
ptext AS (
  SELECT path, k, concat(
    CASE k % 212 WHEN 0 THEN '' WHEN 53 THEN E'---\ntitle: Part ' || k || E'\n' WHEN 106 THEN E'---\n# nothing yet\n---\n'
      WHEN 159 THEN E'---\n- a\n- b\n---\n' ELSE concat(E'---\n',
        CASE WHEN k % 3 = 0 THEN E'# reviewed by hand\n' ELSE '' END,
        CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 5 THEN 'title: "' || full_title || E'"\n' ELSE 'title: ' || full_title || E'\n' END,
        CASE WHEN category IS NULL THEN '' ELSE 'category: ' || category || E'\n' END,
        CASE WHEN status = '' THEN E'status: ""\n' ELSE 'status: ' || status || E'\n' END,
        'owner: ' || owner || E'  # rota\n',
        CASE WHEN k % 5 = 0 THEN E'tags:\n  - ' || array_to_string(tags, E'\n  - ') || E'\n' ELSE 'tags: [' || array_to_string(tags, ', ') || E']\n' END,
        'created: ' || created || E'\n',
        CASE WHEN last_reviewed IS NULL THEN '' ELSE 'last_reviewed: ' || last_reviewed || E'\n' END,
        CASE WHEN source IS NULL THEN '' ELSE 'source: ' || source || E'\n' END, E'---\n') END) AS front,
    concat('# Part ', k, E'\n\n', CASE k % 47 WHEN 5 THEN E'```\ncode text\n```\n\n'
        WHEN 6 THEN array_to_string([('w' || i) FOR i IN range(40)], E'\n') || E'\n\n' ELSE '' END,
      E'## What This Is\n\nPart ', k, ' of ', p_brand, '.',
      CASE WHEN k % 6 = 1 THEN ' See sources/doc-' || d || '.md' ELSE '' END,
      CASE WHEN k % 12 = 7 THEN ' and sources/doc-' || (k + 1) % n_docs || '.md and sources/doc-' || (k + 2) % n_docs || '.md and sources/doc-' || (k + 3) % n_docs || '.md' ELSE '' END,
      CASE WHEN k % 6 = 1 THEN ' for details.' ELSE '' END,
      E'\n\n## How It Works\n\n', t.text, E'\n\nLinks: [nation](./entities/nation-', k % 25, '.md), [supplier](./entities/supplier-', s, '.md), [next](./parts/part-', k + 1, '.md)',
      CASE WHEN k % 13 = 0 THEN ', [self](./parts/part-' || k || '.md)' ELSE '' END,
      CASE WHEN k % 29 = 0 AND k >= 2 THEN ', [back](../parts/part-' || (k - 2) || '.md)' ELSE '' END,
      CASE WHEN k % 31 = 0 THEN ', [region](./entities/region-0.md#x)' ELSE '' END, E'\n\n',
      CASE WHEN p_size % 10 = 0 THEN '> **Open question:** Is size ' || p_size || ' right for part ' || k || E'?  \n\n' ELSE '' END,
      CASE WHEN k % 43 = 3 THEN hazards ELSE '' END,
      E'## Risk Register\n\n| Risk | Likelihood | Impact | Mitigation | Status |\n',
      CASE WHEN k % 37 = 0 THEN E'| :--- | :--- | :--- | :--- | :--- |\n' ELSE E'| --- | --- | --- | --- | --- |\n' END,
      (SELECT string_agg('| Risk ' || r || ' of part ' || k || ' | ' || CASE WHEN (k + r) % 2 = 0 THEN 'High' ELSE 'Low' END || ' | Medium | Plan ' || r || ' | '
         || CASE (k + r) % 3 WHEN 0 THEN '⚠️ Action required' WHEN 1 THEN '✅ Handled' ELSE '🔲 Not yet addressed' END || E' |\n', '' ORDER BY r)
       FROM (VALUES (1), (2), (3)) v(r) WHERE r <= k % 3 + 1),
      E'\n', CASE WHEN k % 41 <> 0 THEN E'## Prerequisites\n\nNone.\n' ELSE '' END,
      CASE WHEN k % 8 = 0 THEN E'\n## Appendix A\n\nSee above.\n' ELSE '' END,
      CASE WHEN k % 43 = 4 THEN E'\n' || hazards ELSE '' END) AS body, p_brand, n_docs, d
  FROM (SELECT *, concat(E'#### Hazards\n\n| Hazard | Likelihood | Impact | Plan | Status |\n| --- | --- | --- | --- | --- |\n| Fire ',
          k, E' | High | High | Plan | 🔲 Open |\n\n') AS hazards FROM parts) JOIN (SELECT doc_id, text FROM documents) t ON t.doc_id = d
),
etext AS (
  SELECT path, concat(E'---\ntitle: ', title, E'\ntype: ', kind, E'\ncategory: Entities & Concepts\nstatus: Active\nowner: team-', n % 10,
      E'\ntags: [', tag, E']\nmentioned_in:',
      CASE WHEN kind = 'concept' THEN ' []' ELSE concat(E'\n  - parts/part-', n, E'.md\n  - ./parts/part-', n + 25, '.md',
        CASE WHEN n % 5 = 0 THEN E'\n  - parts/ghost-' || n || '.md' ELSE '' END) END,
      E'\ncreated: 2024-01-01\nlast_reviewed: ', DATE '2024-06-01' + CAST(n % 100 AS INTEGER), E'\n---\n') AS front,
    concat('## What It Is', E'\n\n', title, E'.\n\n## How We Use It\n\nDaily.\n',
      CASE WHEN kind = 'concept' THEN E'\n## Where It Appears\n\nNowhere.\n' WHEN has_where THEN E'\n### Where It Appears\n\nIn parts.\n' ELSE '' END) AS body
  FROM ents
),
stext AS (
  SELECT 'sources/' || name AS path, d, name,
    CASE WHEN d % 9 = 0 THEN '' ELSE concat(CASE WHEN d % 50 = 7 THEN array_to_string([('> note ' || i) FOR i IN range(150)], E'\n') || E'\n' ELSE '' END,
      '> **Source type:** feed ', source, E'\n',
      CASE WHEN d % 2 = 0 THEN '> **URL:** https://example.org/doc/' || d || E'\n' ELSE '' END,
      CASE WHEN d % 10 <> 3 THEN '> **Fetched:** ' || (DATE '2024-01-01' + CAST(d % 300 AS INTEGER)) || E'\n' ELSE '' END,
      E'> Kept as it was fetched; changes belong on the page made from it.\n\n') END AS head,
    concat('# Document ', d, E'\n\n## How It Works\n\n', text, E'\n\n## Appendix A\n\nLast words.\n',
      CASE WHEN d % 4 = 0 THEN E'\n## Glossary\n\nNone.\n' ELSE '' END) AS body, text
  FROM srcs
),
xtext AS (
  SELECT 'parts/group-' || k || '/README.md' AS path, k FROM part0 WHERE k % 50 = 0
  UNION ALL SELECT '_templates/part-' || k || '.md', k FROM part0 WHERE k % 50 = 1
  UNION ALL SELECT path, k FROM extra
),
doc AS (
  SELECT path, front || E'\n' || body AS text FROM ptext
  UNION ALL SELECT path, front || E'\n' || body FROM etext
  UNION ALL SELECT path, head || body FROM stext
  UNION ALL SELECT path, E'---\ntype: concept\ncategory: Meta notes\nsource:\nstatus: ~\n---\n' FROM notes
  UNION ALL SELECT path, E'---\ntitle: Copy ' || k || E'\n---\nNot a page.\n' FROM xtext
),
pbody AS (
  SELECT path, body FROM ptext WHERE k % 53 <> 0
  UNION ALL SELECT path, body FROM etext UNION ALL SELECT path, '' FROM notes
),
sdoc AS (
  SELECT pg.path AS id, title, coalesce(category, '') AS category, tags, body FROM pg JOIN pbody USING (path)
)
"""
