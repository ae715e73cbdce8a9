"""The conventions a markdown corpus is held to.

Fixed values: results are only right if these are exactly the ones that the
corpora were written against, so they are kept here in one place, as plain text.
"""

# Names that are never pages. Files are matched by basename at any depth,
# folders by the first path component.
EXCLUDED_FILES = (
    "wiki-agent.md",
    "CLAUDE.md",
    "AGENTS.md",
    "GEMINI.md",
    "CONVENTIONS.md",
    "README.md",
    "index.md",
    "log.md",
)
EXCLUDED_DIRS = {
    "query": ("sources", "_templates", "scripts", ".git", ".obsidian"),
    "lint": ("sources", "_templates", "scripts", ".git", ".obsidian", "evals"),
    "reader": ("sources", "_templates", "scripts", ".git", ".obsidian", "evals", "docs", "tests"),
}

REQUIRED_FIELDS = ("title", "category", "status", "owner", "tags", "created", "last_reviewed")
USE_CASE_SECTIONS = ("What This Is", "How It Works", "Risk Register", "Prerequisites")
ENTITY_SECTIONS = ("What It Is", "How We Use It", "Where It Appears")
ENTITY_TYPES = ("entity", "concept")

# Status markers of a risk row. The warning sign is two code points:
# U+26A0 followed by the emoji variation selector U+FE0F.
ACTION_REQUIRED = "⚠️"
NOT_ADDRESSED = "🔲"
HANDLED = "✅"

CHECK_LABELS = {
    "frontmatter": "Frontmatter",
    "source_missing": "Broken source ref",
    "likely_missing_source": "Likely missing source field",
    "missing_section": "Missing section",
    "open_risk": "Open risk",
    "mentioned_in_missing": "Broken mentioned_in",
    "not_in_index": "Not in index",
    "orphan_source": "Orphan source",
    "index_dead_link": "Dead index link",
}

# Wording of findings; consumers match on it.
CHECK_DETAILS = {
    "frontmatter": "missing field: %s",
    "source_missing": "source '%s' not found in sources/",
    "likely_missing_source": "body references %s but no source field — should this be set?",
    "missing_section": "%s page missing section: %s",
    "open_risk": "🔲 %s",
    "mentioned_in_missing": "mentioned_in: '%s' does not exist",
    "not_in_index": "not listed in index.md",
    "orphan_source": "no wiki page has source pointing here",
    "index_dead_link": "entry '%s' does not exist",
}

# Lengths of shortened texts: risks in findings and in listings, titles in
# listings, node labels (limit and kept part), blurbs, listed references.
RISK_NOTE, RISK_CELL, TITLE_CELL = 80, 60, 50
LABEL_LIMIT, LABEL_KEPT = 35, 33
BLURB, LISTED_REFS = 180, 3

# Weight of a graph node: base by type plus a share of the root of its degree.
USE_CASE_WEIGHT, OTHER_WEIGHT, DEGREE_WEIGHT = 12.0, 9.0, 2.5

# Character classes (to be put between square brackets). SPACE is what Python's
# str.strip() removes, BREAK what str.splitlines() splits on, BLANK the rest.
BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
BLANK = r"\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
SPACE = BREAK + BLANK
WORD = r"\p{L}\p{N}_"

# Patterns. (?m) anchors at line starts, (?d) makes the line feed the only line end.
HEADING = rf"(?md)^#{{1,3}}[{SPACE}]+(.+)"
OPEN_QUESTION = rf"(?md)^>[{SPACE}]*\*\*Open question:\*\*[{SPACE}]*(.+?)[{SPACE}]*$"
LINK = rf"\[(?:[^\]]+)\]\(\.?/?([^)#{SPACE}]+\.md)\)"
SOURCE_REF = rf"(?<![{WORD}])sources/[{WORD}\-./]+\.[{WORD}]+"
INDEX_LINK = r"\]\(\./([^)]+\.md)\)"
LOG_ENTRY = rf"^##[{SPACE}]*\[(\d{{4}}-\d{{2}}-\d{{2}})\][{SPACE}]*([^|]+?)[{SPACE}]*\|[{SPACE}]*(.+?)[{SPACE}]*$"
SOURCE_FILE = r"^sources/[^/.][^/]*$"
SOURCE_HEADER = {
    "source_type": r"(?md)^> \*\*Source type:\*\*[ \t]*(.*)$",
    "url": r"(?md)^> \*\*URL:\*\*[ \t]*(.*)$",
    "fetched": r"(?md)^> \*\*Fetched:\*\*[ \t]*(.*)$",
}
KEBAB_NAME = r"^(?:[A-Z]+-[0-9]+-)?[a-z0-9]+(?:-[a-z0-9]+)*\.md$"
