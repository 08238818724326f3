"""Building blocks of the DuckDB statements: the canonical relations as common table expressions."""

from __future__ import annotations

from loamgraph.functions.keys import content_hash_sql, path_key_sql
from loamgraph.functions.text import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(text: str) -> str:
    # RE2 has no look-ahead; a capital that follows a capital it split off needs a second pass
    # a capital I with a dot becomes two characters, as the Unicode rules have it
    spaced = f"lower(regexp_replace(regexp_replace(replace({text}, 'İ', 'i' || chr(775)), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))"
    return f"list_filter(regexp_extract_all({spaced}, '[a-z0-9][a-z0-9]+'), lambda t: t NOT IN ({STOPS}))"


NODE_ROWS = f"""nr AS (SELECT * FROM (SELECT DISTINCT node_key, {path_key_sql('id')} AS id, name, kind, {path_key_sql('path')} AS path, start_line, end_line, signature, exported, origin,
  body_hash, chars, body_text, summary_state, summary, crux, owner, arity, "variadic", first_seen, removed_at FROM nodes) WHERE id <> '')"""
NODES = NODE_ROWS + """,
gn AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY id ORDER BY first_seen DESC NULLS LAST, node_key DESC) = 1)"""
EDGES = f"""ge AS (SELECT * FROM (SELECT DISTINCT edge_id, {path_key_sql('source')} AS source, {path_key_sql('target')} AS target, relation, confidence, ord, seen_at FROM edges) WHERE source <> '' AND target <> '')"""
WALK = EDGES + """,
we AS (SELECT * FROM ge WHERE relation <> 'contains')"""
FILES = f"""gf AS (SELECT * FROM (SELECT DISTINCT file_id, prefix, {path_key_sql('path')} AS path, lang, size, mtime_ms, {content_hash_sql('hash')} AS hash, content FROM source_files) WHERE path <> '')"""
LINES = FILES + """,
gl AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (SELECT path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM gf WHERE content IS NOT NULL))"""
LINKS = f"""lk AS (SELECT DISTINCT link_id, entry, level, {path_key_sql('node')} AS node, {path_key_sql('path')} AS path, line, name, via, linked_at FROM record_links)"""
TERMS = NODES + f""",
tt AS (SELECT id, field, term, count(*) AS tf FROM (
  SELECT id, 'name' AS field, unnest({tokens_sql('name')}) AS term FROM gn UNION ALL
  SELECT id, 'path', unnest({tokens_sql('path')}) FROM gn UNION ALL
  SELECT id, 'body', unnest({tokens_sql('body_text')}) FROM gn) GROUP BY ALL)"""


def records_sql(docs: str = "documents", s: str = "") -> str:
    """Entries (``en``) and what supersedes what (``gone``) of documents, lines of fenced code left out; ``s`` ends the names."""
    return rf"""dl{s} AS MATERIALIZED (SELECT doc_id, path, line, text, fences % 2 = 1 AS fenced FROM (
  SELECT *, sum(starts_with(text, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS fences FROM (
    SELECT doc_id, path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (
      SELECT doc_id, path, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM (SELECT DISTINCT doc_id, path, text FROM {docs} WHERE text IS NOT NULL))))),
dt{s} AS (SELECT doc_id, arg_min(d, line) AS date FROM (SELECT doc_id, line, regexp_extract(text, '(\d{{4}}-\d{{2}}-\d{{2}})', 1) AS d FROM dl{s} WHERE NOT fenced AND contains(text, 'Date:')) WHERE d <> '' GROUP BY doc_id),
hl{s} AS (SELECT doc_id, line, length(regexp_extract(text, '^(#{{1,6}})[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]', 1)) AS level, trim(regexp_replace(text, '^#{{1,6}}\s+|\s+#*\s*$', '', 'g')) AS heading FROM dl{s} WHERE NOT fenced),
hd{s} AS (SELECT doc_id, arg_min(heading, line) AS heading, min(line) AS line FROM hl{s} WHERE level > 0 GROUP BY doc_id),
en{s} AS MATERIALIZED (SELECT d.doc_id, coalesce(h.line, 1) AS line, coalesce(h.heading, p.path) AS heading, d.date FROM dt{s} d JOIN (SELECT DISTINCT doc_id, path FROM {docs}) p USING (doc_id) LEFT JOIN hd{s} h USING (doc_id)),
ek{s} AS (SELECT doc_id, date, trim(regexp_replace(lower(heading), '[—–,\s]+', ' ', 'g')) AS h FROM en{s}),
ow{s} AS (SELECT DISTINCT doc_id, date, key FROM (SELECT doc_id, date, unnest([h, trim(regexp_replace(h, '^(adr-\d+:|\d{{4}}-\d{{2}}-\d{{2}})\s*', '')), regexp_extract(h, '^(adr-\d+)', 1)]) AS key FROM ek{s}) WHERE key <> ''),
nm{s} AS (SELECT doc_id AS by_, trim(regexp_replace(lower(unnest(regexp_extract_all(text, '(?i)\*{{0,2}}supersedes:?\*{{0,2}}:?\s*(.+)$', 1))), '[—–,\s]+', ' ', 'g')) AS key FROM dl{s} WHERE NOT fenced),
gone{s} AS (SELECT o.doc_id, min(n.by_) AS by_ FROM ow{s} o JOIN nm{s} n USING (key) JOIN en{s} b ON b.doc_id = n.by_ WHERE n.by_ <> o.doc_id AND b.date >= o.date GROUP BY o.doc_id)"""


RECORDS = records_sql()


def statement(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
