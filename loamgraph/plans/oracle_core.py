"""DuckDB SQL that states the training-data queries of the core independently of the Spark code."""

from __future__ import annotations

from loamgraph.functions.keys import content_hash_sql, path_key_sql
from loamgraph.operators.drift import RENAMES, TABLE_TYPES

P1_FOUND = f"""
WITH runs AS (SELECT DISTINCT run_id, prefix, started_at, status FROM build_runs),
ordered AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY started_at, run_id) AS n FROM runs),
rows_ AS (SELECT DISTINCT snap_id, run_id, {path_key_sql('path')} AS path, {content_hash_sql('hash')} AS hash, size, mtime_ms FROM snapshots),
held AS (SELECT * FROM rows_ WHERE path <> '' QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY snap_id DESC) = 1),
listed AS (
  SELECT o.prefix, o.run_id, o.status, o.n, h.path,
    coalesce(last_value(h.hash IGNORE NULLS) OVER (PARTITION BY o.prefix, h.path ORDER BY o.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      'stat:' || coalesce(h.size::VARCHAR, '') || ':' || coalesce(h.mtime_ms::VARCHAR, '')) AS version
  FROM held h JOIN ordered o USING (run_id)),
ok AS (SELECT prefix, run_id, lag(run_id) OVER (PARTITION BY prefix ORDER BY started_at, run_id) AS before FROM runs WHERE status = 'ok')
SELECT DISTINCT l.run_id, l.path
FROM listed l JOIN ok USING (run_id)
LEFT JOIN listed b ON b.run_id = ok.before AND b.path = l.path
WHERE ok.before IS NOT NULL AND (b.path IS NULL OR b.version IS DISTINCT FROM l.version)
"""

P2_FOUND = f"""
WITH refs AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_id, 'source' AS ref_field, {path_key_sql('source')} AS k, seen_at AS ts FROM edges
  UNION SELECT 'edges', edge_id, 'target', {path_key_sql('target')}, seen_at FROM edges
  UNION SELECT 'record_links', link_id, 'node', {path_key_sql('node')}, linked_at FROM record_links),
due AS (SELECT *, date_trunc('month', ts) + INTERVAL 1 MONTH AS nxt FROM refs WHERE k <> '' AND ts IS NOT NULL),
parents AS (SELECT DISTINCT {path_key_sql('id')} AS k, first_seen, removed_at FROM nodes),
live AS (SELECT DISTINCT d.k, d.nxt FROM due d JOIN parents p ON p.k = d.k AND p.first_seen < d.nxt AND (p.removed_at IS NULL OR p.removed_at >= d.nxt))
SELECT DISTINCT ref_table, ref_id, ref_field, strftime(ts, '%Y-%m') AS period
FROM due d WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.k = d.k AND l.nxt = d.nxt) AND NOT EXISTS (SELECT 1 FROM modules m WHERE {path_key_sql('m.module_id')} = d.k)
"""

P2_COUNTS = f"SELECT ref_table, ref_field, period, count(*) AS n_orphans FROM ({P2_FOUND}) GROUP BY ALL"

P2_TRANSITIONS = f"""
WITH refs AS (
  SELECT 'edges' AS t, edge_id AS i, 'source' AS f, {path_key_sql('source')} AS k, seen_at AS ts FROM edges
  UNION SELECT 'edges', edge_id, 'target', {path_key_sql('target')}, seen_at FROM edges
  UNION SELECT 'record_links', link_id, 'node', {path_key_sql('node')}, linked_at FROM record_links),
due AS (SELECT k, date_trunc('month', ts) + INTERVAL 1 MONTH AS nxt, count(*) AS n FROM refs WHERE k <> '' AND ts IS NOT NULL GROUP BY ALL),
parents AS (SELECT DISTINCT node_key, {path_key_sql('id')} AS k, first_seen AS b, removed_at AS g FROM nodes),
solid AS (SELECT * FROM parents WHERE k <> '' AND b IS NOT NULL AND (g IS NULL OR g > b)),
ends AS (SELECT k, date_trunc('month', b) + INTERVAL 1 MONTH AS e FROM solid UNION SELECT k, date_trunc('month', g) + INTERVAL 1 MONTH FROM solid WHERE g IS NOT NULL),
at_ends AS (SELECT x.k, x.e, count(*) FILTER (WHERE p.b < x.e AND (p.g IS NULL OR p.g >= x.e)) > 0 AS now,
  count(*) FILTER (WHERE p.b < x.e - INTERVAL 1 MONTH AND (p.g IS NULL OR p.g >= x.e - INTERVAL 1 MONTH)) > 0 AS was FROM ends x JOIN solid p USING (k) GROUP BY ALL)
SELECT a.k AS key, strftime(a.e - INTERVAL 1 MONTH, '%Y-%m') AS period, CASE WHEN a.now THEN 'resolved' ELSE 'reopened' END AS event, sum(d.n)::BIGINT AS n_refs
FROM at_ends a JOIN due d ON d.k = a.k AND d.nxt < a.e WHERE a.now <> a.was GROUP BY ALL
"""

# A field outside the migration rules means itself. Types of null values come from the field's last value while it, or the field it was
# renamed from, is there without a gap.
_MEANINGS = ", ".join(f"('{a}', '{c}')" for c, names in RENAMES.items() for a in [c, *names])
_FIELDS = f"""al(name, canon) AS (VALUES {_MEANINGS}),
ok AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY written_at NULLS FIRST, record_id) AS n
  FROM (SELECT DISTINCT stream, written_at, record_id, payload FROM build_records WHERE stream IS NOT NULL AND record_id IS NOT NULL) WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
ky AS (SELECT stream, n, record_id, written_at, payload, unnest(json_keys(payload)) AS name FROM ok),
kd AS (SELECT stream, n, record_id, name, coalesce(canon, name) AS meaning, CASE json_type(payload, '$."' || name || '"') WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array'
  WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END AS kind FROM ky LEFT JOIN al USING (name))"""

P4_FOUND = f"""
WITH {_FIELDS},
ru AS (SELECT *, n - dense_rank() OVER (PARTITION BY stream, meaning ORDER BY n) AS run FROM kd),
fl AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY stream, meaning, run ORDER BY n) AS known FROM ru),
gone AS (SELECT b.stream, b.n + 1 AS n, b.name, b.meaning, b.known FROM fl b JOIN ok o ON o.stream = b.stream AND o.n = b.n + 1 LEFT JOIN kd a ON a.stream = b.stream AND a.n = b.n + 1 AND a.name = b.name WHERE a.name IS NULL),
new AS (SELECT a.stream, a.n, a.record_id, a.name, a.meaning, a.kind FROM kd a LEFT JOIN kd b ON b.stream = a.stream AND b.n = a.n - 1 AND b.name = a.name WHERE b.name IS NULL AND a.n > 1),
moved AS (SELECT w.stream, w.n, w.record_id, w.name, g.name AS was FROM new w JOIN gone g ON g.stream = w.stream AND g.n = w.n AND g.meaning = w.meaning AND (g.known IS NULL OR w.kind IS NULL OR g.known = w.kind))
SELECT stream, record_id, name AS field_name, 'renamed' AS change_kind FROM moved
UNION SELECT w.stream, w.record_id, w.name, 'added' FROM new w LEFT JOIN moved m ON m.stream = w.stream AND m.n = w.n AND m.name = w.name WHERE m.name IS NULL
UNION SELECT g.stream, o.record_id, g.name, 'removed' FROM gone g JOIN ok o ON o.stream = g.stream AND o.n = g.n LEFT JOIN moved m ON m.stream = g.stream AND m.n = g.n AND m.was = g.name WHERE m.was IS NULL
UNION SELECT a.stream, a.record_id, a.name, 'retyped' FROM kd a JOIN fl b ON b.stream = a.stream AND b.n = a.n - 1 AND b.name = a.name WHERE a.kind <> b.known
"""

_WANTED = ", ".join(f"('{c}', '{ {'bigint': 'integer', 'double': 'decimal', 'string': 'string', 'boolean': 'boolean', 'array<string>': 'array'}[t] }', {k})" for k, (c, t) in enumerate(TABLE_TYPES.items()))
_PLACES = ", ".join(f"('{a}', {k})" for names in RENAMES.items() for k, a in enumerate([names[0], *names[1]]))
P4_VERSIONS = f"""
WITH {_FIELDS}, wanted(canon, want, k) AS (VALUES {_WANTED}), places(name, place) AS (VALUES {_PLACES}),
sc AS (SELECT o.stream, o.n, o.record_id, o.written_at, (SELECT list_sort(list((name, kind))) FROM kd WHERE kd.stream = o.stream AND kd.n = o.n) AS schema FROM ok o),
fs AS (SELECT stream, schema, min(n) AS n, count(*) AS n_records FROM sc GROUP BY ALL),
og AS (SELECT f.stream, f.n, k.meaning, min(p.place) AS place, arg_min(k.kind, p.place) AS kind FROM fs f JOIN kd k ON k.stream = f.stream AND k.n = f.n JOIN places p USING (name) GROUP BY ALL),
st AS (SELECT f.stream, f.n, sum(CASE WHEN o.place IS NULL THEN 1 WHEN o.kind IS NULL THEN o.place ELSE o.place + (o.kind <> w.want)::INT END)::INT AS n_steps FROM fs f CROSS JOIN wanted w LEFT JOIN og o ON o.stream = f.stream AND o.n = f.n AND o.meaning = w.canon GROUP BY ALL)
SELECT f.stream, o.record_id AS first_record_id, o.written_at AS first_written_at, f.n_records, s.n_steps FROM fs f JOIN ok o ON o.stream = f.stream AND o.n = f.n JOIN st s ON s.stream = f.stream AND s.n = f.n
"""


def _table_sql() -> str:
    """The one table: of each canonical field the first of its names that a payload has, cast; what is left over, or cannot be cast, as JSON by name."""
    import re

    cols, lost = [], []
    for name, kind in TABLE_TYPES.items():
        names = [name, *RENAMES[name]]
        present = f"list_filter([{', '.join(repr(n) for n in names)}], lambda x: list_contains(keys, x))[1]"
        raw = f"json_extract(payload, '$.\"' || {present} || '\"')"
        text, typ = f"json_extract_string(payload, '$.\"' || {present} || '\"')", f"json_type(payload, '$.\"' || {present} || '\"')"
        scalar = f"{typ} NOT IN ('ARRAY', 'OBJECT', 'NULL')"
        if kind == "bigint":
            value = f"CASE WHEN {typ} = 'BOOLEAN' THEN ({text} = 'true')::BIGINT WHEN {typ} = 'DOUBLE' THEN trunc(TRY_CAST({text} AS DOUBLE))::BIGINT WHEN {scalar} THEN TRY_CAST({text} AS BIGINT) END"
        elif kind == "double":
            value = f"CASE WHEN {typ} = 'BOOLEAN' THEN ({text} = 'true')::DOUBLE WHEN {scalar} THEN TRY_CAST({text} AS DOUBLE) END"
        elif kind == "boolean":
            value = f"CASE WHEN {typ} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST({text} AS DOUBLE) <> 0 WHEN {scalar} THEN TRY_CAST({text} AS BOOLEAN) END"
        elif kind == "string":
            value = f"CASE WHEN {scalar} THEN {text} END"
        else:
            value = f"CASE WHEN {typ} = 'ARRAY' THEN CAST(from_json({raw}, '[\"VARCHAR\"]') AS VARCHAR[]) WHEN {typ} = 'VARCHAR' THEN [{text}] END"
        column = re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), name)
        cols.append(f"{value} AS {column}")
        bent = {"bigint": f" OR {typ} IN ('DOUBLE', 'BOOLEAN')", "double": f" OR {typ} = 'BOOLEAN'"}.get(kind, "")  # cast, but not without a loss
        lost.append(f"WHEN k = {present} THEN {typ} <> 'NULL' AND ({column} IS NULL{bent})")
    return f"""
WITH ok AS (SELECT *, json_keys(payload) AS keys FROM (SELECT DISTINCT record_id, stream, prefix, written_at, payload FROM build_records WHERE stream IS NOT NULL AND record_id IS NOT NULL) WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
tb AS (SELECT *, {", ".join(cols)} FROM ok),
ex AS (SELECT record_id, string_agg('"' || k || '":' || CASE WHEN json_type(payload, '$."' || k || '"') = 'OBJECT'
  THEN '{{' || array_to_string(list_transform(list_sort(json_keys(payload, '$."' || k || '"')), lambda n: '"' || n || '":' || json_extract(payload, '$."' || k || '"."' || n || '"')::VARCHAR), ',') || '}}'
  ELSE json_extract(payload, '$."' || k || '"')::VARCHAR END, ',' ORDER BY k) AS x FROM (SELECT *, unnest(keys) AS k FROM tb) WHERE CASE {" ".join(lost)} ELSE true END GROUP BY record_id)
SELECT record_id, stream, prefix, written_at, {", ".join(c.rsplit(" AS ", 1)[1] for c in cols)}, '{{' || coalesce(x, '') || '}}' AS extras FROM tb LEFT JOIN ex USING (record_id)
"""


P4_TABLE = _table_sql()
