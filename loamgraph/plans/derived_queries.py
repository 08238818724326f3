"""Queries of operators whose input no table holds as such: it is built from the tables, whole, and stated in DuckDB SQL again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import SIGNATURE_KEYWORDS, SIGNATURE_MODIFIERS, base_name, parent_dir, short_number, thousands, trim_signature
from loamgraph.operators import extract, proofs, records, resolve, rollups, textsearch, workspace
from loamgraph.plans import graph_queries as G
from loamgraph.plans.sql import EDGES, FILES, LINKS, NODES, TERMS, records_sql, statement
from loamgraph.sources import repository
from loamgraph.sources.relations import Relations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


_FILE_OF = "regexp_replace({c}, '#.*$', '')"
_DIR = "CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END"


def _file(c: str):
    return F.regexp_replace(c, r"#.*$", "")


# --- sources ---------------------------------------------------------------------------------------------------------


@query("s9_script_blocks", statement(FILES, select="SELECT path, 3 AS start_line, content AS code FROM gf WHERE suffix(path, '.js') AND content IS NOT NULL AND NOT contains(lower(content), '</script') AND NOT contains(lower(content), '<script')"))
def s9_script_blocks(r: Relations) -> DataFrame:
    """Every script inside a page, as a component file would hold it; those that speak of script tags themselves are no pages."""
    js = r.files.where(F.col("path").endswith(".js") & F.col("content").isNotNull() & ~F.lower("content").contains("<script") & ~F.lower("content").contains("</script"))
    return repository.script_blocks(js.select("path", F.concat(F.lit("<main>\n</main>\n<script lang='js'>"), "content", F.lit("</script>\n")).alias("text")))


@query("s10_shell_functions", statement(NODES, select="SELECT path || '.sh' AS path, start_line AS line, name FROM gn WHERE kind IN ('function', 'method') AND regexp_full_match(name, '[A-Za-z_][\\w.:-]*')"))
def s10_shell_functions(r: Relations) -> DataFrame:
    """Every function as a shell would define it, half of them with the keyword."""
    text = F.when(F.col("kind") == "method", F.concat(F.lit("function "), "name", F.lit(" {"))).otherwise(F.concat(F.lit("  "), "name", F.lit("() {")))
    return repository.shell_functions(r.nodes.where("kind in ('function', 'method')").select(F.concat("path", F.lit(".sh")).alias("path"), F.col("start_line").alias("line"), text.alias("text")))


@query("s12_diff_ranges", statement(NODES, select="SELECT node_key AS diff_id, path, greatest(1, start_line) AS start_line, greatest(start_line, end_line) AS end_line FROM gn WHERE kind <> 'file' AND start_line IS NOT NULL AND end_line IS NOT NULL"))
def s12_diff_ranges(r: Relations) -> DataFrame:
    """A diff for every symbol that changes its lines."""
    rows = r.symbols.where("start_line is not null and end_line is not null")
    hunk = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1,2 +"), "start_line", F.lit(","), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1), F.lit(" @@ f\n+x\n"))
    return repository.diff_ranges(rows.select(F.col("node_key").alias("diff_id"), hunk.alias("text")))


@query("s12_diff_files", statement(LINKS, select="SELECT link_id AS diff_id, CASE level WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status, CASE WHEN level = 2 THEN name END AS old_path, path FROM lk WHERE path <> '' AND name <> ''"))
def s12_diff_files(r: Relations) -> DataFrame:
    """A name-status line for every record link."""
    rows = r.links.where("path <> '' and name <> ''")
    line = F.concat(F.when(F.col("level") == 0, "A").when(F.col("level") == 1, "D").when(F.col("level") == 2, F.concat(F.lit("R087\t"), "name")).otherwise("M"), F.lit("\t"), "path")
    return repository.diff_files(rows.select(F.col("link_id").alias("diff_id"), line.alias("text")))


@query("s14_commit_log", statement(NODES, select="SELECT id AS sha, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS at, kind AS person, path FROM gn WHERE kind <> 'class' AND first_seen IS NOT NULL"))
def s14_commit_log(r: Relations) -> DataFrame:
    """A commit for every node; those of classes are by a bot."""
    person = F.when(F.col("kind") == "class", "dependabot[bot]").otherwise(F.col("kind"))
    head = F.concat(F.lit("\x01"), "id", F.lit("\x02"), F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00\x02"), person, F.lit("\x02"), "kind", F.lit("@example.com\n\n"), "path", F.lit("\n"))
    got = repository.commit_log(r.nodes.where("first_seen is not null").select(F.col("node_key").alias("log_id"), head.alias("text")))
    return got.select("sha", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "person", "path")


@query("f8_handles", statement(NODES, select="SELECT id, CASE WHEN kind = 'method' THEN kind || '-' || node_key END AS handle FROM gn"))
def f8_handles(r: Relations) -> DataFrame:
    mail = F.when(F.col("kind") == "method", F.concat(F.lit("17+"), "kind", F.lit("-"), "node_key", F.lit("@users.noreply.example.com"))).otherwise(F.concat("kind", F.lit("@example.com")))
    return r.nodes.select("id", repository.handle_of(mail).alias("handle"))


@query("s16_concepts", statement(LINKS, select="SELECT link_id AS doc_id, name AS title, path || ';' || via AS sources, via AS links, 'About ' || name AS snippet FROM lk WHERE path <> '' AND name <> '' AND via <> ''"))
def s16_concepts(r: Relations) -> DataFrame:
    """A concept document for every record link."""
    text = F.concat(F.lit("---\ntitle: \""), "name", F.lit("\"\nsources:\n  - "), "path", F.lit("\n  - "), "via", F.lit("\nlinks: ["), "via", F.lit("]\n---\n\n# Head\n\nAbout "), "name", F.lit("\nMore.\n"))
    got = repository.concept_documents(r.links.where("path <> '' and name <> '' and via <> ''").select(F.col("link_id").alias("doc_id"), text.alias("text")))
    return got.select("doc_id", "title", F.array_join("sources", ";").alias("sources"), F.array_join("links", ";").alias("links"), "snippet")


@query("a20_parsed_savings", f"SELECT DISTINCT doc_id, n_chars + 2500.0 * (doc_id + 1) AS saved FROM documents WHERE n_chars >= 0")
def a20_parsed_savings(r: Relations) -> DataFrame:
    """Savings that a text states, in a text for every document."""
    text = F.concat(F.lit("~"), "n_chars", F.lit(" tokens saved, and ~"), (F.col("doc_id") + 1) * 25, F.lit("00 tokens saved"))
    return rollups.parsed_savings(r.documents.where("n_chars >= 0").select("doc_id", text.alias("text")))


@query("s13_diff_base", statement(LINKS, select="SELECT link_id FROM lk WHERE CASE WHEN EXISTS (SELECT 1 FROM lk WHERE level > 8) THEN level > 8 WHEN EXISTS (SELECT 1 FROM lk WHERE level = 4) THEN level = 4 ELSE level = 3 END"))
def s13_diff_base(r: Relations) -> DataFrame:
    """Links of a level stand for the files of a diff: against the base, which is empty, of the working tree, of the last commit."""
    return workspace.first_with_rows([r.links.where(c).select("link_id") for c in ("level > 8", "level = 4", "level = 3")])


@query("fn_numbers", "SELECT DISTINCT doc_id, format('{:,}', n_chars) AS full_, CASE WHEN n_chars < 1000 THEN n_chars::VARCHAR WHEN (n_chars + 50) // 100 < 100 THEN ((n_chars + 50) // 100 // 10) || '.' || ((n_chars + 50) // 100 % 10) || 'k' ELSE ((n_chars + 500) // 1000) || 'k' END AS short FROM documents WHERE n_chars >= 0")
def fn_numbers(r: Relations) -> DataFrame:
    return r.documents.where("n_chars >= 0").select("doc_id", thousands("n_chars").alias("full_"), short_number("n_chars").alias("short"))


_SIG = f"regexp_replace(regexp_replace(trim(signature), '^(?:(?:{'|'.join(SIGNATURE_MODIFIERS)}) \\s*)*', ''), '^(?:{'|'.join(SIGNATURE_KEYWORDS)}) \\s*', '')"


@query("fn_signatures", statement(NODES, f"sg AS (SELECT id, name, {_SIG} AS s FROM gn WHERE kind <> 'file')", select="SELECT id, nullif(CASE WHEN starts_with(s, coalesce(name, '')) THEN regexp_replace(ltrim(substr(s, length(coalesce(name, '')) + 1)), '^= ', '') ELSE s END, '') AS rest FROM sg"))
def fn_signatures(r: Relations) -> DataFrame:
    return r.symbols.select("id", trim_signature("name", "signature").alias("rest"))


# --- workspaces and resolution ---------------------------------------------------------------------------------------

_MARKS = ", ".join(f"'{m}'" for m in workspace.MARKERS)


@query("g13_scopes", f"SELECT prefix, array_to_string(list_sort(list(DISTINCT m)), ';') AS markers FROM (SELECT prefix, unnest(markers) AS m FROM scopes) WHERE m IN ({_MARKS}) GROUP BY prefix")
def g13_scopes(r: Relations) -> DataFrame:
    """Scopes from the markers that lie among the files of each prefix."""
    marks = r.scopes.select(F.explode(F.transform("markers", lambda m: F.concat("prefix", F.lit("/"), m))).alias("path"))
    return workspace.discover_scopes(marks.unionByName(r.files.select("path"))).select("prefix", F.array_join("markers", ";").alias("markers"))


_USES = f"us AS (SELECT edge_id AS use_id, {_FILE_OF.format(c='target')} AS path, regexp_replace(target, '^.*[#.]', '') AS name, regexp_extract(target, '#(.*)\\.[^.]*$', 1) AS owner FROM ge WHERE relation = 'calls' AND contains(target, '#'))"


@query(
    "j26_bindings",
    statement(
        NODES, EDGES, _USES, "bd AS (SELECT path, coalesce(owner, '') AS scope, name, count(DISTINCT kind) AS n, min(kind) AS type FROM gn WHERE kind <> 'file' GROUP BY ALL)",
        select="SELECT u.use_id, CASE WHEN i.n IS NOT NULL THEN i.type ELSE o.type END AS type FROM us u LEFT JOIN bd i ON i.path = u.path AND i.scope = u.owner AND i.name = u.name AND u.owner <> '' LEFT JOIN bd o ON o.path = u.path AND o.scope = '' AND o.name = u.name WHERE coalesce(i.n, o.n) = 1",
    ),
)
def j26_bindings(r: Relations) -> DataFrame:
    """What each called name is bound to: in the class it is called on, else at the top of its file."""
    calls = r.edges.where("relation = 'calls' and contains(target, '#')")
    owner = F.nullif(F.regexp_extract("target", r"#(.*)\.[^.]*$", 1), F.lit(""))
    uses = calls.select(F.col("edge_id").alias("use_id"), _file("target").alias("path"), F.regexp_replace("target", r"^.*[#.]", "").alias("name"), F.array_compact(F.array(F.lit(""), owner)).alias("scopes"))
    return workspace.nearest_bindings(uses, r.symbols.select("path", F.coalesce("owner", F.lit("")).alias("scope"), "name", F.col("kind").alias("type")))


_IMPORTS = f"im AS (SELECT edge_id AS ref_id, {_FILE_OF.format(c='source')} AS path, {_FILE_OF.format(c='target')} AS target FROM ge WHERE relation = 'imports' AND contains({_FILE_OF.format(c='target')}, '/'))"


def _imports(r: Relations) -> DataFrame:
    return r.edges.where("relation = 'imports'").select(F.col("edge_id").alias("ref_id"), _file("source").alias("path"), _file("target").alias("to")).where(F.col("to").contains("/"))


@query(
    "j36_go_imports",
    statement(
        EDGES, FILES, _IMPORTS, f"go AS (SELECT {_DIR.format(p='path')} AS dir, min(path) AS target FROM gf WHERE suffix(path, '.go') AND NOT suffix(path, '_test.go') GROUP BY 1)",
        f"sp AS (SELECT ref_id, {_DIR.format(p='target')} AS dir FROM im)", select="SELECT s.ref_id, g.target FROM sp s JOIN go g USING (dir) WHERE split_part(s.dir, '/', 1) IN (SELECT prefix FROM scopes)",
    ),
)
def j36_go_imports(r: Relations) -> DataFrame:
    """Imports of the folder a target lies in, every prefix a module of its own."""
    modules = r.scopes.select(F.concat(F.lit("host.example/"), "prefix").alias("module"), F.col("prefix").alias("folder"))
    return workspace.go_imports(_imports(r).select("ref_id", F.concat(F.lit("host.example/"), parent_dir("to")).alias("spec")), modules, r.files)


@query(
    "j38_includes",
    statement(
        EDGES, FILES, _IMPORTS, "fp AS (SELECT DISTINCT path FROM gf)", "sp AS (SELECT ref_id, regexp_replace(path, '[^/]*$', '') || regexp_extract(target, '[^/]*$') AS near, regexp_extract(target, '[^/]*$') AS spec FROM im)",
        "un AS (SELECT regexp_extract(path, '[^/]*$') AS spec, min(path) AS path FROM fp GROUP BY 1 HAVING count(*) = 1)",
        select="SELECT s.ref_id, coalesce(f.path, u.path) AS target FROM sp s LEFT JOIN fp f ON f.path = s.near LEFT JOIN un u ON u.spec = s.spec WHERE coalesce(f.path, u.path) IS NOT NULL",
    ),
)
def j38_includes(r: Relations) -> DataFrame:
    return workspace.includes(_imports(r).select("ref_id", "path", base_name("to").alias("spec")), r.files)


_TAILS = """fp AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM gf),
te AS (SELECT DISTINCT path, array_to_string(list_slice(s, len(s) - k + 1, len(s)), '/') AS tail, k FROM (SELECT path, s, unnest([1, 2, 3]) AS k FROM fp) WHERE k <= len(s))"""


@query(
    "j39_tail_imports",
    statement(
        EDGES, FILES, _IMPORTS, _TAILS, "sp AS (SELECT ref_id, string_split(target, '/') AS s FROM im)", "wt AS (SELECT ref_id, k, CASE k WHEN 3 THEN 'none/' || s[-2] || '/' || s[-1] WHEN 2 THEN s[-2] || '/' || s[-1] ELSE s[-1] END AS tail FROM (SELECT ref_id, s, unnest([1, 2, 3]) AS k FROM sp))",
        "ct AS (SELECT tail, count(*) AS n, min(path) AS target FROM te GROUP BY tail)", "bs AS (SELECT w.ref_id, arg_max(c.n, w.k) AS n, arg_max(c.target, w.k) AS target FROM wt w JOIN ct c USING (tail) GROUP BY w.ref_id)",
        select="SELECT ref_id, target FROM bs WHERE n = 1",
    ),
)
def j39_tail_imports(r: Relations) -> DataFrame:
    """Qualified names whose last parts are a folder and a file, below a root that no file has."""
    two = F.regexp_extract("to", r"([^/]+/[^/]+)$", 1)
    return workspace.tail_imports(_imports(r).select("ref_id", F.concat(F.lit("none/"), two).alias("tail")), r.files)


@query(
    "j40_use_paths",
    statement(
        EDGES, FILES, _IMPORTS, _TAILS, "sp AS (SELECT ref_id, split_part(path, '/', 1) AS root, string_split(target, '/') AS s FROM im WHERE split_part(path, '/', 1) IN (SELECT prefix FROM scopes))",
        "wt AS (SELECT ref_id, root, k, CASE k WHEN 2 THEN s[-2] || '/' || s[-1] ELSE s[-1] END AS tail FROM (SELECT ref_id, root, s, unnest([1, 2]) AS k FROM sp))",
        "ct AS (SELECT split_part(path, '/', 1) AS root, tail, count(*) AS n, min(path) AS target FROM te GROUP BY ALL)", "bs AS (SELECT w.ref_id, arg_max(c.n, w.k) AS n, arg_max(c.target, w.k) AS target FROM wt w JOIN ct c USING (root, tail) GROUP BY w.ref_id)",
        select="SELECT ref_id, target FROM bs WHERE n = 1",
    ),
)
def j40_use_paths(r: Relations) -> DataFrame:
    """Paths inside the package that holds the using file: the package by its root, the file by the longest tail within it."""
    refs = _imports(r).select("ref_id", "path", F.regexp_extract("to", r"([^/]+/[^/]+)$", 1).alias("tail"))
    return workspace.package_imports(refs, r.scopes.select(F.col("prefix").alias("root")), r.files)


@query(
    "j8_exports",
    statement(
        NODES, f"ex AS (SELECT DISTINCT path, name, id FROM gn WHERE kind <> 'file' AND exported AND contains(path, '/'))", f"br AS (SELECT {_DIR.format(p='path')} AS dir, name, count(DISTINCT id) AS n, min(id) AS id FROM ex GROUP BY ALL)",
        select="SELECT dir || '/index#' || name AS ref_id, id, 2 AS hops FROM br WHERE n = 1",
    ),
)
def j8_exports(r: Relations) -> DataFrame:
    """Every exported name asked of an index of its folder, which passes on what a barrel passes on from the files; the barrel and the index name each other."""
    ex = r.symbols.where("exported").where(F.col("path").contains("/")).select("path", "name", "id", parent_dir("path").alias("dir")).distinct()
    index, barrel = F.concat("dir", F.lit("/index")), F.concat("dir", F.lit("/barrel"))
    wanted = ex.select(F.concat(index, F.lit("#"), "name").alias("ref_id"), index.alias("path"), "name").distinct()
    star = F.lit("*")
    passed = ex.select(barrel.alias("path"), star.alias("name"), F.col("path").alias("source"), star.alias("source_name")).distinct()
    passed = passed.unionByName(ex.select(index.alias("path"), star.alias("name"), barrel.alias("source"), star.alias("source_name")).distinct()).unionByName(ex.select(barrel.alias("path"), star.alias("name"), index.alias("source"), star.alias("source_name")).distinct())
    return resolve.resolve_exports(wanted, ex.select("path", "name", "id"), passed)


# --- answers ---------------------------------------------------------------------------------------------------------


@query(
    "t6_pages",
    statement(
        NODES, EDGES, "dg AS (SELECT split_part(target, '/', 1) AS query, regexp_replace(target, '#.*$', '') AS path, count(*) AS score FROM ge GROUP BY ALL)", "sy AS (SELECT split_part(path, '/', 1) AS query, path, count(*) AS score FROM gn GROUP BY ALL)",
        "pg AS (SELECT query, path, (row_number() OVER (PARTITION BY query ORDER BY score DESC, path) - 1) // 10 + 1 AS page FROM dg UNION ALL SELECT query, path, (row_number() OVER (PARTITION BY query ORDER BY score DESC, path) - 1) // 50 + 1 FROM sy)",
        select="SELECT query, path, min(page) AS page FROM pg GROUP BY query, path",
    ),
)
def t6_pages(r: Relations) -> DataFrame:
    first = lambda c: F.substring_index(c, "/", 1)
    exact = r.edges.groupBy(first("target").alias("query"), _file("target").alias("path")).agg(F.count("*").alias("score"))
    ranked = r.nodes.groupBy(first("path").alias("query"), "path").agg(F.count("*").alias("score"))
    return workspace.paged(exact, ranked)


_NAME = "rebuildBinding"


@query(
    "x14_definition",
    statement(
        NODES, EDGES, "dg AS (SELECT target, count(*) AS d FROM ge WHERE relation <> 'contains' GROUP BY target)",
        select=f"SELECT n.id, n.path, n.start_line, n.end_line, n.name = '{_NAME}' AS exact, coalesce(d, 0) AS in_degree FROM gn n LEFT JOIN dg ON dg.target = n.id WHERE kind <> 'file' AND lower(name) = '{_NAME.lower()}' ORDER BY exact DESC, {G._TEST_ASK.format(p='n.path')}, coalesce(exported, false) DESC, coalesce(d, 0) DESC, n.path, start_line, n.id LIMIT 5",
    ),
)
def x14_definition(r: Relations) -> DataFrame:
    """The five best definitions of a name, a top-k report."""
    from loamgraph.operators.graph import in_degree

    return workspace.definition_lookup(r.nodes, in_degree(r.walk), _NAME)


@query(
    "v7_context_check",
    statement(
        FILES, NODES, LINKS, G._LAST, "ms AS (SELECT DISTINCT path, hash FROM bf)", "nw AS (SELECT path, max(hash) AS h FROM gf GROUP BY path)",
        "pb AS (SELECT DISTINCT id FROM gn WHERE kind <> 'file' AND exported)",
        select="SELECT count(*) FILTER (n.path IS NULL) AS removed, count(*) FILTER (n.path IS NOT NULL AND m.hash IS DISTINCT FROM n.h) AS drifted, (SELECT round(count(*) FILTER (id IN (SELECT node FROM lk WHERE node IS NOT NULL)) / count(*), 6) FROM pb) AS coverage FROM ms m LEFT JOIN nw n USING (path)",
    ),
)
def v7_context_check(r: Relations) -> DataFrame:
    """The last listing as the manifest of a context, record links as what its concepts cover."""
    files = r.files.groupBy("path").agg(F.max("hash").alias("hash"))
    got = workspace.context_check(G._last_listing(r), files, r.nodes, r.links.where("node <> ''").select(F.col("node").alias("id")))
    return got.select("removed", "drifted", F.round("coverage", 6).alias("coverage"))


_TESTY = "tn AS (SELECT id, CASE WHEN kind = 'class' THEN 'Test' || name WHEN kind = 'function' THEN 'test_' || name ELSE name END AS name, kind, 'tests/' || path AS path, start_line, end_line FROM gn)"


@query(
    "f6_inline_tests",
    statement(
        NODES, _TESTY,
        select="SELECT DISTINCT id FROM tn WHERE kind = 'function' AND suffix(path, '.py') UNION SELECT DISTINCT s.id FROM tn s JOIN tn h ON h.path = s.path AND h.kind = 'class' AND suffix(h.path, '.py') AND s.start_line >= h.start_line AND s.end_line <= h.end_line WHERE s.kind <> 'file'",
    ),
)
def f6_inline_tests(r: Relations) -> DataFrame:
    """Inline tests where every class and function is named as a test."""
    name = F.when(F.col("kind") == "class", F.concat(F.lit("Test"), "name")).when(F.col("kind") == "function", F.concat(F.lit("test_"), "name")).otherwise(F.col("name"))
    return workspace.inline_tests(r.nodes.withColumn("name", name).withColumn("path", F.concat(F.lit("tests/"), "path")))


_LINK_DOCS = "ld AS (SELECT link_id AS doc_id, 'See `' || name || '` in ' || path || ' and `' || coalesce(node, 'none') || '`.' AS text FROM lk WHERE name <> '' AND path <> '')"
_LINK_MENTIONS = """mn AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, '[A-Za-z0-9_.\\-]+(?:/[A-Za-z0-9_.\\-]+)+'), regexp_extract_all(text, '`([^`\\s]+)`', 1))) AS token FROM ld)"""


def _link_docs(r: Relations) -> DataFrame:
    text = F.concat(F.lit("See `"), "name", F.lit("` in "), "path", F.lit(" and `"), F.coalesce("node", F.lit("none")), F.lit("`."))
    return r.links.where("name <> '' and path <> ''").select(F.col("link_id").alias("doc_id"), text.alias("text"))


@query(
    "j20_static_links",
    statement(
        LINKS, NODES, _LINK_DOCS, _LINK_MENTIONS, "un AS (SELECT name AS token, min(id) AS id FROM gn WHERE kind <> 'file' GROUP BY name HAVING count(*) = 1)",
        "ht AS (SELECT m.doc_id, g.id, CASE WHEN g.kind = 'file' THEN 2 ELSE 0 END AS level FROM mn m JOIN gn g ON g.id = m.token UNION ALL SELECT m.doc_id, u.id, 0 FROM mn m JOIN un u USING (token))",
        select="SELECT doc_id, id, min(level) AS level FROM ht GROUP BY doc_id, id",
    ),
)
def j20_static_links(r: Relations) -> DataFrame:
    """Static links of texts that name what a record link names."""
    return records.static_links(_link_docs(r), r.nodes)


@query(
    "j19_file_mentions",
    statement(
        LINKS, FILES, _LINK_DOCS, _LINK_MENTIONS, "fp AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM gf)",
        "fr AS (SELECT path, path AS token, 1.0 AS w FROM fp UNION ALL SELECT path, s[-1], 0.6 FROM fp UNION ALL SELECT path, CASE WHEN strpos(substr(s[-1], 2), '.') > 0 THEN regexp_replace(s[-1], '\\.[^.]*$', '') ELSE s[-1] END, 0.3 FROM fp UNION ALL SELECT path, array_to_string(list_slice(s, 1, k), '/'), 0.1 FROM (SELECT path, s, unnest(range(1, len(s))) AS k FROM fp))",
        "fo AS (SELECT path, token, max(w) AS w FROM fr GROUP BY ALL)", "nf AS (SELECT token, count(*) AS n FROM fo GROUP BY token)",
        select="SELECT m.doc_id, f.path, round(sum(f.w / sqrt(n.n)), 6) AS weight FROM mn m JOIN fo f USING (token) JOIN nf n USING (token) GROUP BY ALL",
    ),
)
def j19_file_mentions(r: Relations) -> DataFrame:
    """File mentions of the same texts."""
    return records.file_mentions(_link_docs(r), r.files).select("doc_id", "path", G.r6("weight").alias("weight"))


_LATER = """d2 AS (SELECT DISTINCT doc_id, path, text FROM documents UNION ALL
  SELECT doc_id + 1000000000, path, '# Later ' || doc_id || chr(10) || 'Date: 2999-01-01' || chr(10) || chr(10) || 'Supersedes: ' || heading AS text FROM e0)"""


@query("j21_superseded", statement(records_sql("documents", "0"), "e0 AS (SELECT e.doc_id, e.heading, p.path FROM en0 e JOIN (SELECT DISTINCT doc_id, path FROM documents) p USING (doc_id))", _LATER, records_sql("d2", ""), select="SELECT doc_id, by_ AS \"by\" FROM gone"))
def j21_superseded(r: Relations) -> DataFrame:
    """What is superseded where every record has a successor that names its heading."""
    docs = r.documents.select("doc_id", "path", "text")
    entries = records.record_entries(docs).join(docs.select("doc_id", "path"), "doc_id")
    text = F.concat(F.lit("# Later "), "doc_id", F.lit("\nDate: 2999-01-01\n\nSupersedes: "), "heading")
    both = docs.unionByName(entries.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "path", text.alias("text")))
    return records.superseded(records.record_entries(both), both)


@query(
    "x22_federated_ask",
    statement(
        TERMS, G._LEX, "sc AS (SELECT l.id, split_part(g.path, '/', 1) AS child, g.path, round(l.lexical, 9) AS s FROM lex l JOIN gn g USING (id) WHERE l.lexical > 0)",
        "pa AS (SELECT child FROM sc GROUP BY child HAVING max(s) >= 0.25 * (SELECT max(s) FROM sc))", "fi AS (SELECT child, path, max(s) AS fs FROM sc WHERE child IN (SELECT child FROM pa) GROUP BY ALL)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY fs DESC, path) AS file_rank FROM fi)", "hi AS (SELECT s.*, r.fs, r.file_rank, row_number() OVER (PARTITION BY s.child, s.path ORDER BY s DESC, id) AS turn FROM sc s JOIN rk r USING (child, path))",
        "po AS (SELECT *, row_number() OVER (ORDER BY (id = (SELECT arg_max(id, (s, id)) FROM sc)) DESC, turn, file_rank, fs DESC, child, path) AS position FROM hi)",
        select="SELECT position, child, id, path, file_rank, round(61.0 / (60 + file_rank), 6) AS share FROM po WHERE position <= 20",
    ),
)
def x22_federated_ask(r: Relations) -> DataFrame:
    """The answer of a workspace whose prefixes are its members, a top-k report of twenty."""
    scored = r.lexical(G.QUESTION).join(r.nodes.select("id", "path", F.substring_index("path", "/", 1).alias("child")), "id").select("child", "id", "path", F.round("lexical", 9).alias("score"))
    return textsearch.federated(scored, limit=20).withColumn("share", G.r6("share"))


# --- extraction and proofs -------------------------------------------------------------------------------------------


@query("s7_symbols")
def s7_symbols(r: Relations) -> DataFrame:
    """Declarations of all source files. SQL cannot parse them; the tests hold fixtures of five languages, and ``s7_agreement`` compares with the table of nodes."""
    return extract.extract_symbols(r.files).drop("variadic")


@query("s7_raw_edges")
def s7_raw_edges(r: Relations) -> DataFrame:
    return extract.extract_edges(r.files)


@query("s7_agreement")
def s7_agreement(r: Relations) -> DataFrame:
    """language, n_nodes, n_found, n_same: of the symbols that the nodes table has in the present files, how many are extracted at their line, and with the same kind, owner and arity."""
    ending = F.regexp_extract("path", r"\.(\w+)$", 1).alias("language")
    nodes = r.symbols.join(r.files.select("path").distinct(), "path", "left_semi").select("path", "name", "start_line", "kind", "owner", "arity")
    found = extract.extract_symbols(r.files.select("path", "content").distinct()).select("path", "name", "start_line", F.col("kind").alias("k"), F.col("owner").alias("o"), F.col("arity").alias("a")).dropDuplicates(["path", "name", "start_line"])
    both = nodes.join(found, ["path", "name", "start_line"], "left")
    same = (F.col("kind") == F.col("k")) & F.col("owner").eqNullSafe(F.col("o")) & F.col("arity").eqNullSafe(F.col("a"))
    return both.groupBy(ending).agg(F.count("*").alias("n_nodes"), F.count("k").alias("n_found"), F.count_if(same).alias("n_same"))


@query(
    "j27_j29_proven_calls",
    statement(
        NODES, FILES, "fn AS (SELECT node_key, id, path, name FROM gn WHERE kind = 'function' AND owner IS NULL AND exported AND regexp_matches(path, '/[^/]*\\.(js|ts|py)$') AND path IN (SELECT path FROM gf))",
        "un AS (SELECT path, name FROM gn WHERE kind <> 'file' AND owner IS NULL AND exported GROUP BY ALL HAVING count(DISTINCT id) = 1)",
        select="SELECT regexp_replace(path, '[^/]*$', '') || 'use_' || node_key || regexp_extract(path, '\\.[a-z]+$') AS path, id AS target, 'extracted' AS confidence FROM fn JOIN un USING (path, name)",
    ),
)
def j27_j29_proven_calls(r: Relations) -> DataFrame:
    """A file beside every exported function of a script or Python file that imports it under another name and calls it: each call leads to the function."""
    made = r.symbols.where("kind = 'function' and owner is null and exported").where(F.col("path").rlike(r"/[^/]*\.(js|ts|py)$")).join(r.files.select("path").distinct(), "path", "left_semi")
    base, ending = base_name("path"), F.regexp_extract("path", r"(\.[a-z]+)$", 1)
    script = F.concat(F.lit("import { "), "name", F.lit(" as q } from './"), base, F.lit("';\nexport function go() {\n  return q(1);\n}\n"))
    python = F.concat(F.lit("from ."), F.regexp_replace(base, r"\.py$", ""), F.lit(" import "), "name", F.lit(" as q\n\ndef go():\n    return q(1)\n"))
    users = made.select(F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.lit("use_"), "node_key", ending).alias("path"), F.when(ending == ".py", python).otherwise(script).alias("content"))
    symbols = r.symbols.select("path", "id", "name", "owner", "exported")
    return proofs.proven_calls(extract.extract_edges(users), symbols, r.files.select("path").unionByName(users.select("path"))).select("path", "target", "confidence")


@query(
    "g15_precision",
    statement(
        NODES, EDGES, G._RAW, *G._RESOLVED,
        "ju AS (SELECT j.confidence, e.target = j.target AS hit, e.target IN (SELECT id FROM gn) AS said FROM jn j JOIN ge e ON e.edge_id = j.ref_id WHERE j.target IS NOT NULL)",
        select='SELECT confidence, count(*) AS n, count(*) FILTER (said AND hit) AS "right", count(*) FILTER (said AND NOT hit) AS wrong, count(*) FILTER (NOT said) AS unverified FROM ju GROUP BY confidence',
    ),
)
def g15_precision(r: Relations) -> DataFrame:
    """Links resolved by name alone, judged by the targets that the edges state: an edge stands for a line, and says nothing if its target is no node."""
    calls = G._raw_calls(r)
    found = resolve.resolve_names(calls, r.symbols).join(calls, "ref_id").select("path", F.col("ref_id").alias("line"), "name", "target", "confidence")
    stated = r.edges.select(F.col("edge_id").alias("ref_id"), "target").join(r.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    oracle = calls.join(stated, "ref_id").select("path", F.col("ref_id").alias("line"), "name", "target")
    return proofs.judged(found, oracle)
