"""Queries of the code-graph operators over whole tables, each with the DuckDB statement that states it independently.

Names begin with the operator's id in the blueprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.keys import content_hash, content_hash_sql, path_key, path_key_sql
from loamgraph.functions.text import TEST_PATH_ASK, TEST_PATH_IMPACT, TEST_PATH_WHY, query_terms, tokens, under
from loamgraph.operators import freshness, graph, records, resolve, rollups, spans, textsearch
from loamgraph.plans import sql
from loamgraph.plans.sql import EDGES, FILES, LINES, LINKS, NODE_ROWS, NODES, RECORDS, TERMS, WALK, statement
from loamgraph.sources.relations import Relations, term_bag

QUESTION = "how does the cache resolve a stale session lock"
SYMBOL = "cursor-outline-1.js"
PATTERN = r"throw new|raise ValueError|panic\("
BEFORE, AFTER = "2025-07-01", "2026-01-01"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of :class:`Relations` as a query, with its statement if SQL can express it."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Relations(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- terms and ranked retrieval -------------------------------------------------------------------------------------

_Q = ", ".join(f"'{t}'" for t in query_terms(QUESTION))
_TEST_ASK = "regexp_matches({p}, '(?i)(^|/)(tests?|__tests__|spec)/|(_test|\\.test|\\.spec)\\.[a-z]+$|_tests\\.rs$|(^|/)tests?\\.rs$|(^|/)(test_[^/]+|conftest)\\.py$')"
_FACTOR = f"CASE WHEN {_TEST_ASK.format(p='path')} OR regexp_matches(path, '(^|/)scripts/') THEN 0.35 ELSE 1.0 END"
_LEX = f"""
st AS (SELECT (SELECT count(*) FROM gn) AS n_docs, (SELECT coalesce(sum(tf), 0) FROM tt WHERE field = 'body') / (SELECT count(*) FROM gn) AS avg_len),
df AS (SELECT term, count(DISTINCT id) AS df FROM tt GROUP BY term),
idf AS (SELECT term, df, ln(1 + n_docs / (1 + df)) AS idf FROM df, st),
dl AS (SELECT id, sum(tf) AS dl FROM tt WHERE field = 'body' GROUP BY id),
ps AS (SELECT t.id, t.field, t.tf, i.idf, coalesce(d.dl, 0) / st.avg_len AS norm FROM tt t JOIN idf i USING (term) CROSS JOIN st LEFT JOIN dl d ON d.id = t.id WHERE term IN ({_Q})),
sums AS (SELECT id, coalesce(sum(tf * idf) FILTER (field = 'name'), 0) AS n, coalesce(sum(tf * idf) FILTER (field = 'path'), 0) AS p,
  coalesce(sum(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * norm)))) FILTER (field = 'body'), 0) AS b FROM ps GROUP BY id),
lex AS (SELECT s.id, 3 * n AS name_score, 2 * p AS path_score, b AS body_score, (3 * n + 2 * p + b) * {_FACTOR} AS lexical FROM sums s JOIN gn USING (id))"""


@query("x1_tokens", f"SELECT DISTINCT doc_id, len({sql.tokens_sql('text')}) AS n_tokens FROM documents WHERE text IS NOT NULL")
def x1_tokens(r: Relations) -> DataFrame:
    return r.documents.where("text is not null").select("doc_id", F.size(tokens("text")).alias("n_tokens"))


@query("a4_term_bag", f"SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens_sql('text')}) AS term FROM documents) GROUP BY ALL")
def a4_term_bag(r: Relations) -> DataFrame:
    return term_bag(r.documents, "doc_id", "text").select("id", "term", "tf")


@query("a5_document_frequency", statement(TERMS, select="SELECT term, count(DISTINCT id) AS df FROM tt GROUP BY term"))
def a5_document_frequency(r: Relations) -> DataFrame:
    return textsearch.document_frequency(r.terms)


@query("a6_corpus_stats", statement(TERMS, select="SELECT (SELECT count(*) FROM gn) AS n_docs, round((SELECT sum(tf) FROM tt WHERE field = 'body') / (SELECT count(*) FROM gn), 6) AS avg_body_len"))
def a6_corpus_stats(r: Relations) -> DataFrame:
    return textsearch.corpus_stats(r.nodes, r.terms).select("n_docs", r6("avg_body_len").alias("avg_body_len"))


def _lexical(r: Relations) -> DataFrame:
    return r.lexical(QUESTION)


@query("x5_lexical", statement(TERMS, _LEX, select="SELECT id, round(name_score, 6) AS name_score, round(path_score, 6) AS path_score, round(body_score, 6) AS body_score, round(lexical, 6) AS lexical FROM lex WHERE lexical > 0"))
def x5_lexical(r: Relations) -> DataFrame:
    return _lexical(r).select("id", *[r6(c).alias(c) for c in ("name_score", "path_score", "body_score", "lexical")])


@query("x5_lexical_index", statement(TERMS, _LEX, select="SELECT id, round(lexical, 6) AS lexical FROM lex WHERE lexical > 0"))
def x5_lexical_index(r: Relations) -> DataFrame:
    """The same from postings."""
    return textsearch.lexical_scores(r.nodes, r.terms, QUESTION).select("id", r6("lexical").alias("lexical"))


@query("t2_ask_top", statement(TERMS, _LEX, select="SELECT id, round(lexical, 6) AS lexical FROM lex WHERE lexical > 0 ORDER BY round(lexical, 6) DESC, id LIMIT 8"))
def t2_ask_top(r: Relations) -> DataFrame:
    """The eight best hits, a top-k report."""
    return _lexical(r).select("id", r6("lexical").alias("lexical")).orderBy(F.desc("lexical"), "id").limit(8)


def _pagerank_sql() -> str:
    steps = ["m0 AS MATERIALIZED (SELECT id, r AS m FROM restart)"]
    for k in range(textsearch.ROUNDS):
        steps.append(
            f"m{k + 1} AS MATERIALIZED (SELECT id, sum(m) AS m FROM (SELECT a.target AS id, 0.75 * p.m * a.share AS m FROM m{k} p JOIN adj a ON a.source = p.id"
            f" UNION ALL SELECT id, 0.25 * r + 0.75 * r * coalesce((SELECT sum(m) FROM m{k} WHERE id NOT IN (SELECT source FROM adj)), 0) FROM restart) GROUP BY id)"
        )
    return (
        """pairs AS (SELECT w.source, w.target FROM we w JOIN gn a ON a.id = w.source JOIN gn b ON b.id = w.target),
both_ AS (SELECT source, target FROM pairs UNION ALL SELECT target, source FROM pairs),
deg AS (SELECT source, count(*) AS d FROM both_ GROUP BY source),
adj AS MATERIALIZED (SELECT b.source, b.target, count(*) / any_value(d) AS share FROM both_ b JOIN deg USING (source) GROUP BY b.source, b.target),
restart AS MATERIALIZED (SELECT id, lexical / (SELECT sum(lexical) FROM lex WHERE lexical > 0) AS r FROM lex WHERE lexical > 0),
"""
        + ",\n".join(steps)
        + f",\npr AS (SELECT id, m / (SELECT max(m) FROM m{textsearch.ROUNDS}) AS rank FROM m{textsearch.ROUNDS} WHERE m > 0)"
    )


def _ranks(r: Relations, lexical: DataFrame) -> DataFrame:
    return textsearch.pagerank(r.nodes, r.walk, lexical.select("id", F.col("lexical").alias("weight")))


@query("x6_pagerank", statement(TERMS, WALK, _LEX, _pagerank_sql(), select="SELECT id, round(rank, 6) AS rank FROM pr"))
def x6_pagerank(r: Relations) -> DataFrame:
    return _ranks(r, _lexical(r)).select("id", r6("rank").alias("rank"))


@query("x6_pagerank_joins", statement(TERMS, WALK, _LEX, _pagerank_sql(), select="SELECT id, round(rank, 6) AS rank FROM pr"))
def x6_pagerank_joins(r: Relations) -> DataFrame:
    """The same walk as a graph of any size takes it: by joins, no task holds it whole."""
    weights = _lexical(r).select("id", F.col("lexical").alias("weight"))
    return textsearch.pagerank(r.nodes, r.walk, weights, local_links=0).select("id", r6("rank").alias("rank"))


_CAND = f"""cand AS (SELECT n.id, n.path, coalesce(l.lexical, 0) / (SELECT max(lexical) FROM lex) AS lexical, coalesce(p.rank, 0) AS graph,
  (coalesce(l.lexical, 0) / (SELECT max(lexical) FROM lex) + 0.5 * coalesce(p.rank, 0)) * {_FACTOR} AS baseline
  FROM gn n LEFT JOIN (SELECT * FROM lex WHERE lexical > 0) l USING (id) LEFT JOIN pr p USING (id) WHERE l.id IS NOT NULL OR p.rank >= 0.15)"""


@query("x7_candidates", statement(TERMS, WALK, _LEX, _pagerank_sql(), _CAND, select="SELECT id, round(lexical, 6) AS lexical, round(graph, 6) AS graph, round(baseline, 6) AS baseline FROM cand WHERE baseline > 0"))
def x7_candidates(r: Relations) -> DataFrame:
    lexical = _lexical(r)
    return textsearch.candidates(r.nodes, lexical, _ranks(r, lexical), QUESTION).select("id", r6("lexical").alias("lexical"), r6("graph").alias("graph"), r6("baseline").alias("baseline"))


_FORMS = "forms(word, term) AS (VALUES " + ", ".join(f"('{w}', '{f}')" for w in query_terms(QUESTION) for f in dict.fromkeys([w, w + "s", *([w[:-1]] if w.endswith("s") else [])])) + ")"


@query(
    "x8_coverage",
    statement(
        TERMS, _LEX, _FORMS,
        "ww AS (SELECT DISTINCT f.word, coalesce(i.idf, ln(1 + st.n_docs)) AS w FROM (SELECT DISTINCT word FROM forms) f LEFT JOIN idf i ON i.term = f.word CROSS JOIN st)",
        "fd AS (SELECT t.id, f.word, max((t.field = 'name' AND g.kind <> 'file')::INT) AS in_name FROM tt t JOIN forms f USING (term) JOIN gn g USING (id) GROUP BY ALL)",
        select="SELECT id, round(sum(w) / (SELECT sum(w) FROM ww), 6) AS coverage, round(sum(w * in_name) / (SELECT sum(w) FROM ww), 6) AS strong FROM fd JOIN ww USING (word) GROUP BY id",
    ),
)
def x8_coverage(r: Relations) -> DataFrame:
    stats = textsearch.corpus_stats(r.nodes, r.terms)
    rows = textsearch.coverage(r.terms, r.nodes, QUESTION, textsearch.inverse_frequency(r.terms, stats), stats)
    return rows.select("id", r6("coverage").alias("coverage"), r6("strong").alias("strong"))


@query(
    "w7_rrf",
    statement(
        TERMS, _LEX,
        "sc AS (SELECT l.id, split_part(g.path, '/', 1) AS scope, round(l.lexical, 9) AS s FROM lex l JOIN gn g USING (id) WHERE l.lexical > 0)",
        "rr AS (SELECT id, scope, 1 / (60 + row_number() OVER (PARTITION BY scope ORDER BY s DESC, id)) AS v FROM sc)",
        select="SELECT id, scope, round(v / (SELECT max(v) FROM rr), 6) AS rrf FROM rr",
    ),
)
def w7_rrf(r: Relations) -> DataFrame:
    scored = _lexical(r).join(r.nodes.select("id", F.substring_index("path", "/", 1).alias("scope")), "id").select("id", "scope", F.round("lexical", 9).alias("s"))
    return textsearch.reciprocal_rank(scored, "scope", "s", "id").select("id", "scope", r6("rrf").alias("rrf"))


@query(
    "w6_participating",
    statement(
        TERMS, _LEX,
        "sc AS (SELECT l.id, split_part(g.path, '/', 1) AS scope, l.lexical AS s FROM lex l JOIN gn g USING (id) WHERE l.lexical > 0)",
        select="SELECT scope, count(*) AS n, round(max(s), 6) AS best FROM sc GROUP BY scope HAVING max(s) >= 0.25 * (SELECT max(s) FROM sc)",
    ),
)
def w6_participating(r: Relations) -> DataFrame:
    scored = _lexical(r).join(r.nodes.select("id", F.substring_index("path", "/", 1).alias("scope")), "id")
    return textsearch.participating(scored, "scope", "lexical").groupBy("scope").agg(F.count("*").alias("n"), r6(F.max("lexical")).alias("best"))


@query(
    "w4_interleave",
    statement(TERMS, _LEX, "sc AS (SELECT l.id, g.path, round(l.lexical, 9) AS s FROM lex l JOIN gn g USING (id) WHERE l.lexical > 0)", select="SELECT id, path, row_number() OVER (PARTITION BY path ORDER BY s DESC, id) AS depth FROM sc"),
)
def w4_interleave(r: Relations) -> DataFrame:
    scored = _lexical(r).join(r.nodes.select("id", "path"), "id").withColumn("s", F.round("lexical", 9))
    return textsearch.interleave(scored, "path", [F.desc("s"), "id"]).select("id", "path", "depth")


@query(
    "w5_normalized",
    statement(TERMS, _LEX, "sc AS (SELECT l.id, g.path, l.lexical AS s FROM lex l JOIN gn g USING (id) WHERE l.lexical > 0)", select="SELECT id, round(s / max(s) OVER (PARTITION BY path), 6) AS share FROM sc"),
)
def w5_normalized(r: Relations) -> DataFrame:
    scored = _lexical(r).join(r.nodes.select("id", "path"), "id")
    return rollups.normalize(scored, "lexical", ["path"]).select("id", r6("share").alias("share"))


_ASKED = ["which parser checks the ledger before a release", "who rotates the session token", "where is the schema digest rebuilt"]
_ASKED_SQL = "q(query, term, qw) AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}', 1.0)" for k, a in enumerate(_ASKED) for t in query_terms(a)) + "))"


@query(
    "x20_bm25f",
    statement(
        TERMS, _ASKED_SQL,
        "n AS (SELECT count(DISTINCT id) AS n FROM tt)",
        "ln_ AS (SELECT id, field, sum(tf) AS len FROM tt GROUP BY ALL)",
        "av AS (SELECT field, avg(len) AS a FROM ln_ GROUP BY field)",
        "x AS (SELECT t.id, t.term, sum(CASE t.field WHEN 'name' THEN 3.0 WHEN 'path' THEN 2.0 ELSE 0.5 END * t.tf / (0.25 + 0.75 * l.len / av.a)) AS x FROM tt t JOIN ln_ l ON l.id = t.id AND l.field = t.field JOIN av ON av.field = t.field WHERE t.term IN (SELECT term FROM q) GROUP BY ALL)",
        "df AS (SELECT term, count(DISTINCT id) AS df FROM tt GROUP BY term)",
        select="SELECT query, id, round(sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * x / (1.2 + x)), 6) AS score FROM q JOIN x USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY query, id",
    ),
)
def x20_bm25f(r: Relations) -> DataFrame:
    asked = r.spark.createDataFrame([(k, t, 1.0) for k, a in enumerate(_ASKED) for t in query_terms(a)], "id int, term string, qw double")
    return textsearch.bm25f(asked, r.terms).select("query", "id", r6("score").alias("score"))


@query("x20_text_links")
def x20_text_links(r: Relations) -> DataFrame:
    """Every document whose doc_id is divisible by 50, its text as the query, against all nodes; its first heading counts twice more."""
    docs = r.documents.where("doc_id % 50 = 0").select("doc_id", "text")
    heads = records.headings(records.document_lines(docs)).groupBy("doc_id").agg(F.min_by("heading", "line").alias("heading"))
    bags = term_bag(docs, "doc_id", "text").unionByName(term_bag(heads, "doc_id", "heading", "head"))
    return textsearch.text_links(bags, r.terms)


# --- degrees, callers, reach -----------------------------------------------------------------------------------------


@query("a1_in_degree", statement(WALK, select="SELECT target, count(*) AS in_degree FROM we GROUP BY target"))
def a1_in_degree(r: Relations) -> DataFrame:
    return graph.in_degree(r.walk)


@query("a2_distinct_incoming", statement(EDGES, select="SELECT target, count(DISTINCT (source, relation)) AS n_incoming FROM ge WHERE relation IN ('calls', 'references', 'implements', 'extends') GROUP BY target"))
def a2_distinct_incoming(r: Relations) -> DataFrame:
    return graph.distinct_incoming(r.edges)


@query("a3_all_in_degree", statement(EDGES, select="SELECT target, count(*) AS in_degree FROM ge GROUP BY target"))
def a3_all_in_degree(r: Relations) -> DataFrame:
    return graph.in_degree(r.edges)


@query("g1_callers", statement(NODES, WALK, select="SELECT w.target AS \"of\", w.source AS other, coalesce(n.name, w.source) AS name, w.relation, w.ord FROM we w LEFT JOIN gn n ON n.id = w.source"))
def g1_callers(r: Relations) -> DataFrame:
    return graph.callers(r.walk, r.nodes)


@query("g1_callees", statement(NODES, WALK, select="SELECT w.source AS \"of\", w.target AS other, coalesce(n.name, w.target) AS name, w.relation, w.ord FROM we w LEFT JOIN gn n ON n.id = w.target"))
def g1_callees(r: Relations) -> DataFrame:
    return graph.callers(r.walk, r.nodes, incoming=False)


@query("j2_resolve_symbol", statement(NODES, select=f"SELECT id, 2 AS tier FROM gn WHERE kind = 'file' AND (lower(path) = '{SYMBOL}' OR lower(path) LIKE '%/{SYMBOL}')"))
def j2_resolve_symbol(r: Relations) -> DataFrame:
    return graph.resolve_symbol(r.nodes, SYMBOL)


def _seeded(r: Relations) -> DataFrame:
    return graph.resolve_symbol(r.nodes, SYMBOL).select(F.lit(SYMBOL).alias("origin"), "id")


@query(
    "g2_reach",
    statement(
        NODES, WALK,
        f"sd AS (SELECT id FROM gn WHERE kind = 'file' AND (lower(path) = '{SYMBOL}' OR lower(path) LIKE '%/{SYMBOL}'))",
        "bfs AS (SELECT id, 0 AS depth FROM sd UNION SELECT w.source, b.depth + 1 FROM bfs b JOIN (SELECT DISTINCT source, target FROM we) w ON w.target = b.id WHERE b.depth < 3)",
        select=f"SELECT '{SYMBOL}' AS origin, id, min(depth) AS depth FROM bfs WHERE id NOT IN (SELECT id FROM sd) GROUP BY id",
    ),
)
def g2_reach(r: Relations) -> DataFrame:
    return graph.reach(r.walk, _seeded(r), depth=3).select("origin", "id", "depth")


_IMPACT = """sd AS (SELECT DISTINCT path AS origin, id FROM gn WHERE summary_state = 'stale' AND kind <> 'file'),
ww AS (SELECT DISTINCT source, target FROM we),
h1 AS (SELECT DISTINCT s.origin, w.source AS id FROM sd s JOIN ww w ON w.target = s.id WHERE (s.origin, w.source) NOT IN (SELECT origin, id FROM sd)),
h2 AS (SELECT DISTINCT s.origin, w.source AS id FROM h1 s JOIN ww w ON w.target = s.id WHERE (s.origin, w.source) NOT IN (SELECT origin, id FROM sd) AND (s.origin, w.source) NOT IN (SELECT origin, id FROM h1)),
hit AS (SELECT origin, id, 1 AS depth FROM h1 UNION ALL SELECT origin, id, 2 FROM h2),
imp AS (SELECT h.id, any_value(n.path) AS path, min(h.depth) AS depth, count(DISTINCT h.origin) AS n_origins FROM hit h JOIN gn n ON n.id = h.id GROUP BY h.id)"""


def _impacted(r: Relations) -> DataFrame:
    return graph.reach(r.walk, r.symbols.where("summary_state = 'stale'").select(F.col("path").alias("origin"), "id"), depth=2)


@query("g4_impact", statement(NODES, WALK, _IMPACT, select="SELECT id, path, depth, n_origins FROM imp"))
def g4_impact(r: Relations) -> DataFrame:
    return graph.impact(_impacted(r), r.nodes)


@query("g4_members", statement(NODES, WALK, _IMPACT, select="SELECT origin, id, depth FROM hit"))
def g4_members(r: Relations) -> DataFrame:
    """A row for each origin that reaches a node."""
    return _impacted(r).select("origin", "id", "depth")


@query(
    "a9_modules",
    statement(
        NODES, WALK, _IMPACT, "ex AS (SELECT regexp_replace(n.path, '/[^/]*$', '') AS dir, h.id, n.path, h.depth, h.origin FROM hit h JOIN gn n ON n.id = h.id)",
        select="SELECT dir, count(DISTINCT id) AS n_nodes, count(DISTINCT path) AS n_files, count(DISTINCT origin) AS n_origins, min(depth) AS min_depth FROM ex GROUP BY dir",
    ),
)
def a9_modules(r: Relations) -> DataFrame:
    return graph.module_groups(_impacted(r), r.nodes)


_TEST_IMPACT = "regexp_matches({p}, '(?i)(^|/)(tests?|specs?|__tests__)/|\\.(test|spec)\\.[cm]?[jt]sx?$|_test\\.(go|py|rb)$')"


@query("g5_test_reach", statement(NODES, EDGES, select=f"SELECT e.target AS id, count(DISTINCT s.path) AS n_tests FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target WHERE {_TEST_IMPACT.format(p='s.path')} GROUP BY e.target"))
def g5_test_reach(r: Relations) -> DataFrame:
    """Symbols that a test path points at directly, by any relation."""
    tests = r.nodes.where(F.col("path").rlike(TEST_PATH_IMPACT)).select(F.col("id").alias("source"), "path")
    return r.edges.join(tests, "source").join(r.nodes.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count_distinct("path").alias("n_tests"))


@query("j35_calling_tests", statement(NODES, EDGES, select=f"SELECT DISTINCT e.target AS id, e.source AS test FROM ge e JOIN gn s ON s.id = e.source WHERE e.relation = 'calls' AND e.confidence <> 'inferred' AND {_TEST_IMPACT.format(p='s.path')}"))
def j35_calling_tests(r: Relations) -> DataFrame:
    tests = r.nodes.where(F.col("path").rlike(TEST_PATH_IMPACT)).select(F.col("id").alias("source"))
    return r.edges.where("relation = 'calls' and confidence <> 'inferred'").join(tests, "source", "left_semi").select(F.col("target").alias("id"), F.col("source").alias("test")).distinct()


@query("j17_cross_file", statement(NODES, EDGES, select="SELECT e.edge_id FROM ge e JOIN gn t ON t.id = e.target LEFT JOIN gn s ON s.id = e.source WHERE s.path IS NULL OR s.path <> t.path"))
def j17_cross_file(r: Relations) -> DataFrame:
    return graph.cross_file_edges(r.edges, r.nodes).select("edge_id")


@query("j23_dangling", statement(NODES, EDGES, select="SELECT target, count(*) AS n FROM ge WHERE target NOT IN (SELECT id FROM gn) GROUP BY target"))
def j23_dangling(r: Relations) -> DataFrame:
    return r.edges.join(r.nodes.select(F.col("id").alias("target")), "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


@query("j22_scoped_graph", statement(NODES, EDGES, select="SELECT e.edge_id FROM ge e WHERE e.source IN (SELECT id FROM gn WHERE path = 'copper-beacon' OR path LIKE 'copper-beacon/%')"))
def j22_scoped_graph(r: Relations) -> DataFrame:
    return r.edges.join(r.nodes.where(under("path", "copper-beacon")).select(F.col("id").alias("source")), "source", "left_semi").select("edge_id")


@query("j11_keep_first", statement(EDGES, select="SELECT edge_id FROM ge QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY ord, edge_id) = 1"))
def j11_keep_first(r: Relations) -> DataFrame:
    return resolve.keep_first(r.edges).select("edge_id")


@query(
    "v13_file_view",
    statement(
        NODES, EDGES,
        "cr AS (SELECT t.path, e.source, e.relation, e.target, e.edge_id, row_number() OVER (PARTITION BY t.path ORDER BY e.source, e.relation, e.target, e.edge_id) AS k FROM ge e JOIN gn t ON t.id = e.target LEFT JOIN gn s ON s.id = e.source WHERE s.path IS NULL OR s.path <> t.path)",
        "ct AS (SELECT path, count(*) AS in_total, string_agg(source || ' ' || relation || ' ' || target, '; ' ORDER BY k) FILTER (k <= 8) AS top_edges FROM cr GROUP BY path)",
        select="SELECT p.path, p.n_nodes, coalesce(c.in_total, 0) AS in_total, coalesce(c.top_edges, '') AS top_edges FROM (SELECT path, count(*) AS n_nodes FROM gn GROUP BY path) p LEFT JOIN ct c USING (path)",
    ),
)
def v13_file_view(r: Relations) -> DataFrame:
    return graph.file_view(r.edges, r.nodes)


# --- maps and outlines -----------------------------------------------------------------------------------------------


@query(
    "a7_directory_rollup",
    statement(
        NODES,
        "d1 AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS d FROM gn)",
        "big AS (SELECT d FROM d1 WHERE kind = 'file' GROUP BY d HAVING count(*) > 0.6 * (SELECT count(*) FROM d1 WHERE kind = 'file'))",
        "dd AS (SELECT kind, CASE WHEN d IN (SELECT d FROM big) THEN array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') ELSE d END AS dir FROM d1)",
        select="SELECT dir, count(*) FILTER (kind = 'file') AS n_files, count(*) FILTER (kind <> 'file') AS n_symbols FROM dd GROUP BY dir",
    ),
)
def a7_directory_rollup(r: Relations) -> DataFrame:
    return graph.directory_rollup(r.nodes)


@query("a8_totals", statement(NODES, EDGES, FILES, select="SELECT (SELECT count(*) FROM gn WHERE kind = 'file') AS n_files, (SELECT count(*) FROM gn WHERE kind <> 'file') AS n_symbols, (SELECT count(*) FROM ge) AS n_edges, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM gf) AS languages"))
def a8_totals(r: Relations) -> DataFrame:
    n = r.nodes.agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if(F.col("kind") != "file").alias("n_symbols"))
    langs = r.files.agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))
    return n.join(r.edges.agg(F.count("*").alias("n_edges"))).join(langs)


@query(
    "w1_hubs",
    statement(
        NODES, WALK, "dg AS (SELECT target, count(*) AS in_degree FROM we GROUP BY target)",
        select="SELECT dir, rank, id, in_degree FROM (SELECT array_to_string(list_slice(string_split(n.path, '/'), 1, least(2, len(string_split(n.path, '/')) - 1)), '/') AS dir, n.id, d.in_degree, row_number() OVER (PARTITION BY dir ORDER BY d.in_degree DESC, n.name, n.path, n.id) AS rank FROM gn n JOIN dg d ON d.target = n.id WHERE n.kind <> 'file') WHERE rank <= 3",
    ),
)
def w1_hubs(r: Relations) -> DataFrame:
    return graph.hubs(r.nodes, graph.in_degree(r.walk))


@query("g10_outline", statement(NODES, WALK, "dg AS (SELECT target, count(*) AS in_degree FROM we GROUP BY target)", select="SELECT n.path, n.start_line, n.end_line, n.id, n.name, n.kind, coalesce(d.in_degree, 0) AS in_degree FROM gn n LEFT JOIN dg d ON d.target = n.id WHERE n.kind <> 'file'"))
def g10_outline(r: Relations) -> DataFrame:
    return graph.outline(r.nodes, graph.in_degree(r.walk))


@query(
    "t4_definitions",
    statement(
        NODES, WALK, "dg AS (SELECT target, count(*) AS d FROM we GROUP BY target)",
        select=f"SELECT name, row_number() OVER (PARTITION BY lower(name) ORDER BY ({_TEST_ASK.format(p='path')})::INT, (NOT coalesce(exported, false))::INT, coalesce(d, 0) DESC, path, start_line, id) AS rank, id FROM gn LEFT JOIN dg ON dg.target = gn.id WHERE kind <> 'file' AND name IS NOT NULL",
    ),
)
def t4_definitions(r: Relations) -> DataFrame:
    """Definitions of every name in the order a lookup shows them: outside tests, exported, often used."""
    from pyspark.sql import Window

    rows = r.symbols.where("name is not null").join(graph.in_degree(r.walk).withColumnRenamed("target", "id"), "id", "left")
    w = Window.partitionBy(F.lower("name")).orderBy(F.col("path").rlike(TEST_PATH_ASK), ~F.coalesce("exported", F.lit(False)), F.coalesce("in_degree", F.lit(0)).desc(), "path", "start_line", "id")
    return rows.select("name", F.row_number().over(w).alias("rank"), "id")


@query("a22_scope_substance", statement(NODES, select="SELECT s.prefix, coalesce(n, 0) AS n_symbols, coalesce(n, 0) < 5 AS folds FROM (SELECT DISTINCT prefix FROM scopes) s LEFT JOIN (SELECT split_part(path, '/', 1) AS prefix, count(*) AS n FROM gn WHERE kind <> 'file' GROUP BY 1) USING (prefix)"))
def a22_scope_substance(r: Relations) -> DataFrame:
    return rollups.scope_substance(r.nodes, r.scopes)


@query("j16_nearest_scope", statement(FILES, select="SELECT f.file_id AS ref_id, arg_max(s.prefix, length(s.prefix)) AS root FROM gf f JOIN scopes s ON f.path = s.prefix OR starts_with(f.path, s.prefix || '/') GROUP BY f.file_id"))
def j16_nearest_scope(r: Relations) -> DataFrame:
    return resolve.resolve_by_prefix(r.files.select(F.col("file_id").alias("ref_id"), "path"), r.scopes.select(F.col("prefix").alias("root")))


@query("f3_test_paths", statement(FILES, select=f"SELECT count(*) FILTER ({_TEST_ASK.format(p='path')}) AS ask, count(*) FILTER ({_TEST_IMPACT.format(p='path')}) AS impact, count(*) FILTER (regexp_matches(path, '^tests/|/tests/|/test/|(^|/)test_[^/]*$|_test\\.[^/]*$|\\.test\\.[^/]*$|\\.spec\\.[^/]*$|\\.md$')) AS why FROM gf"))
def f3_test_paths(r: Relations) -> DataFrame:
    return r.files.agg(*[F.count_if(F.col("path").rlike(p)).alias(n) for n, p in (("ask", TEST_PATH_ASK), ("impact", TEST_PATH_IMPACT), ("why", TEST_PATH_WHY))])


@query("f1_under_prefix", statement(FILES, select="SELECT file_id, path FROM gf WHERE path = 'violet-willow/src' OR path LIKE 'violet-willow/src/%'"))
def f1_under_prefix(r: Relations) -> DataFrame:
    return r.files.where(under("path", "./violet-willow/src/")).select("file_id", "path")


@query("s6_languages", statement(FILES, select="SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n_files, count(lang) AS n_labelled FROM gf GROUP BY ALL"))
def s6_languages(r: Relations) -> DataFrame:
    return r.files.groupBy(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).agg(F.count("*").alias("n_files"), F.count("lang").alias("n_labelled"))


# --- lines and spans -------------------------------------------------------------------------------------------------

_PATTERN_SQL = r"throw new|raise ValueError|panic\("
_POINTS = "pt AS (SELECT DISTINCT path, line FROM lk WHERE line IS NOT NULL AND path <> '')"
_SPANS = "sp AS (SELECT * FROM gn WHERE kind <> 'file' AND start_line >= 1 AND end_line >= start_line)"


def _points(r: Relations) -> DataFrame:
    return r.links.where("line is not null and path <> ''").select("path", "line").distinct()


@query("j12_innermost", statement(NODES, LINKS, _POINTS, _SPANS, select="SELECT p.path, p.line, arg_max(s.id, (s.start_line, s.node_key)) AS id FROM pt p LEFT JOIN sp s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY p.path, p.line"))
def j12_innermost(r: Relations) -> DataFrame:
    return spans.innermost(_points(r), r.symbols)


@query("j13_chain", statement(NODES, LINKS, _POINTS, _SPANS, select="SELECT p.path, p.line, row_number() OVER (PARTITION BY p.path, p.line ORDER BY s.end_line - s.start_line, s.id) AS position, s.id FROM pt p JOIN sp s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.end_line"))
def j13_chain(r: Relations) -> DataFrame:
    return spans.enclosing_chain(_points(r), r.symbols)


_RANGES = "rg AS (SELECT DISTINCT path, crux.start_line AS rs, crux.end_line AS re FROM gn WHERE crux IS NOT NULL)"
_OVER = "ov AS (SELECT DISTINCT r.path, r.rs, r.re, s.id, s.start_line, s.end_line FROM rg r JOIN sp s ON s.path = r.path AND s.start_line <= r.re AND s.end_line >= r.rs)"


def _ranges(r: Relations) -> DataFrame:
    return r.nodes.where("crux is not null").select("path", "crux.start_line", "crux.end_line")


@query("j14_overlap", statement(NODES, _SPANS, _RANGES, _OVER, select="SELECT path, rs AS range_start, re AS range_end, id FROM ov a WHERE NOT EXISTS (SELECT 1 FROM ov b WHERE b.path = a.path AND b.rs = a.rs AND b.re = a.re AND b.id <> a.id AND a.start_line <= b.start_line AND a.end_line >= b.end_line)"))
def j14_overlap(r: Relations) -> DataFrame:
    return spans.overlapping(_ranges(r), r.symbols)


@query("j15_overlap_all", statement(NODES, _SPANS, _RANGES, _OVER, select="SELECT DISTINCT path, id FROM ov"))
def j15_overlap_all(r: Relations) -> DataFrame:
    return spans.overlapping_all(_ranges(r), r.symbols)


_TEST_WHY = "regexp_matches({p}, '^tests/|/tests/|/test/|(^|/)test_[^/]*$|_test\\.[^/]*$|\\.test\\.[^/]*$|\\.spec\\.[^/]*$|\\.md$')"


@query(
    "j15_hunk_targets",
    statement(
        NODES, _SPANS, _RANGES, f"hk AS (SELECT DISTINCT split_part(r.path, '/', 1) AS commit, r.path, s.id FROM rg r JOIN sp s ON s.path = r.path AND s.start_line <= r.re AND s.end_line >= r.rs WHERE NOT {_TEST_WHY.format(p='r.path')})",
        select="SELECT DISTINCT commit, CASE WHEN count(*) OVER (PARTITION BY commit) > 20 THEN path ELSE id END AS id FROM hk",
    ),
)
def j15_hunk_targets(r: Relations) -> DataFrame:
    """A prefix stands for a commit, excerpts for its hunks."""
    ranges = _ranges(r).withColumn("commit", F.substring_index("path", "/", 1))
    return spans.hunk_targets(ranges, r.symbols)


@query("a15_covered_chars", statement(NODES, FILES, _SPANS, "ln AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS l FROM sp)", "av AS (SELECT path, max(length(content) / len(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)))) AS a FROM gf WHERE content IS NOT NULL GROUP BY path)", select="SELECT l.path, CAST(floor(count(*) * least(200.0, any_value(a)) * 0.5) AS BIGINT) AS chars FROM ln l JOIN av USING (path) GROUP BY l.path"))
def a15_covered_chars(r: Relations) -> DataFrame:
    return spans.covered_chars(spans.covered_lines(r.symbols.select("path", "start_line", "end_line")), r.files)


@query("a15_covered_lines", statement(NODES, _SPANS, "ln AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS l FROM sp)", select="SELECT path, count(*) AS covered FROM ln GROUP BY path"))
def a15_covered_lines(r: Relations) -> DataFrame:
    return spans.covered_lines(r.symbols.select("path", "start_line", "end_line"))


@query("x15_find", statement(LINES, select=f"SELECT path, line, left(trim(text), 160) AS text FROM gl WHERE regexp_matches(text, '{_PATTERN_SQL}')"))
def x15_find(r: Relations) -> DataFrame:
    return spans.search_files(r.files, PATTERN)


@query("x15_find_fixed", statement(LINES, select="SELECT path, line, left(trim(text), 160) AS text FROM gl WHERE contains(text, 'total << 2')"))
def x15_find_fixed(r: Relations) -> DataFrame:
    return spans.search_files(r.files, "total << 2", fixed=True)


@query(
    "x15_find_grouped",
    statement(
        NODES, WALK, LINES, _SPANS, "dg AS (SELECT target, count(*) AS d FROM we GROUP BY target)",
        f"hit AS (SELECT path, line FROM gl WHERE regexp_matches(text, '{_PATTERN_SQL}'))",
        "pl AS (SELECT h.path, h.line, arg_max(s.id, (s.start_line, s.node_key)) AS id FROM hit h LEFT JOIN sp s ON s.path = h.path AND h.line BETWEEN s.start_line AND s.end_line GROUP BY ALL)",
        select="SELECT path, coalesce(id, path) AS id, count(*) AS n_hits, min(line) AS first_line, coalesce(any_value(d), 0) AS in_degree FROM pl LEFT JOIN dg ON dg.target = pl.id GROUP BY path, id",
    ),
)
def x15_find_grouped(r: Relations) -> DataFrame:
    return spans.grep_groups(spans.search_files(r.files, PATTERN), r.symbols, graph.in_degree(r.walk))


@query("s11_comments")
def s11_comments(r: Relations) -> DataFrame:
    """Not in RE2's power: checked against a character scan in the tests."""
    return spans.comment_lines(r.lines)


@query("f7_reason_comments")
def f7_reason_comments(r: Relations) -> DataFrame:
    return spans.reason_comments(spans.comment_lines(r.lines))


@query(
    "x17_source_slice",
    statement(
        NODES, FILES, _SPANS, "ff AS (SELECT path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM gf WHERE content IS NOT NULL)",
        select="SELECT s.id, array_to_string(list_slice(f.parts, s.start_line, s.start_line + least(s.end_line - s.start_line + 1, 80) - 1), chr(10)) AS code, s.end_line - s.start_line + 1 > 80 AS cut FROM sp s JOIN ff f USING (path) WHERE s.start_line <= len(f.parts)",
    ),
)
def x17_source_slice(r: Relations) -> DataFrame:
    return spans.source_slice(r.files, r.symbols)


@query(
    "x18_evidence",
    statement(
        NODES, EDGES, LINES, _SPANS,
        "cl AS (SELECT DISTINCT e.source, e.target, s.path, s.start_line, s.end_line, t.name FROM ge e JOIN sp s ON s.id = e.source JOIN gn t ON t.id = e.target AND t.kind <> 'file' WHERE e.relation = 'calls')",
        select="SELECT c.source, c.target, min(l.line) AS line, arg_min(trim(l.text), l.line) AS text FROM cl c JOIN gl l ON l.path = c.path AND l.line BETWEEN c.start_line AND c.end_line AND list_contains(regexp_extract_all(l.text, '[A-Za-z_][A-Za-z0-9_]*'), c.name) GROUP BY c.source, c.target",
    ),
)
def x18_evidence(r: Relations) -> DataFrame:
    return spans.evidence(r.edges, r.nodes, r.lines)


# --- freshness -------------------------------------------------------------------------------------------------------


_LAST = f"""runs AS (SELECT DISTINCT run_id, prefix, started_at, status FROM build_runs),
lastok AS (SELECT run_id FROM runs WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY started_at DESC, run_id DESC) = 1),
sn AS (SELECT DISTINCT snap_id, run_id, {path_key_sql('path')} AS path, {content_hash_sql('hash')} AS hash, size, mtime_ms FROM snapshots),
bf AS (SELECT * FROM sn WHERE run_id IN (SELECT run_id FROM lastok) AND path <> '' QUALIFY row_number() OVER (PARTITION BY path ORDER BY snap_id DESC) = 1)"""


def _last_listing(r: Relations) -> DataFrame:
    """What the last ok run of each prefix listed, the row with the largest snap_id per path."""
    runs = r.raw("build_runs").select("run_id", "prefix", "started_at", "status").dropDuplicates(["run_id"]).where("status = 'ok'")
    last = runs.groupBy("prefix").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id")).select("run_id")
    rows = r.raw("snapshots").join(last, "run_id", "left_semi").select("snap_id", path_key("path").alias("path"), content_hash("hash").alias("hash"), "size", "mtime_ms").where("path <> ''")
    return rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ms", "hash"), "snap_id").alias("s")).select("path", "s.*")


@query(
    "v1_drift",
    statement(
        FILES, _LAST,
        "bo AS (SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN coalesce(b.hash = n.hash, b.size IS NOT DISTINCT FROM n.size AND b.mtime_ms IS NOT DISTINCT FROM n.mtime_ms) OR (b.size IS NOT DISTINCT FROM n.size AND b.mtime_ms IS NOT DISTINCT FROM n.mtime_ms AND (b.hash IS NULL OR n.hash IS NULL)) THEN NULL ELSE 'changed' END AS change FROM bf b FULL JOIN gf n ON n.path = b.path)",
        select="SELECT path, change FROM bo WHERE change IS NOT NULL",
    ),
)
def v1_drift(r: Relations) -> DataFrame:
    return freshness.drift(_last_listing(r), r.files)


@query(
    "v1_racy",
    statement(
        FILES, _LAST, "wk AS (SELECT max(mtime_ms) AS w FROM gf)",
        "bo AS (SELECT coalesce(b.path, n.path) AS path, b.path IS NULL AS new, n.path IS NULL AS gone, b.hash = n.hash AS eq, b.hash IS NULL OR n.hash IS NULL AS blind, b.size IS NOT DISTINCT FROM n.size AND b.mtime_ms IS NOT DISTINCT FROM n.mtime_ms AND NOT coalesce(abs(n.mtime_ms - w) <= 2000, false) AS st FROM bf b FULL JOIN gf n ON n.path = b.path CROSS JOIN wk)",
        select="SELECT path, CASE WHEN new THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change FROM bo WHERE new OR gone OR NOT (coalesce(eq, st) OR (st AND blind))",
    ),
)
def v1_racy(r: Relations) -> DataFrame:
    """Drift where the walk took place at the newest time of any file: what was written within two seconds of it is not trusted by its stat."""
    walked = r.files.agg(F.max("mtime_ms")).first()[0]
    return freshness.drift(_last_listing(r), r.files, walked_ms=walked)


@query("v2_replay", statement(FILES, _LAST, select="SELECT DISTINCT f.path, CASE WHEN b.hash IS NOT NULL THEN 'reuse' ELSE 'parse' END AS action FROM gf f LEFT JOIN bf b ON b.path = f.path AND b.hash = f.hash"))
def v2_replay(r: Relations) -> DataFrame:
    return freshness.replay(r.files, _last_listing(r))


def _live(r: Relations, at: str) -> DataFrame:
    from pyspark.sql import Window

    t = F.lit(at).cast("timestamp_ntz")
    rows = r.node_rows.where((F.col("first_seen") < t) & (F.col("removed_at").isNull() | (F.col("removed_at") >= t)))
    w = Window.partitionBy("id").orderBy(F.desc("first_seen"), F.desc("node_key"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _live_sql(name: str, at: str) -> str:
    return f"{name} AS (SELECT * FROM nr WHERE first_seen < TIMESTAMP '{at}' AND (removed_at IS NULL OR removed_at >= TIMESTAMP '{at}') QUALIFY row_number() OVER (PARTITION BY id ORDER BY first_seen DESC, node_key DESC) = 1)"


_CHECK = f"{_live_sql('b', BEFORE)},\n{_live_sql('n', AFTER)},\nck AS (SELECT coalesce(b.id, n.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN b.body_hash IS NOT DISTINCT FROM n.body_hash THEN 'same' ELSE 'changed' END AS status FROM b FULL JOIN n ON n.id = b.id)"


@query("v5_check", statement(NODE_ROWS, _CHECK, select="SELECT id, status FROM ck"))
def v5_check(r: Relations) -> DataFrame:
    return freshness.check(_live(r, BEFORE), _live(r, AFTER))


@query("a21_check_counts", statement(NODE_ROWS, _CHECK, select="SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, (SELECT count(*) FROM n WHERE kind <> 'file' AND summary_state = 'stale') AS stale, (SELECT count(*) FROM n WHERE kind <> 'file' AND summary_state = 'pending') AS pending, count(*) FILTER (status <> 'same') = 0 AS ok FROM ck"))
def a21_check_counts(r: Relations) -> DataFrame:
    now = _live(r, AFTER)
    return freshness.check_counts(freshness.check(_live(r, BEFORE), now), now)


@query("v4_carry_over", statement(NODE_ROWS, _CHECK, select="SELECT n.id, p.summary, CASE WHEN p.summary IS NULL THEN 'pending' WHEN p.body_hash IS NOT DISTINCT FROM n.body_hash THEN 'ready' ELSE 'stale' END AS state FROM n LEFT JOIN (SELECT * FROM b WHERE summary IS NOT NULL) p ON p.id = n.id"))
def v4_carry_over(r: Relations) -> DataFrame:
    return freshness.carry_over(_live(r, BEFORE), _live(r, AFTER))


@query("v8_replace_paths", statement(NODE_ROWS, _live_sql("b", BEFORE), _live_sql("n", AFTER), select="SELECT id, path FROM b WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT id, path FROM n"))
def v8_replace_paths(r: Relations) -> DataFrame:
    return freshness.replace_paths(_live(r, BEFORE).select("id", "path"), _live(r, AFTER).select("id", "path"))


@query("w9_first_last", statement(NODE_ROWS, select="SELECT id, arg_min(node_key, (first_seen, node_key)) AS first, arg_max(node_key, (first_seen, node_key)) AS last FROM nr WHERE first_seen IS NOT NULL GROUP BY id"))
def w9_first_last(r: Relations) -> DataFrame:
    return rollups.first_and_last(r.node_rows.where("first_seen is not null"), "id", "node_key", "first_seen")


@query("w10_last_version", statement(NODES, select="SELECT id, node_key FROM gn"))
def w10_last_version(r: Relations) -> DataFrame:
    return r.nodes.select("id", "node_key")


@query("v10_stream_refresh", statement(FILES, select="SELECT path, hash FROM gf QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime_ms DESC, file_id DESC) = 1"))
def v10_stream_refresh(r: Relations) -> DataFrame:
    """The state a stream of file versions leaves: the newest version of each path."""
    from loamgraph.streaming.refresh import refresh_once

    return refresh_once(r.spark, r.folder).select("path", "hash")


# --- name resolution -------------------------------------------------------------------------------------------------

_FAM = "CASE lower(regexp_extract({p}, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'js' THEN 'script' WHEN 'ts' THEN 'script' WHEN 'py' THEN 'python' WHEN 'java' THEN 'jvm' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END"
_RAW = "rw AS (SELECT edge_id AS ref_id, regexp_replace(source, '#.*$', '') AS path, regexp_replace(target, '^.*[#.]', '') AS name FROM ge WHERE relation = 'calls' AND contains(target, '#'))"


def _raw_calls(r: Relations) -> DataFrame:
    return r.edges.where("relation = 'calls' and contains(target, '#')").select(F.col("edge_id").alias("ref_id"), F.regexp_replace("source", r"#.*$", "").alias("path"), F.regexp_replace("target", r"^.*[#.]", "").alias("name"))


_RESOLVED = [
    f"sy AS (SELECT id, path, name, {_FAM.format(p='path')} AS f FROM gn WHERE kind <> 'file')",
    "lo AS (SELECT path, name, count(*) AS n, min(id) AS id FROM sy GROUP BY ALL)", "ao AS (SELECT name, count(*) AS n, min(id) AS id FROM sy GROUP BY ALL)", "wo AS (SELECT name, f, count(*) AS n, min(id) AS id FROM sy GROUP BY ALL)",
    f"jn AS (SELECT r.ref_id, CASE WHEN l.n = 1 THEN l.id WHEN l.n IS NULL AND w.n = 1 THEN w.id WHEN l.n IS NULL AND {_FAM.format(p='r.path')} IS NULL AND a.n = 1 THEN a.id END AS target, CASE WHEN l.n = 1 THEN 'extracted' ELSE 'inferred' END AS confidence FROM rw r LEFT JOIN lo l ON l.path = r.path AND l.name = r.name LEFT JOIN ao a ON a.name = r.name LEFT JOIN wo w ON w.name = r.name AND w.f = {_FAM.format(p='r.path')})",
]


@query("j3_resolve_names", statement(NODES, EDGES, _RAW, *_RESOLVED, select="SELECT ref_id, target, confidence FROM jn WHERE target IS NOT NULL"))
def j3_resolve_names(r: Relations) -> DataFrame:
    return resolve.resolve_names(_raw_calls(r), r.symbols)


def _named_calls(r: Relations) -> DataFrame:
    argc = r.nodes.select(F.col("id").alias("target"), F.col("arity").alias("argc"), "name").where("argc is not null")
    return r.edges.where("relation = 'calls'").join(argc, "target").select(F.col("edge_id").alias("call_id"), "argc", "name")


_CC = "cc AS (SELECT e.edge_id AS call_id, t.arity AS argc, s.id, (s.arity IS NULL OR CASE WHEN coalesce(s.\"variadic\", false) THEN t.arity >= s.arity - 1 ELSE t.arity = s.arity END) AS ok FROM ge e JOIN gn t ON t.id = e.target AND t.arity IS NOT NULL JOIN gn s ON s.name = t.name AND s.kind <> 'file' WHERE e.relation = 'calls')"


_KEPT = "kp AS (SELECT call_id, id FROM cc QUALIFY ok OR sum(ok::INT) OVER (PARTITION BY call_id) = 0)"


@query("j5_arity", statement(NODES, EDGES, _CC, _KEPT, select="SELECT call_id, count(*) AS n, min(id) AS first_id FROM kp GROUP BY call_id"))
def j5_arity(r: Relations) -> DataFrame:
    """How many symbols each call may mean by name and number of arguments, and the first of them."""
    return resolve.narrowed_counts(_named_calls(r), r.symbols)


@query("j5_single", statement(NODES, EDGES, _CC, _KEPT, select="SELECT call_id, min(id) AS id FROM kp GROUP BY call_id HAVING count(*) = 1"))
def j5_single(r: Relations) -> DataFrame:
    """The calls that are left with one symbol."""
    return resolve.narrowed_counts(_named_calls(r), r.symbols).where("n = 1").select("call_id", F.col("first_id").alias("id"))


@query(
    "j4_typed_members",
    statement(
        NODES, EDGES,
        "mb AS (SELECT owner, name, id FROM gn WHERE owner IS NOT NULL)",
        "pa AS (SELECT DISTINCT regexp_replace(source, '^.*#', '') AS child, regexp_replace(target, '^.*#', '') AS parent FROM ge WHERE relation = 'extends')",
        "cl AS (SELECT e.edge_id AS call_id, t.owner AS type, t.name FROM ge e JOIN gn t ON t.id = e.target AND t.owner IS NOT NULL WHERE e.relation = 'calls')",
        "up AS (SELECT call_id, type, name, 0 AS level FROM cl UNION SELECT u.call_id, p.parent, u.name, u.level + 1 FROM up u JOIN pa p ON p.child = u.type WHERE u.level < 3)",
        "hit AS (SELECT DISTINCT u.call_id, m.id, u.level FROM up u JOIN mb m ON m.owner = u.type AND m.name = u.name)",
        select="SELECT call_id, id, level FROM hit h WHERE level = (SELECT min(level) FROM hit x WHERE x.call_id = h.call_id)",
    ),
)
def j4_typed_members(r: Relations) -> DataFrame:
    last = lambda c: F.regexp_replace(c, r"^.*#", "")
    parents = r.edges.where("relation = 'extends'").select(last("source").alias("child"), last("target").alias("parent"))
    members = r.nodes.where("owner is not null").select("owner", "name", "id")
    calls = r.edges.where("relation = 'calls'").join(r.nodes.where("owner is not null").select(F.col("id").alias("target"), F.col("owner").alias("type"), "name"), "target").select(F.col("edge_id").alias("call_id"), "type", "name")
    return resolve.typed_members(calls, members, parents)


_SPEC = "sc AS (SELECT edge_id AS ref_id, repeat('../', len(string_split(regexp_replace(source, '#.*$', ''), '/')) - 1) || regexp_replace(target, '#.*$', '') AS spec, regexp_replace(target, '#.*$', '') AS path FROM ge WHERE relation = 'imports')"


@query("j6_imports", statement(EDGES, FILES, _SPEC, select="SELECT s.ref_id, CASE WHEN f.path IS NOT NULL THEN f.path ELSE s.spec END AS target, f.path IS NOT NULL AS resolved FROM sc s LEFT JOIN (SELECT DISTINCT path FROM gf) f ON f.path = s.path"))
def j6_imports(r: Relations) -> DataFrame:
    """Import edges as relative specifiers of their source file, resolved back to files."""
    bare = F.regexp_replace("source", r"#.*$", "")
    spec = F.concat(F.repeat(F.lit("../"), F.size(F.split(bare, "/")) - 1), F.regexp_replace("target", r"#.*$", ""))
    imports = r.edges.where("relation = 'imports'").select(F.col("edge_id").alias("ref_id"), bare.alias("path"), spec.alias("spec"))
    return resolve.resolve_imports(imports, r.files)


_TAIL = "tl AS (SELECT link_id AS ref_id, regexp_extract(path, '[^/]+/[^/]+$') AS tail FROM lk WHERE path IS NOT NULL)"


@query("j37_suffix", statement(LINKS, FILES, _TAIL, "un AS (SELECT regexp_extract(path, '[^/]+/[^/]+$') AS tail, count(DISTINCT path) AS n, min(path) AS target FROM gf GROUP BY 1)", select="SELECT t.ref_id, u.target FROM tl t JOIN un u ON u.tail = t.tail AND u.n = 1 WHERE t.tail <> ''"))
def j37_suffix(r: Relations) -> DataFrame:
    refs = r.links.where("path is not null").select(F.col("link_id").alias("ref_id"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("tail")).where("tail <> ''")
    return resolve.resolve_by_suffix(refs, r.files)


# --- records ---------------------------------------------------------------------------------------------------------


@query("s15_entries", statement(RECORDS, select="SELECT doc_id, line, heading, date FROM en"))
def s15_entries(r: Relations) -> DataFrame:
    return records.record_entries(r.documents)


@query("g11_why", statement(LINKS, RECORDS, select="SELECT node, entry, min(level) AS level, entry IN (SELECT doc_id FROM gone) AS superseded FROM lk WHERE node <> '' AND entry IS NOT NULL GROUP BY node, entry"))
def g11_why(r: Relations) -> DataFrame:
    entries = records.record_entries(r.documents)
    return records.why(r.links, entries, records.superseded(entries, r.documents))


@query(
    "x21_folders",
    statement(
        LINKS, FILES,
        "lp AS (SELECT DISTINCT entry, path FROM lk WHERE entry IS NOT NULL AND path IN (SELECT path FROM gf))",
        "ex AS (SELECT entry, path, unnest(range(1, len(string_split(path, '/')))) AS k FROM lp)",
        "ct AS (SELECT entry, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS dir, count(*) AS n FROM ex GROUP BY ALL)",
        "kp AS (SELECT c.* FROM ct c JOIN (SELECT entry, count(*) AS a FROM lp GROUP BY entry) t USING (entry) WHERE c.n >= 3 AND c.n >= 0.2 * t.a)",
        select="SELECT entry, dir, n FROM kp a WHERE NOT EXISTS (SELECT 1 FROM kp b WHERE b.entry = a.entry AND starts_with(b.dir, a.dir || '/') AND b.n >= a.n)",
    ),
)
def x21_folders(r: Relations) -> DataFrame:
    return records.folder_proposals(r.links, r.files)


# --- rollups ---------------------------------------------------------------------------------------------------------

_NOW = "2025-07-01 00:00:00"


def _commits(r: Relations) -> DataFrame:
    return r.raw("events").select(F.col("event_type").alias("area"), F.col("user_id").alias("person"), F.col("event_id").alias("sha"), "ts")


_OWN = f"""pe AS (SELECT event_type AS area, user_id AS person, sum(pow(0.5, (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 86400000000.0 / 120)) AS score, count(*) AS n_commits FROM (SELECT DISTINCT event_type, user_id, event_id, ts FROM events) GROUP BY ALL),
sh AS (SELECT *, score / sum(score) OVER (PARTITION BY area) AS share FROM pe)"""


_BUILDS = f"""pe AS (SELECT prefix AS area, extractor AS person, sum(pow(0.5, (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(started_at)) / 86400000000.0 / 120)) AS score, count(*) AS n_commits FROM (SELECT DISTINCT prefix, extractor, run_id, started_at FROM build_runs WHERE started_at IS NOT NULL) GROUP BY ALL),
sh AS (SELECT *, score / sum(score) OVER (PARTITION BY area) AS share FROM pe)"""


@query("a12_ownership", statement(_BUILDS, select="SELECT area, person, round(score, 6) AS score, round(share, 6) AS share, n_commits, row_number() OVER (PARTITION BY area ORDER BY round(score, 9) DESC, person) AS rank FROM sh WHERE share >= 0.15 QUALIFY rank <= 2"))
def a12_ownership(r: Relations) -> DataFrame:
    """Builds of a prefix stand for commits to an area, extractors for people."""
    builds = r.raw("build_runs").where("started_at is not null").select(F.col("prefix").alias("area"), F.col("extractor").alias("person"), F.col("run_id").alias("sha"), F.col("started_at").alias("ts"))
    rows = rollups.ownership(builds, now=_NOW)
    return rows.select("area", "person", r6("score").alias("score"), r6("share").alias("share"), "n_commits", "rank")


@query("a13_reviewers", statement(_OWN, select="SELECT person, round(sum(score * CASE area WHEN 'error' THEN 1.0 ELSE 0.6 END), 6) AS total FROM pe GROUP BY person ORDER BY sum(score * CASE area WHEN 'error' THEN 1.0 ELSE 0.6 END) DESC, person LIMIT 3"))
def a13_reviewers(r: Relations) -> DataFrame:
    """The three best reviewers, a top-k report."""
    scores = rollups.ownership(_commits(r), now=_NOW, least=0.0, top=1 << 30)
    weights = scores.select("area").distinct().select("area", F.when(F.col("area") == "error", 1.0).otherwise(0.6).alias("weight"))
    return rollups.reviewers(scores, weights).select("person", r6("total").alias("total"))


@query(
    "a14_savings",
    statement(
        LINKS, FILES,
        "an AS (SELECT DISTINCT k.entry AS answer_id, k.path, length(d.text) AS answer_chars FROM lk k JOIN documents d ON d.doc_id = k.entry WHERE k.path <> '' AND d.text IS NOT NULL)",
        "fc AS (SELECT path, length(content) AS chars FROM gf)",
        "bs AS (SELECT a.answer_id, max(a.answer_chars) AS own, sum(f.chars) AS chars FROM an a LEFT JOIN fc f USING (path) GROUP BY a.answer_id)",
        select="SELECT answer_id, greatest(0, CAST(floor((coalesce(chars, 0) + 2) / 4) AS BIGINT) - CAST(floor((own + 2) / 4) AS BIGINT)) AS saved_tokens FROM bs",
    ),
)
def a14_savings(r: Relations) -> DataFrame:
    answers = r.links.where("path <> ''").select(F.col("entry").alias("doc_id"), "path").join(r.documents.where("text is not null").select("doc_id", F.length("text").alias("answer_chars")), "doc_id").select(F.col("doc_id").alias("answer_id"), "path", "answer_chars")
    return rollups.savings(answers, r.files.select("path", F.length("content").alias("chars")))


@query("a17_daily_totals", "WITH c AS (SELECT unnest(generate_series(DATE '2025-01-01' - 6, DATE '2025-01-01', INTERVAL 1 DAY))::DATE AS day), e AS (SELECT ts::DATE AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1) SELECT c.day, coalesce(n, 0) AS n, round(coalesce(total, 0.0), 4) AS total FROM c LEFT JOIN e USING (day)")
def a17_daily_totals(r: Relations) -> DataFrame:
    return rollups.daily_totals(r.raw("events"), "2025-01-01").select("day", "n", F.round("total", 4).alias("total"))


@query("a18_hit_rate", "SELECT user_id, round(100.0 * count(*) FILTER (event_type IN ('purchase', 'signup')) / nullif(count(*) FILTER (event_type IN ('purchase', 'signup', 'error')), 0), 6) AS rate FROM events GROUP BY user_id")
def a18_hit_rate(r: Relations) -> DataFrame:
    return rollups.hit_rate(r.raw("events"), "user_id", ["purchase", "signup"], ["error"]).select("user_id", r6("rate").alias("rate"))


@query("f9_family_edges", statement(NODES, WALK, f"fm AS MATERIALIZED (SELECT id, {_FAM.format(p='path')} AS f FROM gn)", "both_ AS MATERIALIZED (SELECT w.edge_id, s.f AS sf, t.f AS tf FROM we w JOIN fm s ON s.id = w.source JOIN fm t ON t.id = w.target)", select="SELECT edge_id FROM both_ WHERE sf = tf"))
def f9_family_edges(r: Relations) -> DataFrame:
    """Walk edges that stay in one language family."""
    from loamgraph.functions.text import family

    s = r.nodes.select(F.col("id").alias("source"), family("path").alias("sf"))
    t = r.nodes.select(F.col("id").alias("target"), family("path").alias("tf"))
    return r.walk.join(s, "source").join(t, "target").where("sf = tf").select("edge_id")


@query("g8_kept_edges", statement(NODES, EDGES, select="SELECT edge_id, source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn) AS kept FROM ge"))
def g8_kept_edges(r: Relations) -> DataFrame:
    """Every edge, and whether a context graph keeps it."""
    ids = r.nodes.select("id", F.lit(True).alias("known"))
    both = r.edges.join(ids.select(F.col("id").alias("source"), F.col("known").alias("a")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("known").alias("b")), "target", "left")
    return both.select("edge_id", F.coalesce(F.col("a") & F.col("b"), F.lit(False)).alias("kept"))


@query("g8_context_graph", statement(NODES, EDGES, select="SELECT relation, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM (SELECT relation, source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn) AS ok FROM ge) GROUP BY relation"))
def g8_context_graph(r: Relations) -> DataFrame:
    """Edges that a context graph keeps, and those it drops because an end dangles."""
    ids = r.nodes.select("id", F.lit(True).alias("known"))
    both = r.edges.join(ids.select(F.col("id").alias("source"), F.col("known").alias("a")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("known").alias("b")), "target", "left")
    ok = F.coalesce(F.col("a") & F.col("b"), F.lit(False))
    return both.groupBy("relation").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


# RE2 has no look-around: the statement holds the rules for terminal codes, control characters, key blocks, addresses, values of key names
# and base64 runs, which are taken apart from the rest as a list.
_KEYS = r"((?:^|[^A-Za-z0-9_])[A-Za-z0-9_]*(?:password|passwd|secret|token|api_key|apikey|auth|accountkey)[A-Za-z0-9_]*[\"'']?\s*"
_PLAIN = r"regexp_replace(replace(regexp_replace(text, '\x1B(?:\[[^\x40-\x7E]*[\x40-\x7E]?|\][^\x07\x1B]*[\x07\x1B]?)', '', 'g'), chr(9), ' '), '[\x{0}-\x{1F}\x{7F}-\x{9F}]', '', 'g')"
_NAMED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(plain, '-----BEGIN .*?(?:-----END (?:.*?-----|.*$)|$)', '[redacted]', 'g'), '(?i)([a-z][a-z0-9+.-]*://)[^/?#\s]*@', '\1', 'g'),
  '(?i){_KEYS}[:=]\s*)(?:"[^"]*(?:"|$)|''[^'']*(?:''|$))', '\1[redacted]', 'g'),
  '(?i){_KEYS}=\s+)[^\s;,"''\[][^\s;,]*', '\1[redacted]', 'g'), '(?i){_KEYS}=)[^\s;,"''\[=>~][^\s;,]*', '\1[redacted]', 'g')"""
_REDACTED = rf"""array_to_string(list_transform(regexp_extract_all({_NAMED}, '[A-Za-z0-9+/=]+|[^A-Za-z0-9+/=]+'),
  lambda x: CASE WHEN length(x) >= 40 AND regexp_full_match(x, '[A-Za-z0-9+/=]+') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[+/=]') THEN '[redacted]' ELSE x END), '')"""


@query("redacted_documents", f"WITH p AS (SELECT DISTINCT doc_id, {_PLAIN} AS plain FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, plain, {_REDACTED} AS redacted FROM p) SELECT doc_id, redacted FROM r WHERE plain <> redacted")
def redacted_documents(r: Relations) -> DataFrame:
    """Documents whose text holds a secret, with the secret taken out."""
    from loamgraph.functions.text import redact, strip_controls

    rows = r.documents.where("text is not null").select("doc_id", strip_controls("text").alias("plain"), redact("text").alias("redacted"))
    return rows.where("plain <> redacted").select("doc_id", "redacted")


