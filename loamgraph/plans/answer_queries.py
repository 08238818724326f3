"""Queries of sources, sinks and composed answers over whole tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import TEST_PATH_IMPACT, query_terms
from loamgraph.operators import answers, graph, resolve, spans, textsearch
from loamgraph.plans import graph_queries as G
from loamgraph.plans.sql import EDGES, FILES, LINES, LINKS, NODES, TERMS, WALK, statement
from loamgraph.session import materialize
from loamgraph.sources import repository, sinks
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


r6 = G.r6
_DIR = "CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END"


def _rules_sql() -> str:
    whens = " ".join(f"WHEN regexp_extract(text, '{r}', 1) <> '' THEN {{k{n}}}" for n, (_, r) in enumerate(repository.RULES))
    name = whens.format(**{f"k{n}": f"regexp_extract(text, '{r}', 1)" for n, (_, r) in enumerate(repository.RULES)}) if "{" not in "".join(r for _, r in repository.RULES) else ""
    kind = whens.format(**{f"k{n}": f"'{k}'" for n, (k, _) in enumerate(repository.RULES)})
    return f"SELECT path, line, CASE {name} END AS name, CASE {kind} END AS kind FROM gl WHERE CASE {kind} END IS NOT NULL"


@query("s8_definitions", statement(LINES, select=_rules_sql()))
def s8_definitions(r: Relations) -> DataFrame:
    return repository.definitions_by_rule(r.lines)


@query("s6_dispatch", statement(FILES, select="SELECT file_id, CASE WHEN suffix(path, '.ts') THEN 'typescript' WHEN suffix(path, '.js') THEN 'javascript' WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.java') THEN 'java' WHEN suffix(path, '.rs') THEN 'rust' WHEN suffix(path, '.go') THEN 'go' END AS language FROM gf"))
def s6_dispatch(r: Relations) -> DataFrame:
    return r.files.select("file_id", repository.language("path").alias("language"))


_CARDS = "cd AS (SELECT path, string_agg('- ' || kind || ' ' || coalesce(name, '?') || ' L' || start_line || '-L' || end_line, chr(10) ORDER BY start_line, id) AS card FROM gn WHERE kind <> 'file' AND start_line IS NOT NULL AND end_line IS NOT NULL GROUP BY path)"


@query("k4_cards", statement(NODES, _CARDS, select="SELECT path, card FROM cd"))
def k4_cards(r: Relations) -> DataFrame:
    return sinks.cards(r.nodes)


@query("k5_covers", statement(LINKS, NODES, select="SELECT l.entry AS doc_id, array_to_string(list_sort(list(DISTINCT n.id)), ';') AS covers FROM lk l JOIN gn n ON n.path = l.path AND n.kind <> 'file' AND n.exported WHERE l.entry IS NOT NULL GROUP BY l.entry"))
def k5_covers(r: Relations) -> DataFrame:
    sources = r.links.where("entry is not null").select(F.col("entry").alias("doc_id"), "path")
    return sinks.covers(sources, r.nodes).select("doc_id", F.array_join("covers", ";").alias("covers"))


@query("k7_context", statement(NODES, EDGES, select="SELECT 'node' AS kind, CAST(to_json({'id': id, 'name': name, 'path': path}) AS VARCHAR) AS json FROM gn UNION ALL SELECT 'edge', CAST(to_json({'source': source, 'target': target, 'relation': relation}) AS VARCHAR) FROM ge WHERE source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn)"))
def k7_context(r: Relations) -> DataFrame:
    return sinks.context_json(r.nodes, r.edges)


@query("x24_read_decision", statement(NODES, FILES, _CARDS, select="SELECT f.path, strlen(f.content) >= 16384 AND strlen(coalesce(c.card, '')) >= 64 AND 2 * strlen(coalesce(c.card, '')) <= strlen(f.content) AS outlined FROM gf f LEFT JOIN cd c USING (path) WHERE f.content IS NOT NULL"))
def x24_read_decision(r: Relations) -> DataFrame:
    return answers.read_decision(r.files, sinks.cards(r.nodes))


# --- the full answer -------------------------------------------------------------------------------------------------

_W = f"""wt AS (SELECT DISTINCT t.id, t.term, i.idf AS w FROM tt t JOIN idf i USING (term) WHERE t.term IN ({G._Q})),
wa AS (SELECT sum(w) AS a FROM (SELECT DISTINCT term, w FROM wt)),
cn AS (SELECT c.id, c.path, c.lexical, c.graph, c.baseline, coalesce(l.lexical, 0) AS raw, n.start_line FROM cand c JOIN gn n USING (id) LEFT JOIN (SELECT * FROM lex WHERE lexical > 0) l USING (id) WHERE c.baseline > 0),
ow AS (SELECT id, sum(w) AS a FROM wt GROUP BY id),
an AS (SELECT cn.*, ow.a FROM cn LEFT JOIN ow USING (id) QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(raw, 9) DESC, round(coalesce(a, 0), 9) DESC, start_line, id) = 1),
un AS (SELECT path, sum(w) AS u FROM (SELECT DISTINCT c.path, w.term, w.w FROM cn c JOIN wt w USING (id)) GROUP BY path),
pf AS (SELECT path, id AS anchor, least(1.0, greatest(0.0, lexical + (1 - lexical) * CASE WHEN u > 0 THEN (coalesce(an.a, 0) / wa.a) * (u / wa.a - coalesce(an.a, 0) / wa.a) / (u / wa.a) ELSE 0 END + 0.5 * graph)) * {G._FACTOR} AS score FROM an LEFT JOIN un USING (path) CROSS JOIN wa)"""
_FULL = (TERMS, WALK, G._LEX, G._pagerank_sql(), G._CAND, _W)


def _candidates(r: Relations) -> tuple[DataFrame, DataFrame]:
    lexical = G._lexical(r)
    cands = textsearch.candidates(r.nodes, lexical, G._ranks(r, lexical), G.QUESTION).withColumn("raw_lexical", F.round("raw_lexical", 9))
    cands = materialize(cands, "candidates")  # read for the anchors, the unions and the order
    stats = textsearch.corpus_stats(r.nodes, r.terms)
    weights = answers.term_weights(r.terms, textsearch.inverse_frequency(r.terms, stats), query_terms(G.QUESTION))
    return cands, answers.pooled_files(cands, weights, G.QUESTION)


@query("x9_pooled_files", statement(*_FULL, select="SELECT path, anchor, round(score, 6) AS score FROM pf"))
def x9_pooled_files(r: Relations) -> DataFrame:
    return _candidates(r)[1].select("path", "anchor", r6("score").alias("score"))


@query(
    "x10_ask",
    statement(
        *_FULL,
        "tp AS (SELECT path FROM cn ORDER BY round(baseline, 9) DESC, id LIMIT 1)",
        "dp AS (SELECT cn.id, cn.path, round(pf.score, 9) AS score, row_number() OVER (PARTITION BY cn.path ORDER BY round(baseline, 9) DESC, cn.id) AS depth FROM cn JOIN pf USING (path))",
        select="SELECT row_number() OVER (ORDER BY depth, (path <> (SELECT path FROM tp))::INT, score DESC, path, id) AS position, id, path FROM dp ORDER BY position LIMIT 8",
    ),
)
def x10_ask(r: Relations) -> DataFrame:
    """The whole ranked answer, the eight first places."""
    cands, files = _candidates(r)
    return answers.final_order(cands.withColumn("baseline", F.round("baseline", 9)), files.withColumn("score", F.round("score", 9)))


def _scoped_sql() -> str:
    s = G._pagerank_sql().replace("pairs AS (SELECT w.source, w.target FROM we w JOIN gn a ON a.id = w.source JOIN gn b ON b.id = w.target)", "pairs AS (SELECT w.source, w.target FROM we w JOIN gn a ON a.id = w.source JOIN gn b ON b.id = w.target WHERE split_part(a.path, '/', 1) = split_part(b.path, '/', 1))")
    s = s.replace("(SELECT sum(lexical) FROM lex WHERE lexical > 0) AS r FROM lex WHERE lexical > 0)", "sum(lexical) OVER (PARTITION BY sc.scope) AS r, sc.scope FROM lex JOIN sc USING (id) WHERE lexical > 0)")
    s = s.replace("restart AS MATERIALIZED (SELECT id,", "sc AS (SELECT id, split_part(path, '/', 1) AS scope FROM gn),\nrestart AS MATERIALIZED (SELECT id,")
    for k in range(textsearch.ROUNDS):
        s = s.replace(f"coalesce((SELECT sum(m) FROM m{k} WHERE id NOT IN (SELECT source FROM adj)), 0) FROM restart)", f"coalesce(x.l, 0) FROM restart LEFT JOIN (SELECT scope, sum(m) AS l FROM m{k} JOIN sc USING (id) WHERE id NOT IN (SELECT source FROM adj) GROUP BY scope) x USING (scope))")
    end = textsearch.ROUNDS
    return s.replace(f"pr AS (SELECT id, m / (SELECT max(m) FROM m{end}) AS rank FROM m{end} WHERE m > 0)", f"pr AS (SELECT sc.scope, id, m / max(m) OVER (PARTITION BY sc.scope) AS rank FROM m{end} JOIN sc USING (id) WHERE m > 0)")


@query("x11_scoped_pagerank", statement(TERMS, WALK, G._LEX, _scoped_sql(), select="SELECT scope, id, round(rank, 6) AS rank FROM pr"))
def x11_scoped_pagerank(r: Relations) -> DataFrame:
    """One walk per scope over the scope's own subgraph, all scopes in the same jobs."""
    scope = F.substring_index("path", "/", 1).alias("scope")
    nodes = r.nodes.select("id", scope)
    seeds = G._lexical(r).join(nodes, "id").select("scope", "id", F.col("lexical").alias("weight"))
    return textsearch.pagerank(nodes, r.walk, seeds, group=["scope"]).select("scope", "id", r6("rank").alias("rank"))


@query("x13_structural", statement(NODES, WALK, select=f"SELECT DISTINCT w.source AS other, w.relation FROM we w JOIN gn n ON n.id = w.target WHERE n.kind = 'file' AND lower(n.path) LIKE '%/{G.SYMBOL}' AND w.relation <> 'imports'"))
def x13_structural(r: Relations) -> DataFrame:
    """A question about callers, answered from the graph: each caller and relation once."""
    direction, subjects = answers.structural_intent(f"who calls {G.SYMBOL}")
    found = graph.resolve_symbol(r.nodes, subjects[0]).select(F.col("id").alias("of"))
    hits = graph.callers(r.walk.where("relation <> 'imports'"), r.nodes, incoming=direction == "in")
    return hits.join(found, "of", "left_semi").select("other", "relation").distinct()


@query(
    "x25_gate",
    statement(
        TERMS, G._LEX, G._FORMS,
        "ww AS (SELECT DISTINCT f.word, coalesce(i.idf, ln(1 + st.n_docs)) AS w FROM (SELECT DISTINCT word FROM forms) f LEFT JOIN idf i ON i.term = f.word CROSS JOIN st)",
        "fd AS (SELECT t.id, f.word, max((t.field = 'name' AND g.kind <> 'file')::INT) AS in_name FROM tt t JOIN forms f USING (term) JOIN gn g USING (id) GROUP BY ALL)",
        "cv AS (SELECT id, sum(w) / (SELECT sum(w) FROM ww) AS c, sum(w * in_name) / (SELECT sum(w) FROM ww) AS s FROM fd JOIN ww USING (word) GROUP BY id)",
        select="SELECT id FROM cv WHERE round(s, 9) >= 0.1 OR round(c, 9) >= 0.5",
    ),
)
def x25_gate(r: Relations) -> DataFrame:
    """Hits strong enough to be put before a prompt."""
    stats = textsearch.corpus_stats(r.nodes, r.terms)
    rows = textsearch.coverage(r.terms, r.nodes, G.QUESTION, textsearch.inverse_frequency(r.terms, stats), stats)
    return rows.where((F.round("strong", 9) >= 0.1) | (F.round("coverage", 9) >= 0.5)).select("id")


# --- change, evidence, words -----------------------------------------------------------------------------------------

_TESTS = f"ts AS (SELECT DISTINCT e.target AS id, s.path AS test FROM ge e JOIN gn s ON s.id = e.source WHERE {G._TEST_IMPACT.format(p='s.path')})"


@query(
    "a10_changed_areas",
    statement(
        NODES, EDGES, _TESTS, f"ch AS (SELECT DISTINCT id, {_DIR.format(p='path')} AS dir FROM gn WHERE kind <> 'file' AND summary_state = 'stale')",
        "pr AS (SELECT dir, count(*) AS n_changed, count(*) FILTER (id IN (SELECT id FROM ts)) AS n_reached FROM ch GROUP BY dir)",
        select="SELECT p.dir, p.n_changed, p.n_reached, coalesce(t.n, 0) AS n_tests, CASE WHEN n_reached = 0 THEN 'none' WHEN n_reached < n_changed THEN 'some' ELSE 'all' END AS signal FROM pr p LEFT JOIN (SELECT dir, count(DISTINCT test) AS n FROM ch JOIN ts USING (id) GROUP BY dir) t USING (dir)",
    ),
)
def a10_changed_areas(r: Relations) -> DataFrame:
    tests = r.edges.join(r.nodes.where(F.col("path").rlike(TEST_PATH_IMPACT)).select(F.col("id").alias("source"), F.col("path").alias("test")), "source").select(F.col("target").alias("id"), "test").distinct()
    return answers.changed_areas(r.symbols.where("summary_state = 'stale'").select("id", "path"), tests)


@query("g7_area_edges", statement(NODES, WALK, f"d AS (SELECT id, {_DIR.format(p='path')} AS dir FROM gn)", select="SELECT DISTINCT a.dir AS source, b.dir AS target FROM we w JOIN d a ON a.id = w.source JOIN d b ON b.id = w.target WHERE a.dir <> b.dir"))
def g7_area_edges(r: Relations) -> DataFrame:
    return answers.area_edges(r.walk, r.nodes)


@query("g12_why_diff", statement(NODES, LINKS, G._SPANS, G._RANGES, G._OVER, select="SELECT l.entry, o.id, min(l.level) AS level FROM (SELECT DISTINCT id FROM ov) o JOIN lk l ON l.node = o.id WHERE l.entry IS NOT NULL GROUP BY l.entry, o.id"))
def g12_why_diff(r: Relations) -> DataFrame:
    touched = spans.overlapping_all(G._ranges(r), r.symbols).select("id").distinct()
    return r.links.where("entry is not null").select("entry", F.col("node").alias("id"), "level").join(touched, "id", "left_semi").groupBy("entry", "id").agg(F.min("level").alias("level"))


@query("t5_why_rows", statement(LINKS, select="SELECT node, entry, row_number() OVER (PARTITION BY node ORDER BY min(level), entry DESC) AS position FROM lk WHERE node <> '' AND entry IS NOT NULL GROUP BY node, entry"))
def t5_why_rows(r: Relations) -> DataFrame:
    best = r.links.where("node <> '' and entry is not null").groupBy("node", "entry").agg(F.min("level").alias("level"))
    return best.select("node", "entry", F.row_number().over(Window.partitionBy("node").orderBy("level", F.desc("entry"))).alias("position"))


@query("x23_annotated", statement(NODES, LINES, G._SPANS, f"hit AS (SELECT path, line FROM gl WHERE regexp_matches(text, '{G._PATTERN_SQL}'))", select="SELECT h.path, h.line, arg_max(s.id, (s.start_line, s.node_key)) AS id FROM hit h LEFT JOIN sp s ON s.path = h.path AND h.line BETWEEN s.start_line AND s.end_line GROUP BY ALL"))
def x23_annotated(r: Relations) -> DataFrame:
    hits = spans.search_lines(r.lines, G.PATTERN).select(F.concat_ws(":", "path", "line", "text").alias("row")).withColumn("row_id", F.xxhash64("row"))
    return answers.annotate_rows(hits, r.symbols).select("path", "line", "id")


@query("a16_grep_chars", statement(LINES, select=f"SELECT CAST(sum(length(path) + length(line::VARCHAR) + length(left(trim(text), 160)) + 2) AS BIGINT) AS chars, count(*) AS hits FROM gl WHERE regexp_matches(text, '{G._PATTERN_SQL}')"))
def a16_grep_chars(r: Relations) -> DataFrame:
    """Characters a plain search would print for the pattern."""
    rows = spans.search_lines(r.lines, G.PATTERN)
    return rows.agg(F.sum(F.length("path") + F.length(F.col("line").cast("string")) + F.length("text") + 2).alias("chars"), F.count("*").alias("hits"))


@query("v11_word_index", statement(LINES, select="SELECT path, word, count(*) AS n_lines FROM (SELECT path, line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS word FROM gl) GROUP BY ALL"))
def v11_word_index(r: Relations) -> DataFrame:
    return answers.word_index(r.lines)


@query("a19_session_rollup", "SELECT user_id::VARCHAR AS session, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def a19_session_rollup(r: Relations) -> DataFrame:
    """Sessions with their sub-sessions ``<id>.<kind>`` added up."""
    rows = r.raw("events").select(F.concat_ws(".", "user_id", "event_type").alias("id"), "value")
    return rows.groupBy(F.substring_index("id", ".", 1).alias("session")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("a23_spread", "SELECT event_type, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END, 6) AS sd FROM events GROUP BY event_type")
def a23_spread(r: Relations) -> DataFrame:
    sd = F.stddev_pop("value")
    return r.raw("events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.when(sd > 0, sd).otherwise(F.lit(1.0))).alias("sd"))


_HER = "hr AS (SELECT edge_id AS ref_id, regexp_replace(source, '#.*$', '') AS path, regexp_replace(target, '^.*[#.]', '') AS name FROM ge WHERE relation IN ('extends', 'implements'))"


@query(
    "j9_heritage",
    statement(
        NODES, EDGES, _HER, f"sy AS (SELECT id, path, name, {G._FAM.format(p='path')} AS f FROM gn WHERE kind IN ('class', 'struct', 'interface', 'trait'))",
        "lo AS (SELECT path, name, count(*) AS n, min(id) AS id FROM sy GROUP BY ALL)", "wo AS (SELECT name, f, count(*) AS n, min(id) AS id FROM sy GROUP BY ALL)", "ao AS (SELECT name, count(*) AS n, min(id) AS id FROM sy GROUP BY ALL)",
        select=f"SELECT h.ref_id, coalesce(CASE WHEN l.n = 1 THEN l.id WHEN l.n IS NULL AND w.n = 1 THEN w.id WHEN l.n IS NULL AND {G._FAM.format(p='h.path')} IS NULL AND a.n = 1 THEN a.id END, h.name) AS target, CASE WHEN l.n = 1 THEN 'extracted' ELSE 'inferred' END AS confidence FROM hr h LEFT JOIN lo l ON l.path = h.path AND l.name = h.name LEFT JOIN ao a ON a.name = h.name LEFT JOIN wo w ON w.name = h.name AND w.f = {G._FAM.format(p='h.path')}",
    ),
)
def j9_heritage(r: Relations) -> DataFrame:
    """Base types of every class: resolved among types, else the raw name."""
    raw = r.edges.where("relation in ('extends', 'implements')").select(F.col("edge_id").alias("ref_id"), F.regexp_replace("source", r"#.*$", "").alias("path"), F.regexp_replace("target", r"^.*[#.]", "").alias("name"))
    types = r.nodes.where("kind in ('class', 'struct', 'interface', 'trait')")
    found = resolve.resolve_names(raw, types)
    return raw.join(found, "ref_id", "left").select("ref_id", F.coalesce("target", "name").alias("target"), F.coalesce("confidence", F.lit("inferred")).alias("confidence"))


@query("j34_value_references", statement(NODES, EDGES, select="SELECT e.edge_id FROM ge e JOIN gn n ON n.id = e.target AND n.kind IN ('function', 'method') WHERE e.relation = 'references' AND e.confidence <> 'inferred'"))
def j34_value_references(r: Relations) -> DataFrame:
    return r.edges.where("relation = 'references' and confidence <> 'inferred'").join(r.nodes.where("kind in ('function', 'method')").select(F.col("id").alias("target")), "target", "left_semi").select("edge_id")


@query("u1_federated", statement(LINES, select=f"SELECT path, line, left(trim(text), 160) AS text FROM gl WHERE regexp_matches(text, '{G._PATTERN_SQL}')"))
def u1_federated(r: Relations) -> DataFrame:
    """A search in every member of the workspace, its paths put below the member again."""
    from loamgraph.operators.workspace import federated_rows

    own = r.files.where(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("child"), F.expr("substring(path, instr(path, '/') + 1)").alias("path"), "content")
    key = F.concat_ws("\0", "child", "path")
    hits = spans.search_files(own.select(key.alias("path"), "content"), G.PATTERN)
    return federated_rows(hits.select(F.substring_index("path", "\0", 1).alias("child"), F.substring_index("path", "\0", -1).alias("path"), "line", "text"))


@query("u1_members", statement(NODES, select="SELECT split_part(path, '/', 1) AS child, count(*) AS n_nodes FROM gn GROUP BY 1 UNION ALL SELECT s.prefix, 0 FROM (SELECT DISTINCT prefix FROM scopes) s WHERE s.prefix NOT IN (SELECT split_part(path, '/', 1) FROM gn)"))
def u1_members(r: Relations) -> DataFrame:
    """Members of the workspace with the size of their graphs; members without one count 0."""
    present = r.nodes.groupBy(F.substring_index("path", "/", 1).alias("child")).agg(F.count("*").alias("n_nodes"))
    absent = repository.missing_children(r.scopes.select(F.col("prefix").alias("child")), present)
    return present.unionByName(absent.select("child", F.lit(0).cast("long").alias("n_nodes")))


@query("v6_drifted_check", statement(NODES, G._LAST, FILES, "dr AS (SELECT coalesce(b.path, n.path) AS path FROM bf b FULL JOIN gf n ON n.path = b.path WHERE b.path IS NULL OR n.path IS NULL OR NOT (coalesce(b.hash = n.hash, b.size IS NOT DISTINCT FROM n.size AND b.mtime_ms IS NOT DISTINCT FROM n.mtime_ms) OR (b.size IS NOT DISTINCT FROM n.size AND b.mtime_ms IS NOT DISTINCT FROM n.mtime_ms AND (b.hash IS NULL OR n.hash IS NULL))))", select="SELECT id, summary_state FROM gn WHERE kind <> 'file' AND path IN (SELECT path FROM dr)"))
def v6_drifted_check(r: Relations) -> DataFrame:
    """Symbols of the files that drifted, with the state of their summaries."""
    from loamgraph.operators.freshness import drift

    return r.symbols.join(drift(G._last_listing(r), r.files).select("path"), "path", "left_semi").select("id", "summary_state")


# --- sessions, concepts, topics, caps --------------------------------------------------------------------------------


@query(
    "v10_sessions",
    """WITH o AS (SELECT user_id, ts, value, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def v10_sessions(r: Relations) -> DataFrame:
    from loamgraph.streaming.sessions import sessions

    return sessions(r.raw("events")).select("user_id", F.unix_micros("session_start").alias("session_start"), "n", F.round("total", 4).alias("total"))


def _tok(text: str) -> str:
    from loamgraph.plans.sql import tokens_sql

    return tokens_sql(text)


_HEAD = "regexp_extract(text, '^#[^\\n\\r]*')"


@query(
    "x12_concepts",
    f"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
tb AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok(_HEAD)}) AS term FROM d) GROUP BY ALL),
bb AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM d) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM d) / (1 + count(DISTINCT id))) AS idf FROM bb GROUP BY term)
SELECT id, round(sum(tf * idf), 6) AS score FROM (SELECT id, term, 3 * tf AS tf FROM tb UNION ALL SELECT id, term, tf FROM bb) JOIN idf USING (term) WHERE term IN ({G._Q}) GROUP BY id""",
)
def x12_concepts(r: Relations) -> DataFrame:
    from loamgraph.operators.workspace import concept_scores
    from loamgraph.sources.relations import term_bag

    docs = r.documents.where("text is not null").withColumn("head", F.regexp_extract("text", r"^(#[^\n\r]*)", 1))
    bodies = term_bag(docs, "doc_id", "text")
    stats = docs.agg(F.count("*").alias("n_docs"), F.lit(0.0).alias("avg_body_len"))
    rows = concept_scores(term_bag(docs, "doc_id", "head", "name"), bodies, textsearch.inverse_frequency(bodies, stats), query_terms(G.QUESTION))
    return rows.select("id", r6("score").alias("score"))


@query(
    "x19_topics",
    statement(
        NODES,
        f"rc AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM (SELECT DISTINCT doc_id, text FROM documents WHERE path LIKE 'adr/%')) GROUP BY ALL)",
        f"fl AS (SELECT path AS id, term, count(*) AS tf FROM (SELECT path, unnest({_tok('summary')}) AS term FROM gn WHERE summary IS NOT NULL) GROUP BY ALL)",
        "n AS (SELECT count(DISTINCT id) AS n, sum(tf) AS a FROM rc)",
        "rw AS (SELECT r.id AS record, r.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (a / n))) AS w FROM rc r JOIN (SELECT term, count(*) AS df FROM rc GROUP BY term) USING (term) JOIN (SELECT id, sum(tf) AS dl FROM rc GROUP BY id) USING (id) CROSS JOIN n)",
        "fw AS (SELECT id AS file, term FROM (SELECT f.id, f.term, (1 + ln(tf)) * ln((SELECT count(DISTINCT id) FROM fl) / df) AS fw FROM fl f JOIN (SELECT term, count(*) AS df FROM fl GROUP BY term) USING (term)) WHERE fw > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY fw DESC, term) <= 50)",
        "sc AS (SELECT file, record, sum(w) AS score FROM fw JOIN rw USING (term) GROUP BY ALL)",
        "st AS (SELECT file, avg(score) AS mean, stddev_pop(score) AS sd, count(*) AS m FROM sc GROUP BY file)",
        "zz AS (SELECT file, record, round(score, 6) AS score, round((score - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM sc JOIN st USING (file) WHERE sqrt(m - 1) >= 4.5)",
        select="SELECT file, record, score, z FROM zz WHERE z >= 4.5 QUALIFY row_number() OVER (PARTITION BY file ORDER BY z DESC, record) <= 2",
    ),
)
def x19_topics(r: Relations) -> DataFrame:
    """Records of the folder ``adr`` that stand out for the summaries of a file; ``x19_record_topics`` takes all records."""
    from loamgraph.sources.relations import term_bag

    recs = term_bag(r.documents.where(F.col("path").startswith("adr/")), "doc_id", "text")
    files = term_bag(r.nodes.where("summary is not null"), "path", "summary")
    return textsearch.topic_links(recs, files).select("file", "record", r6("score").alias("score"), r6("z").alias("z"))


@query("x19_record_topics")
def x19_record_topics(r: Relations) -> DataFrame:
    """Every dated record, of whatever folder, that stands out for the summaries of a file and is not linked to it exactly."""
    from loamgraph.operators.records import exact_files, record_entries
    from loamgraph.sources.relations import term_bag

    docs = r.documents.join(record_entries(r.documents).select("doc_id"), "doc_id", "left_semi")
    docs = materialize(docs.select("doc_id", "path", "text"), "records")  # read for the weights, their statistics and the exact links
    nodes = materialize(r.nodes.select("id", "kind", "name", "path", "summary"), "nodes")  # read for ids, names, paths and summaries
    known = exact_files(docs, nodes).select(F.col("path").alias("file"), F.col("doc_id").alias("record"))
    files = term_bag(nodes.where("summary is not null"), "path", "summary")
    return textsearch.topic_links(term_bag(docs, "doc_id", "text"), files, known=known).select("file", "record", r6("score").alias("score"), r6("z").alias("z"))


@query("w11_capped_find", statement(LINES, f"hit AS (SELECT path, line, row_number() OVER (ORDER BY path, line) AS k FROM gl WHERE regexp_matches(text, '{G._PATTERN_SQL}'))", select="SELECT count(*) FILTER (k <= 300) AS shown, count(*) FILTER (k > 300) AS hidden, (SELECT count(DISTINCT path) FROM hit WHERE path NOT IN (SELECT path FROM hit WHERE k <= 300)) AS dropped_files FROM hit"))
def w11_capped_find(r: Relations) -> DataFrame:
    """What a search report shows of its hits: the first 300 in file order, and how much is hidden. The cap is the report's feature."""
    hits = spans.search_lines(r.lines, G.PATTERN).select("path", "line")
    first = hits.orderBy("path", "line").limit(300)
    total = hits.agg(F.count("*").alias("all"))
    gone = hits.select("path").distinct().join(first.select("path").distinct(), "path", "left_anti").agg(F.count("*").alias("dropped_files"))
    return first.agg(F.count("*").alias("shown")).join(total).join(gone).select("shown", (F.col("all") - F.col("shown")).alias("hidden"), "dropped_files")
