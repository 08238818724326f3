"""Verbs over a folder of tables; each answer is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import query_terms, under
from loamgraph.operators import answers, freshness, graph, records, spans, textsearch
from loamgraph.session import materialize
from loamgraph.sources.relations import Relations


class Graph:
    """The code graph below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.relations = Relations(spark, folder)

    def ask(self, question: str, *, within: str = "", limit: int = 8) -> DataFrame:
        """position, id, path: ranked answer to a question; a question about callers or callees is answered from the graph where its subject resolves."""
        r = self.relations
        intent = answers.structural_intent(question)
        for subject in intent[1] if intent else []:
            found = graph.resolve_symbol(r.nodes, subject, within)
            if not found.isEmpty():
                hits = graph.callers(r.walk, r.nodes, incoming=intent[0] == "in").join(found.select(F.col("id").alias("of")), "of", "left_semi")
                first = hits.groupBy("other", "relation").agg(F.min("ord").alias("ord"))
                rows = first.join(r.nodes.select(F.col("id").alias("other"), "path"), "other", "left").orderBy("ord", "other").limit(limit)
                return rows.select("ord", F.col("other").alias("id"), "path", "relation")
        nodes = r.nodes.where(under("path", within))
        terms = r.terms.join(nodes.select("id"), "id", "left_semi") if within else r.terms
        lexical = materialize(textsearch.lexical_scan(nodes, question) if within else r.lexical(question), "lexical")
        ranks = textsearch.pagerank(nodes, r.walk, lexical.select("id", F.col("lexical").alias("weight")))
        cands = materialize(textsearch.candidates(nodes, lexical, ranks, question), "candidates")
        idf = textsearch.inverse_frequency(terms, textsearch.corpus_stats(nodes, terms))
        files = answers.pooled_files(cands, answers.term_weights(terms, idf, query_terms(question)), question)
        return answers.final_order(cands, files, limit)

    def find(self, pattern: str, *, fixed: bool = False, ignore_case: bool = False, within: str = "", cap: int | None = 300) -> DataFrame:
        """path, id, n_hits, first_line, in_degree of the spans whose lines match, and with a cap how many hits are ``dropped``; None for no cap."""
        r = self.relations
        hits = spans.search_files(r.files, pattern, fixed=fixed, ignore_case=ignore_case, prefix=within)
        return spans.grep_groups(hits, r.symbols, graph.in_degree(r.walk), cap=cap).orderBy(F.desc("in_degree"), "path", "first_line")

    def callers(self, symbol: str, *, depth: str | None = None, incoming: bool = True, within: str = "") -> DataFrame:
        """id, depth, parent of everything that reaches a symbol; a file stands for its symbols too."""
        r = self.relations
        found = graph.resolve_symbol(r.nodes, symbol, within).select("id")
        paths = r.nodes.join(found, "id", "left_semi").where("kind = 'file'").select("path")
        seeds = found.unionByName(r.nodes.join(paths, "path", "left_semi").select("id")).distinct()
        return graph.reach(r.walk, seeds.select(F.lit(symbol).alias("origin"), "id"), incoming=incoming, depth=answers.parse_depth(depth)).drop("origin")

    def impact(self, ranges: DataFrame, *, depth: str | None = "2") -> DataFrame:
        """id, path, depth, n_origins of what changed line ranges (path, start_line, end_line) reach; a file without a touched symbol stands for itself."""
        r = self.relations
        touched = spans.overlapping(ranges, r.symbols).select("path", "id").distinct()
        bare = ranges.select("path").distinct().join(touched, "path", "left_anti").select("path", F.col("path").alias("id"))
        seeds = touched.unionByName(bare).select(F.col("path").alias("origin"), "id")
        return graph.impact(graph.reach(r.walk, seeds, depth=answers.parse_depth(depth)), r.nodes)

    def map(self, *, max_dirs: int = 16) -> DataFrame:
        """dir, n_files, n_symbols, hubs of the largest folders, and how many more there are as ``dropped``."""
        r = self.relations
        rollup = graph.directory_rollup(r.nodes)
        hubs = graph.hubs(r.nodes, graph.in_degree(r.walk), depth=1).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h")).select("dir", F.transform("h", lambda x: x["id"]).alias("hubs"))
        total = rollup.agg(F.count("*").alias("_all"))
        top = rollup.orderBy(F.desc("n_files"), "dir").limit(max_dirs)
        return top.join(hubs, "dir", "left").join(F.broadcast(total)).withColumn("dropped", F.greatest(F.lit(0), F.col("_all") - max_dirs)).drop("_all").orderBy(F.desc("n_files"), "dir")

    def symbols(self, path: str) -> DataFrame:
        """Definitions of a file, named by its path or a unique end of it, in file order."""
        r = self.relations
        files = r.nodes.where("kind = 'file'").where((F.col("path") == path) | F.col("path").endswith("/" + path)).select("path")
        return graph.outline(r.nodes, graph.in_degree(r.walk)).join(files, "path", "left_semi").orderBy("path", "start_line", "id")

    def why(self, symbol: str, *, limit: int = 10) -> DataFrame:
        """node, entry, level, superseded: decision records behind a symbol or its file, the strongest level first."""
        r = self.relations
        found = graph.resolve_symbol(r.nodes, symbol).join(r.nodes.select("id", "path"), "id")
        keys = found.select(F.col("id").alias("node")).unionByName(found.select(F.col("path").alias("node"))).distinct()
        entries = records.record_entries(r.documents)
        rows = records.why(r.links, entries, records.superseded(entries, r.documents))
        return rows.join(keys, "node", "left_semi").orderBy("level", F.desc("entry")).limit(limit)

    def check(self, before: DataFrame) -> DataFrame:
        """added, removed, changed, stale, pending and ok against an earlier state of the nodes."""
        nodes = self.relations.nodes
        return freshness.check_counts(freshness.check(before, nodes), nodes)
