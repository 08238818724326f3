"""Composition of answers: pooled files, the final order, areas of a change, gates and savings kernels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import parent_dir
from loamgraph.operators.textsearch import GRAPH_WEIGHT, rank_factor


def term_weights(terms: DataFrame, idf: DataFrame, words: list[str]) -> DataFrame:
    """id, term, w: the query's terms that a node holds exactly in any field, with their idf."""
    return terms.where(F.col("term").isin(words)).select("id", "term").distinct().join(F.broadcast(idf.where(F.col("term").isin(words)).select("term", F.col("idf").alias("w"))), "term")


def pooled_files(cands: DataFrame, weights: DataFrame, query: str) -> DataFrame:
    """path, anchor, score: of each file the strongest candidate, lifted by what the file's other candidates add to its terms.

    A is the idf weight of the anchor's terms, U that of all terms in the file; R = A (U - A) / U, all over the weight of the
    query; score = factor (lex + (1 - lex) R + graph / 2) in [0, 1] before the factor.
    """
    total = weights.select("term", "w").distinct().agg(F.sum("w").alias("_all"))
    own = weights.groupBy("id").agg(F.sum("w").alias("a"))
    w = Window.partitionBy("path").orderBy(F.desc("raw_lexical"), F.desc(F.coalesce("a", F.lit(0.0))), "start_line", "id")
    anchors = cands.join(own, "id", "left").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    union = cands.select("id", "path").join(weights, "id").select("path", "term", "w").distinct().groupBy("path").agg(F.sum("w").alias("u"))
    rows = anchors.join(union, "path", "left").join(F.broadcast(total))
    a, u = F.coalesce(F.col("a") / F.col("_all"), F.lit(0.0)), F.coalesce(F.col("u") / F.col("_all"), F.lit(0.0))
    r = F.when(u > 0, a * (u - a) / u).otherwise(F.lit(0.0))
    inner = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("lexical") + (1 - F.col("lexical")) * r + GRAPH_WEIGHT * F.col("graph")))
    return rows.select("path", F.col("id").alias("anchor"), (inner * rank_factor("path", query)).alias("score"))


def final_order(cands: DataFrame, files: DataFrame, limit: int = 8) -> DataFrame:
    """position, id, path: the best candidate first with its file's queue, then all files' leaders by pooled score, then their seconds. A top-k report."""
    top = cands.orderBy(F.desc("baseline"), "id").limit(1).select(F.col("path").alias("_top"))
    depth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("baseline"), "id"))
    rows = cands.withColumn("depth", depth).where(F.col("depth") <= limit).join(files.select("path", "score"), "path").join(F.broadcast(top))
    ordered = rows.orderBy("depth", F.col("path") != F.col("_top"), F.desc("score"), "path", "id").limit(limit)
    return ordered.select(F.row_number().over(Window.orderBy("depth", F.col("path") != F.col("_top"), F.desc("score"), "path", "id")).alias("position"), "id", "path")


def changed_areas(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """dir, n_changed, n_reached, n_tests, signal: what of a change tests reach, by folder.

    ``changed`` has id and path, ``tests`` id and test (paths). The signal is ``all``, ``some`` or ``none``.
    """
    hit = tests.groupBy("id").agg(F.lit(1).alias("hit"))
    c = changed.select("id", parent_dir("path").alias("dir")).distinct()
    per = c.join(hit, "id", "left").groupBy("dir").agg(F.count("*").alias("n_changed"), F.count("hit").alias("n_reached"))
    n_tests = c.join(tests, "id").groupBy("dir").agg(F.count_distinct("test").alias("n_tests"))
    signal = F.when(F.col("n_reached") == 0, "none").when(F.col("n_reached") < F.col("n_changed"), "some").otherwise("all")
    return per.join(n_tests, "dir", "left").select("dir", "n_changed", "n_reached", F.coalesce("n_tests", F.lit(0)).alias("n_tests"), signal.alias("signal"))


def coarsen(areas: dict[str, int], most: int = 5) -> dict[str, int]:
    """Folders with their counts, the deepest and of these the smallest folded into its parent until at most ``most`` are left.

    Each fold changes the next choice, so this runs over the areas of one report, which are folders of one change.
    """
    areas = dict(areas)
    while len(areas) > most:
        deepest = max(d.count("/") for d in areas)
        name = min((d for d in areas if d.count("/") == deepest), key=lambda d: (areas[d], d))
        parent = name.rsplit("/", 1)[0] if "/" in name else "."
        if parent == name:
            break
        areas[parent] = areas.get(parent, 0) + areas.pop(name)
    return areas


def area_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target: folders that depend on each other by a walk edge, each pair once."""
    s = nodes.select(F.col("id").alias("source"), parent_dir("path").alias("a"))
    t = nodes.select(F.col("id").alias("target"), parent_dir("path").alias("b"))
    return edges.join(s, "source").join(t, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def parse_depth(text: str | None) -> int | None:
    """Depth of a walk: null or empty 1, ``all``, ``full`` and ``max`` without bound (None), numbers rounded down, at least 1."""
    if text is None or not text.strip():
        return 1
    if text.strip().lower() in ("all", "full", "max"):
        return None
    try:
        return max(1, int(float(text)))
    except (ValueError, OverflowError):
        raise ValueError(f"depth must be a number or all: {text}") from None


# Phrases that ask for callers and for callees; letter case counts. A qualified name is one word here, too.
_INCOMING = re.compile(r"(?a:\b)(?:caller|callers|calls?\s+into|who\s+calls|what\s+calls|called\s+by|used\s+by|uses)(?a:\b)")
_OUTGOING = re.compile(r"(?a:\b)(?:callee|callees|what\s+does\s+(?a:[\w.])+\s+call|calls\s+what|imports?|depends\s+on)(?a:\b)")


def structural_intent(query: str) -> tuple[str, list[str]] | None:
    """(``in`` or ``out``, words that may be the subject, the longest first) of a question about callers or callees; None for others."""
    direction = "out" if _OUTGOING.search(query) else "in" if _INCOMING.search(query) else None
    if direction is None:
        return None
    asked = set("who what which does do calls call uses use references reference invokes invoke imports import extends extend implements implement callers caller callees callee of usages usage dependencies the a an function method class".split())
    words = [w for w in re.findall(r"[A-Za-z_$][\w$.#/-]*", query) if w.lower() not in asked]
    return direction, sorted(dict.fromkeys(w.rstrip(".") for w in words), key=len, reverse=True)


def annotate_rows(grep_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """row_id, path, line, id: plain ``path:line:text`` rows with their innermost span; rows of another form pass with nulls."""
    from loamgraph.operators.spans import innermost

    path, line = F.nullif(F.regexp_extract("row", r"^([^:\n]+):(\d+):", 1), F.lit("")), F.regexp_extract("row", r"^([^:\n]+):(\d+):", 2).try_cast("int")
    rows = grep_rows.select("row_id", path.alias("path"), line.alias("line"))
    placed = innermost(rows.where("line is not null").select("path", "line").distinct(), spans)
    return rows.join(placed, ["path", "line"], "left").select("row_id", "path", "line", "id")


def read_decision(files: DataFrame, cards: DataFrame) -> DataFrame:
    """path, outlined: whether the outline of a file stands in for reading it: file from 16,384 bytes, outline from 64 and at most half."""
    raw, card = F.octet_length("content"), F.octet_length(F.coalesce("card", F.lit("")))
    return files.where("content is not null").join(cards, "path", "left").select("path", ((raw >= 16_384) & (card >= 64) & (2 * card <= raw)).alias("outlined"))


def plan_id(text: str) -> str:
    """Eight hexadecimal digits that name a plan."""
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:8]


def word_index(lines: DataFrame) -> DataFrame:
    """path, word, n_lines: in how many lines of a file a word stands."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0))
    return lines.select("path", F.explode(words).alias("word")).groupBy("path", "word").agg(F.count("*").alias("n_lines"))
