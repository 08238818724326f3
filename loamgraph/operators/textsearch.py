"""Ranked retrieval over the code graph: BM25, personalised PageRank, coverage and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loamgraph.functions.text import TEST_PATH_ASK, WANTS_TESTS, query_terms, tokens
from loamgraph.operators import products
from loamgraph.session import materialize, ship

# Weights and thresholds of the ranking.
K1, B = 1.2, 0.75
ALPHA, ROUNDS = 0.25, 25
GRAPH_WEIGHT, RESCUE_FLOOR, TEST_PENALTY, PARTICIPATION = 0.5, 0.15, 0.35, 0.25
RRF = 60


def document_frequency(terms: DataFrame) -> DataFrame:
    """term, df: documents that hold the term in any field."""
    return terms.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, terms: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: n_docs, avg_body_len (tokens of the body over all documents, 0 without documents)."""
    total = terms.where("field = 'body'").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("body"))
    return docs.agg(F.count(id_col).alias("n_docs")).join(total).select("n_docs", F.when(F.col("n_docs") > 0, F.col("body") / F.col("n_docs")).otherwise(F.lit(0.0)).alias("avg_body_len"))


def inverse_frequency(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + n / (1 + df))."""
    return document_frequency(terms).join(F.broadcast(stats)).select("term", "df", F.log(1 + F.col("n_docs") / (1 + F.col("df"))).alias("idf"))


def lexical_scores(docs: DataFrame, terms: DataFrame, query: str, *, path_col: str = "path") -> DataFrame:
    """id, name_score, path_score, body_score, lexical of every document with a positive total.

    Name terms weigh 3, path terms 2, both tf times idf; the body counts by BM25 with its length in tokens, where an
    average of 0 counts as 1. Test and script paths are held back unless the query asks for them. Only the postings of the
    query's terms are aggregated; the terms are literals of the plan.
    """
    words = query_terms(query)
    hit = F.col("term").isin(words) if words else F.lit(False)
    stats = corpus_stats(docs, terms)
    idf = inverse_frequency(terms.where(hit), stats)
    lengths = terms.where("field = 'body'").groupBy("id").agg(F.sum("tf").alias("dl"))
    postings = terms.where(hit).join(F.broadcast(idf.select("term", "idf")), "term").join(F.broadcast(stats))  # as many rows as the query has terms
    postings = postings.join(lengths, "id", "left")
    norm = F.when(F.col("avg_body_len") > 0, F.coalesce("dl", F.lit(0)) / F.col("avg_body_len")).otherwise(F.lit(1.0))
    bm25 = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * norm)))
    part = lambda f, v: F.coalesce(F.sum(F.when(F.col("field") == f, v)), F.lit(0.0))
    sums = postings.groupBy("id").agg(part("name", F.col("tf") * F.col("idf")).alias("n"), part("path", F.col("tf") * F.col("idf")).alias("p"), part("body", bm25).alias("b"))
    scored = sums.join(docs.select("id", F.col(path_col).alias("_path")), "id")
    factor = rank_factor("_path", query)
    total = (3 * F.col("n") + 2 * F.col("p") + F.col("b")) * factor
    return scored.select("id", (3 * F.col("n")).alias("name_score"), (2 * F.col("p")).alias("path_score"), F.col("b").alias("body_score"), total.alias("lexical")).where("lexical > 0")


def _times(bag: Column, word: str) -> Column:
    return F.size(F.filter(bag, lambda t: t == word))


def lexical_scan(docs: DataFrame, query: str) -> DataFrame:
    """The scores of :func:`lexical_scores` straight from the texts (id, name, path, body_text), without an index.

    One pass tokenises each text and counts the query's terms in it, so no posting is ever shuffled; the counts, a few numbers a
    document, give the corpus statistics (one row) and the scores of the documents that hold a term.
    """
    words = query_terms(query)
    if not words:
        return docs.select("id", *[F.lit(0.0).alias(c) for c in ("name_score", "path_score", "body_score", "lexical")]).where("false")
    fields = {"n": "name", "p": "path", "b": "body_text"}
    bags = docs.select("id", F.col("path").alias("_path"), *[F.coalesce(tokens(c), F.array().cast("array<string>")).alias(f) for f, c in fields.items()])
    times = [_times(F.col(f), w).alias(f"{f}{k}") for k, w in enumerate(words) for f in fields]
    # written once: it is small, and a filter on the counts would else tokenise the texts again for each term
    counted = materialize(bags.select("id", "_path", F.size("b").alias("dl"), *times), "term-counts")
    has = [(F.col(f"n{k}") + F.col(f"p{k}") + F.col(f"b{k}")) > 0 for k in range(len(words))]
    stats = counted.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("body"), *[F.count_if(h).alias(f"df{k}") for k, h in enumerate(has)])
    rows = counted.where(reduce(Column.__or__, has)).join(F.broadcast(stats))
    norm = F.when(F.col("body") > 0, F.col("dl") / (F.col("body") / F.col("n_docs"))).otherwise(F.lit(1.0))
    idf = [F.log(1 + F.col("n_docs") / (1 + F.col(f"df{k}"))) for k in range(len(words))]
    add = lambda parts: reduce(Column.__add__, parts)
    name, path = (add([F.col(f"{f}{k}") * i for k, i in enumerate(idf)]) for f in "np")
    body = add([i * (F.col(f"b{k}") * (K1 + 1) / (F.col(f"b{k}") + K1 * (1 - B + B * norm))) for k, i in enumerate(idf)])
    scored = rows.select("id", (3 * name).alias("name_score"), (2 * path).alias("path_score"), body.alias("body_score"), rank_factor("_path", query).alias("_f"))
    return scored.select("id", "name_score", "path_score", "body_score", ((F.col("name_score") + F.col("path_score") + F.col("body_score")) * F.col("_f")).alias("lexical")).where("lexical > 0")


def rank_factor(path: str, query: str):
    """1, or the penalty of a test path or a scripts folder that the query does not ask for."""
    import re

    words = {w.lower() for w in re.split(r"[^A-Za-z0-9]+", query) if w}
    tests = F.lit(False) if re.search(WANTS_TESTS, query) else F.col(path).rlike(TEST_PATH_ASK)
    scripts = F.lit(False) if words & {"script", "scripts"} else F.col(path).rlike(r"(^|/)scripts/")
    return F.when(tests | scripts, F.lit(TEST_PENALTY)).otherwise(F.lit(1.0))


LOCAL_LINKS = 2_000_000  # a graph of at most so many distinct links is walked by one task (some 100 MB)


def _walk_in_one_task(adjacency: DataFrame, restart: DataFrame, rounds: int, alpha: float, g: list[str]) -> DataFrame:
    """The same walk over a graph whose size was checked: one task per group holds its links in arrays."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        link = pdf["target"].notna().to_numpy()
        codes, ids = pd.factorize(pd.concat([pdf["id"], pdf["target"][link]], ignore_index=True))
        own, to = codes[: len(pdf)], codes[len(pdf) :]
        source, share, n = own[link], pdf["share"].to_numpy()[link], len(ids)
        r = np.bincount(own[~link], weights=pdf["share"].to_numpy()[~link], minlength=n)
        idle = np.ones(n, dtype=bool)
        idle[source] = False
        mass = r
        for _ in range(rounds):
            mass = r * (alpha + (1 - alpha) * mass[idle].sum()) + (1 - alpha) * np.bincount(to, weights=mass[source] * share, minlength=n)
        out = pd.DataFrame({"id": ids, "rank": mass / mass.max() if mass.max() > 0 else mass})
        for c in g:
            out.insert(0, c, pdf[c].iloc[0])
        return out[out["rank"] > 0][[*g, "id", "rank"]]

    rows = adjacency.select(*g, "id", "target", "share").unionByName(restart.select(*g, "id", F.lit(None).cast("string").alias("target"), F.col("r").alias("share")))
    types = ", ".join(f"{c} {adjacency.schema[c].dataType.simpleString()}" for c in g)
    return rows.groupBy(*g).applyInPandas(run, f"{types}{', ' if g else ''}id string, rank double")


def pagerank(nodes: DataFrame, walk: DataFrame, seeds: DataFrame, *, rounds: int = ROUNDS, alpha: float = ALPHA, group: list[str] | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """id, rank in (0, 1]: personalised PageRank over the undirected multigraph of the walk edges, exactly ``rounds`` rounds.

    ``seeds`` has id and weight. Mass at nodes without neighbours returns to the seeds. The adjacency is built once, hash-partitioned by
    source and cached on disk and memory; each round joins it with the ranks on the same partitioning and adds up per target
    with map-side combining. Lineage is cut by writing the ranks to the shared folder every five rounds. ``group`` columns make independent
    walks, one per scope, in the same jobs. No positive seed gives no rows. The links are counted first: a graph of at most
    ``local_links`` is walked by one task per group, a larger one by joins; both give the same ranks.
    """
    g = group or []
    ids = nodes.select(*g, "id").distinct()
    pairs = walk.select("source", "target").unionByName(walk.select(F.col("target").alias("source"), F.col("source").alias("target")))
    inside = pairs.join(ids.withColumnRenamed("id", "source"), "source").join(ids.withColumnRenamed("id", "target"), [*g, "target"])
    links = inside.groupBy(*g, "source", "target").agg(F.count("*").alias("w"))  # parallel edges count, once as a row
    degree = links.groupBy(*g, "source").agg(F.sum("w").alias("degree"))
    adjacency = links.join(degree, [*g, "source"]).select(*g, F.col("source").alias("id"), "target", (F.col("w") / F.col("degree")).alias("share"))
    adjacency = adjacency.repartition(*g, "id").persist(StorageLevel.MEMORY_AND_DISK)
    start = seeds.where("weight > 0").join(ids, [*g, "id"], "left_semi")
    total = start.groupBy(*g).agg(F.sum("weight").alias("_t"))
    restart = (start.join(total, g) if g else start.join(F.broadcast(total))).select(*g, "id", (F.col("weight") / F.col("_t")).alias("r")).persist(StorageLevel.MEMORY_AND_DISK)
    if adjacency.count() <= local_links:
        ship(nodes.sparkSession)
        walked = materialize(_walk_in_one_task(adjacency, restart, rounds, alpha, g), "ranks")
        adjacency.unpersist()
        restart.unpersist()
        return walked
    # A node without neighbours gets mass from the restart alone, so what returns from all of them in a round is a number that
    # follows from their share of the seeds: lost(k + 1) = share * (alpha + (1 - alpha) * lost(k)), lost(0) = share.
    idle = restart.join(adjacency.select(*g, "id").distinct(), [*g, "id"], "left_anti").groupBy(*g).agg(F.sum("r").alias("idle"))
    base = (restart.join(idle, g, "left") if g else restart.join(F.broadcast(idle))).select(*g, "id", "r", F.coalesce("idle", F.lit(0.0)).alias("idle")).persist(StorageLevel.MEMORY_AND_DISK)
    ranks, lost = base.select(*g, "id", F.col("r").alias("mass")), F.col("idle")
    for k in range(rounds):
        flow = ranks.join(adjacency, [*g, "id"]).select(*g, F.col("target").alias("id"), ((1 - alpha) * F.col("mass") * F.col("share")).alias("m"))
        back = base.select(*g, "id", (F.col("r") * (alpha + (1 - alpha) * lost)).alias("m"))
        ranks = flow.unionByName(back).groupBy(*g, "id").agg(F.sum("m").alias("mass"))
        lost = F.col("idle") * (alpha + (1 - alpha) * lost)
        if k % 5 == 4 or k == rounds - 1:
            ranks = materialize(ranks, "ranks")
    base.unpersist()
    adjacency.unpersist()
    restart.unpersist()
    top = ranks.groupBy(*g).agg(F.max("mass").alias("_m"))
    scaled = ranks.join(top, g) if g else ranks.join(F.broadcast(top))
    return scaled.where("mass > 0 and _m > 0").select(*g, "id", (F.col("mass") / F.col("_m")).alias("rank"))


def candidates(nodes: DataFrame, lexical: DataFrame, ranks: DataFrame, query: str) -> DataFrame:
    """id, raw_lexical, lexical (over the maximum), graph, baseline: lexical hits and nodes that the graph rescues."""
    both = lexical.select("id", F.col("lexical").alias("raw")).join(ranks.select("id", F.col("rank").alias("graph")), "id", "full_outer")
    both = both.where((F.col("raw").isNotNull()) | (F.col("graph") >= RESCUE_FLOOR))
    top = lexical.agg(F.max("lexical").alias("_top"))
    rows = both.join(nodes.select("id", "path", "name", "kind", "start_line"), "id").join(F.broadcast(top))
    raw, graph = F.coalesce("raw", F.lit(0.0)), F.coalesce("graph", F.lit(0.0))
    rows = rows.select("id", "path", "name", "kind", "start_line", raw.alias("raw_lexical"), F.when(F.col("_top") > 0, raw / F.col("_top")).otherwise(F.lit(0.0)).alias("lexical"), graph.alias("graph"))
    return rows.withColumn("baseline", (F.col("lexical") + GRAPH_WEIGHT * F.col("graph")) * rank_factor("path", query)).where("baseline > 0")


def coverage(terms: DataFrame, docs: DataFrame, query: str, idf: DataFrame, stats: DataFrame) -> DataFrame:
    """id, coverage, strong: idf share of the query's terms found in any field, and in the name of a symbol; a plural s folds either way."""
    spark = terms.sparkSession
    words = query_terms(query)
    forms = [(w, f) for w in words for f in dict.fromkeys([w, w + "s", *([w[:-1]] if w.endswith("s") else [])])]
    wanted = spark.createDataFrame(forms, "word string, term string") if forms else spark.createDataFrame([], "word string, term string")
    weights = wanted.select("word").distinct().join(idf.select(F.col("term").alias("word"), "idf"), "word", "left").join(F.broadcast(stats)).select("word", F.coalesce("idf", F.log(1 + F.col("n_docs"))).alias("w"))
    total = weights.agg(F.sum("w").alias("_total"))
    found = terms.join(F.broadcast(wanted), "term").join(docs.select("id", "kind"), "id")
    found = found.groupBy("id", "word").agg(F.max(((F.col("field") == "name") & (F.col("kind") != "file")).cast("int")).alias("in_name"))
    sums = found.join(F.broadcast(weights), "word").groupBy("id").agg(F.sum("w").alias("any_w"), F.sum(F.col("w") * F.col("in_name")).alias("name_w"))
    return sums.join(F.broadcast(total)).select("id", (F.col("any_w") / F.col("_total")).alias("coverage"), (F.col("name_w") / F.col("_total")).alias("strong"))


def reciprocal_rank(scored: DataFrame, scope: str, score: str, tie: str) -> DataFrame:
    """id, scope, rrf in (0, 1]: 1 / (60 + rank) in each scope, over the maximum."""
    w = Window.partitionBy(scope).orderBy(F.desc(score), tie)
    each = scored.select(tie, scope, (1 / (60 + F.row_number().over(w))).alias("rrf"))
    best = each.agg(F.max("rrf").alias("_b"))
    return each.join(F.broadcast(best)).select(tie, scope, (F.col("rrf") / F.col("_b")).alias("rrf"))


def participating(scored: DataFrame, scope: str, score: str, ratio: float = PARTICIPATION) -> DataFrame:
    """Rows of the scopes whose best score reaches the ratio of the best of all."""
    best = scored.groupBy(scope).agg(F.max(score).alias("_s"))
    every = scored.agg(F.max(score).alias("_a"))
    kept = best.join(F.broadcast(every)).where(F.col("_s") >= ratio * F.col("_a")).select(scope)
    return scored.join(kept, scope, "left_semi")


def interleave(ranked: DataFrame, queue: str, order: list) -> DataFrame:
    """Adds ``depth``, the position in its queue from 1: sorted by depth and queue, all leaders come first, then all seconds."""
    return ranked.withColumn("depth", F.row_number().over(Window.partitionBy(queue).orderBy(*order)))


def topic_links(records: DataFrame, files: DataFrame, *, known: DataFrame | None = None, top: int = 50, z_min: float = 4.5, per_file: int = 2) -> DataFrame:
    """file, record, score, z: records whose BM25 weight over a file's characteristic terms stands out; z to six decimals.

    ``records`` and ``files`` are term bags (id, term, tf). Record terms weigh by BM25 with idf ln(1 + (n - df + .5) / (df + .5));
    of a file the ``top`` terms by (1 + ln tf) ln(nf / df) select, and only select. Scores are standardised over the records a file
    meets; too few of them cannot reach ``z_min`` and are left out. ``known`` (file, record) are exact links: they count in the mean
    and deviation, but take none of a file's ``per_file`` rows.
    """
    files = materialize(files.select("id", "term", "tf"), "file-terms")  # read for the frequencies and the choice of terms
    nf = files.agg(F.count_distinct("id").alias("nf"))
    fdf = files.groupBy("term").agg(F.count("*").alias("fdf"))
    f = files.join(fdf, "term").join(F.broadcast(nf)).withColumn("fw", (1 + F.log("tf")) * F.log(F.col("nf") / F.col("fdf")))
    best = Window.partitionBy("id").orderBy(F.desc("fw"), "term")
    f = f.where("fw > 0 and id is not null").withColumn("k", F.row_number().over(best)).where(F.col("k") <= top)
    f = f.groupBy(F.col("id").alias("file")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    if known is None:
        f = f.withColumn("known", F.array().cast(ArrayType(records.schema["id"].dataType)))
    else:
        f = f.join(known.groupBy("file").agg(F.collect_list("record").alias("known")), "file", "left")
    f = materialize(f, "file-choice")  # read for the terms that are chosen at all and for the scores

    lengths = Window.partitionBy("id")
    records = materialize(records.select("id", "term", "tf", F.sum("tf").over(lengths).alias("dl")), "record-terms")
    n = records.agg(F.count_distinct("id").alias("n"), F.sum("tf").alias("all_tf"))
    df = records.groupBy("term").agg(F.count("*").alias("df")).join(f.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    r = records.join(df, "term").join(F.broadcast(n))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("all_tf") / F.col("n"))))
    posts = products.write_postings(r.select(F.col("id").alias("key"), "term", weight.alias("w")), "record-weights")
    return products.outstanding(f, posts, records.schema["id"].dataType, z_min=z_min, per_file=per_file)


# Fields of a linked document and their weights.
BM25F_WEIGHTS = {"name": 3.0, "path": 2.0, "head": 1.0, "body": 0.5}


def text_queries(bags: DataFrame, idf: DataFrame) -> DataFrame:
    """id, term, qw: texts as queries. ``bags`` has id, field (``body``, ``head``), term, tf of the texts, ``idf`` the idf of each term of the documents.

    A term counts as often as the text holds it, and twice more if the heading does; c of them weigh (1 + ln c) idf. Terms that
    no document holds are left out.
    """
    times = F.sum(F.when(F.col("field") == "head", F.lit(2)).otherwise(F.col("tf")))
    counts = bags.groupBy("id", "term").agg(times.alias("c"))
    return counts.join(idf, "term").select("id", "term", ((1 + F.log("c")) * F.col("idf")).alias("qw"))


def text_links(bags: DataFrame, docs: DataFrame) -> DataFrame:
    """query, id, score to six decimals: :func:`bm25f` of :func:`text_queries`, for as many texts as there are.

    ``docs`` has id, field, term, tf; they are gathered by id once, and their scores are added up where they lie.
    """
    packed = docs.groupBy("id").agg(F.collect_list(F.struct("field", "term", "tf")).alias("bag"))
    packed = materialize(packed, "bags")  # read for the weights and for the scores
    idf = packed.select(F.explode(F.array_distinct("bag.term")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = idf.join(F.broadcast(packed.agg(F.count("*").alias("n")))).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = materialize(idf, "idf")  # read for the weights of the texts and for those of the documents
    queries = text_queries(bags, idf).join(idf, "term").select(F.col("id").alias("key"), "term", (F.col("qw") * F.col("idf")).alias("w"))
    posts = products.write_postings(queries, "text-weights")
    lengths = packed.select(F.explode("bag").alias("e")).groupBy("e.field").agg(F.sum("e.tf").alias("len"))
    held = packed.select(F.explode(F.array_distinct("bag.field")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    mean = {r["field"]: r["mean"] for r in lengths.join(held, "field").select("field", (F.col("len") / F.col("n")).alias("mean")).collect()}  # a row for each field
    return products.all_scores(packed, posts, bags.schema["id"].dataType, field_weights=BM25F_WEIGHTS, mean_length=mean, k1=K1, b=B).withColumnRenamed("key", "query")


def bm25f(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query, id, score: BM25F of term bags. ``queries`` has id, term, qw; ``docs`` id, field, term, tf.

    Each field has its own weight and length norm; the weighted frequencies of a term add up before they saturate.
    """
    n = docs.agg(F.count_distinct("id").alias("n"))
    lens = docs.groupBy("id", "field").agg(F.sum("tf").alias("len"))
    avg = lens.groupBy("field").agg(F.avg("len").alias("avg"))
    w = F.create_map(*[F.lit(x) for pair in BM25F_WEIGHTS.items() for x in pair])
    norm = F.try_element_at(w, F.col("field")) * F.col("tf") / (1 - B + B * F.col("len") / F.col("avg"))
    each = docs.join(lens, ["id", "field"]).join(F.broadcast(avg), "field").groupBy("id", "term").agg(F.sum(norm).alias("x"))
    df = docs.groupBy("term").agg(F.count_distinct("id").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = each.join(df, "term").join(F.broadcast(n)).select("id", "term", (idf * F.col("x") / (K1 + F.col("x"))).alias("s"))
    q = queries.select(F.col("id").alias("query"), "term", "qw")
    return q.join(weighted, "term").groupBy("query", "id").agg(F.sum(F.col("qw") * F.col("s")).alias("score"))


def federated(scored: DataFrame, limit: int = 8) -> DataFrame:
    """position, child, id, path, file_rank, share: the answer of a workspace from the scores of its members (child, id, path, score), a top-k report.

    Members whose best hit has at least a quarter of the best of all take part. Their files are ranked by their best hit, member by member, and fused by
    reciprocal rank (``share`` of the best); the best hit of all comes first, then the files take turns. Only the first
    ``limit`` files of a member and hits of a file can be shown, so no member is ranked as a whole.
    """
    best = F.broadcast(scored.agg(F.max("score").alias("_top")))
    files = scored.groupBy("child", "path").agg(F.max("score").alias("file_score"))
    taking = files.groupBy("child").agg(F.max("file_score").alias("_best")).join(best).where(F.col("_best") >= PARTICIPATION * F.col("_top")).select("child")
    order = Window.partitionBy("child").orderBy(F.desc("file_score"), "path")
    ranked = files.join(taking, "child", "left_semi").withColumn("file_rank", F.row_number().over(order)).where(F.col("file_rank") <= limit)
    turn = Window.partitionBy("child", "path").orderBy(F.desc("score"), "id")
    hits = scored.join(ranked, ["child", "path"]).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit)
    first = F.broadcast(scored.agg(F.max_by(F.struct("child", "id"), F.struct("score", F.col("id"))).alias("_first")))
    locked = (F.col("child") == F.col("_first.child")) & (F.col("id") == F.col("_first.id"))
    shown = hits.join(first).withColumn("_locked", locked).orderBy(F.desc("_locked"), "turn", "file_rank", F.desc("file_score"), "child", "path").limit(limit)
    place = Window.orderBy(F.desc("_locked"), "turn", "file_rank", F.desc("file_score"), "child", "path")  # over ``limit`` rows
    return shown.select(F.row_number().over(place).alias("position"), "child", "id", "path", "file_rank", (F.lit(RRF + 1.0) / (RRF + F.col("file_rank"))).alias("share"))
