"""Operators on the symbol graph: degrees, callers, reach, impact, maps and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import dir_key, parent_dir, strip_ordinals, under
from loamgraph.session import materialize


def in_degree(walk: DataFrame) -> DataFrame:
    """target, in_degree: walk edges per target; self loops and dangling targets count, nothing is deduplicated."""
    return walk.groupBy("target").agg(F.count("*").alias("in_degree"))


def distinct_incoming(edges: DataFrame) -> DataFrame:
    """target, n_incoming: distinct (source, relation) over the four relations that call for a symbol."""
    four = edges.where(F.col("relation").isin("calls", "references", "implements", "extends"))
    return four.select("target", "source", "relation").distinct().groupBy("target").agg(F.count("*").alias("n_incoming"))


def callers(edges: DataFrame, nodes: DataFrame, *, incoming: bool = True) -> DataFrame:
    """of, other, name, relation, ord: every walk edge at a symbol with the node at its other end; a dangling end keeps its key as name."""
    of, other = ("target", "source") if incoming else ("source", "target")
    rows = edges.select(F.col(of).alias("of"), F.col(other).alias("other"), "relation", "ord")
    return rows.join(nodes.select(F.col("id").alias("other"), "name"), "other", "left").select("of", "other", F.coalesce("name", "other").alias("name"), "relation", "ord")


def resolve_symbol(nodes: DataFrame, query: str, prefix: str = "") -> DataFrame:
    """id, tier of the nodes a query names: symbols by exact name or id suffix, only then files by name or path, only then symbols by the last
    segment of a dotted name; the prefix filters what was found."""
    q = query.lower()
    symbol = F.col("kind") != "file"
    name, node_id, path = F.lower("name"), F.lower(strip_ordinals("id")), F.lower("path")
    exact = symbol & ((name == q) | node_id.endswith("#" + q) | node_id.endswith("." + q))
    as_file = ~symbol & ((name == q) | (path == q) | path.endswith("/" + q)) if "." in q and "#" not in q else F.lit(False)
    last = q.rsplit(".", 1)[-1] if "." in q and "/" not in q else ""
    dotted = symbol & (name == last) if last else F.lit(False)
    rows = nodes.select("id", "path", F.when(exact, 1).when(as_file, 2).when(dotted, 3).alias("tier")).where("tier is not null")
    best = rows.agg(F.min("tier").alias("_t"))
    return rows.join(F.broadcast(best), F.col("tier") == F.col("_t")).where(under("path", prefix)).select("id", "tier")


def reach(edges: DataFrame, seeds: DataFrame, *, incoming: bool = True, depth: int | None = None) -> DataFrame:
    """origin, id, depth, parent: breadth-first reach of many origins at once.

    ``seeds`` has origin and id. Nodes carry the depth they were first reached at and one parent, the first in edge order among
    those of the frontier; seeds themselves are left out. The steps of the graph are written once, spread by both ends, so a node with a third of
    all edges is no hot partition: a small frontier is sent to them, a large one meets them in a shuffle whose hot keys AQE splits. Each
    round drops what the origin has already seen; it ends when nothing is new or at ``depth``. Frontiers are written to the
    shared folder, so lineage stays short; only whether there are new rows goes to the driver.
    """
    near, far = ("target", "source") if incoming else ("source", "target")
    steps = edges.select(F.col(near).alias("id"), F.col(far).alias("next"), "ord").groupBy("id", "next").agg(F.min("ord").alias("ord"))
    steps = materialize(steps, "steps")
    frontier = seeds.select("origin", "id").distinct().withColumn("pos", F.lit(0).cast("bigint"))
    seen, out, k = frontier.select("origin", "id"), None, 0
    while depth is None or k < depth:
        k += 1
        fresh = frontier.join(steps, "id").select("origin", F.col("next"), F.struct("pos", "ord").alias("at"), F.col("id").alias("parent"))
        fresh = fresh.groupBy("origin", "next").agg(F.min_by("parent", F.struct("at", "parent")).alias("parent"), F.min("at").alias("at")).withColumnRenamed("next", "id")
        fresh = materialize(fresh.join(seen, ["origin", "id"], "left_anti"), "reach")
        if fresh.isEmpty():
            break
        out_k = fresh.select("origin", "id", F.lit(k).alias("depth"), "parent")
        out = out_k if out is None else out.unionByName(out_k)
        seen = seen.unionByName(fresh.select("origin", "id"))
        frontier = fresh.select("origin", "id", F.col("at.ord").alias("pos"))
    if out is None:
        return seeds.sparkSession.createDataFrame([], f"origin {seeds.schema['origin'].dataType.simpleString()}, id string, depth int, parent string")
    return out


def impact(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, path, depth, n_origins: what a change reaches, with the least depth and from how many origins; the rows of ``reached`` name them."""
    merged = reached.groupBy("id").agg(F.min("depth").alias("depth"), F.count_distinct("origin").alias("n_origins"))
    return merged.join(nodes.select("id", "path"), "id").select("id", "path", "depth", "n_origins")


def directory_rollup(nodes: DataFrame, *, share: float = 0.6) -> DataFrame:
    """dir, n_files, n_symbols: per folder; a top folder with more than ``share`` of all files is split one level deeper."""
    files = nodes.where("kind = 'file'").select("path")
    top = files.groupBy(dir_key("path", 1).alias("d1")).agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("_all"))
    large = top.join(F.broadcast(total)).where(F.col("n") > share * F.col("_all")).select("d1", F.lit(True).alias("split"))
    rows = nodes.select("path", "kind", dir_key("path", 1).alias("d1")).join(large, "d1", "left")
    rows = rows.withColumn("dir", F.when(F.col("split"), dir_key("path", 2)).otherwise(F.col("d1")))
    return rows.groupBy("dir").agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if(F.col("kind") != "file").alias("n_symbols"))


def hubs(nodes: DataFrame, degrees: DataFrame, *, depth: int = 2, top: int = 3) -> DataFrame:
    """dir, rank, id, in_degree: the symbols of each folder that most edges point at; without edges there is no hub."""
    rows = nodes.where("kind <> 'file'").join(degrees.withColumnRenamed("target", "id"), "id").withColumn("dir", dir_key("path", depth))
    w = Window.partitionBy("dir").orderBy(F.desc("in_degree"), "name", "path", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("dir", "rank", "id", "in_degree")


def outline(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """path, start_line, end_line, name, kind, in_degree: the definitions of every file, in file order within a path."""
    rows = nodes.where("kind <> 'file'").join(degrees.withColumnRenamed("target", "id"), "id", "left")
    return rows.select("path", "start_line", "end_line", "id", "name", "kind", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def cross_file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node of another file than the source's, or whose source is no node."""
    s = nodes.select(F.col("id").alias("source"), F.col("path").alias("s_path"))
    t = nodes.select(F.col("id").alias("target"), F.col("path").alias("t_path"))
    return edges.join(t, "target").join(s, "source", "left").where(F.coalesce(F.col("s_path") != F.col("t_path"), F.lit(True)))


def file_view(edges: DataFrame, nodes: DataFrame, *, top: int = 8) -> DataFrame:
    """path, n_nodes, in_total, top_edges: the materialised view of a file, with its first cross-file in-edges in (source, relation, target) order."""
    per = nodes.groupBy("path").agg(F.count("*").alias("n_nodes"))
    cross = cross_file_edges(edges, nodes).select(F.col("t_path").alias("path"), "source", "relation", "target", "edge_id")
    w = Window.partitionBy("path").orderBy("source", "relation", "target", "edge_id")
    ranked = cross.withColumn("k", F.row_number().over(w))
    # the total is counted apart, so the window keeps the few first rows only
    first = ranked.where(F.col("k") <= top).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "source", "relation", "target"))), lambda e: F.concat_ws(" ", e["source"], e["relation"], e["target"])), "; ").alias("top_edges"))
    total = cross.groupBy("path").agg(F.count("*").alias("in_total"))
    return per.join(total, "path", "left").join(first, "path", "left").select("path", "n_nodes", F.coalesce("in_total", F.lit(0)).alias("in_total"), F.coalesce("top_edges", F.lit("")).alias("top_edges"))


def module_groups(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """dir, n_nodes, n_files, n_origins, min_depth: what a change reaches, by folder."""
    each = reached.join(nodes.select("id", "path"), "id").select(parent_dir("path").alias("dir"), "id", "path", "depth", "origin")
    return each.groupBy("dir").agg(F.count_distinct("id").alias("n_nodes"), F.count_distinct("path").alias("n_files"), F.count_distinct("origin").alias("n_origins"), F.min("depth").alias("min_depth"))
