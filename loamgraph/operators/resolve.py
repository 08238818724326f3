"""Name resolution as set operations: candidates, counts, and what is left when exactly one fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import dir_prefixes, family, path_suffixes
from loamgraph.session import materialize


def resolve_names(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, target, confidence: a name resolves to the one symbol of its file (``extracted``), else to the one symbol of that name anywhere
    in its language family (``inferred``); ambiguity in the file, or anywhere, drops it.

    ``raw`` has ref_id, path, name; ``symbols`` id, path, name.
    """
    s = symbols.select("id", "path", "name").distinct()
    local = s.groupBy("path", "name").agg(F.count("*").alias("l_n"), F.min("id").alias("l_id"))
    world = s.groupBy("name", family("path").alias("f")).agg(F.count("*").alias("w_n"), F.min("id").alias("w_id"))
    any_family = s.groupBy("name").agg(F.count("*").alias("a_n"), F.min("id").alias("a_id"))
    rows = raw.select("ref_id", "path", "name", family("path").alias("f")).join(local, ["path", "name"], "left")
    rows = rows.join(world, ["name", "f"], "left").join(any_family, "name", "left")
    local_hit = F.col("l_n") == 1
    free = F.col("l_n").isNull()
    target = F.when(local_hit, F.col("l_id")).when(free & F.col("f").isNotNull() & (F.col("w_n") == 1), F.col("w_id")).when(free & F.col("f").isNull() & (F.col("a_n") == 1), F.col("a_id"))
    return rows.select("ref_id", target.alias("target"), F.when(local_hit, "extracted").otherwise("inferred").alias("confidence")).where("target is not null")


def fits(argc, arity, variadic):
    """Whether a number of arguments fits: an unknown arity always, a variadic from one below its arity, others exactly."""
    return F.when(arity.isNull(), True).when(F.coalesce(variadic, F.lit(False)), argc >= arity - 1).otherwise(argc == arity)


def narrow_by_arity(cands: DataFrame) -> DataFrame:
    """Candidates (call_id, id, argc, arity, variadic) that fit their call, or all of them where none does."""
    ok = fits(F.col("argc"), F.col("arity"), F.col("variadic"))
    n = F.sum(ok.cast("int")).over(Window.partitionBy("call_id"))
    return cands.withColumn("_ok", ok).withColumn("_n", n).where("_ok or _n = 0").select("call_id", "id")


def narrowed_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, n, first_id: how many symbols of a call's name fit its number of arguments, or bear the name where none fits, and the first.

    ``calls`` has call_id, argc, name; ``symbols`` id, name, arity, variadic. Symbols are counted per (name, arity, variadic) and calls per (name, argc)
    before they meet, so a name that very many bear on both sides costs a row per arity and not a row per pair.
    """
    kinds = symbols.groupBy("name", "arity", F.coalesce("variadic", F.lit(False)).alias("variadic")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = calls.select("name", "argc").distinct()
    ok = fits(F.col("argc"), F.col("arity"), F.col("variadic"))
    per = asked.join(kinds, "name").groupBy("name", "argc").agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("fit"), F.min(F.when(ok, F.col("id"))).alias("fit_id"), F.sum("n").alias("all"), F.min("id").alias("all_id")
    )
    n, first = F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("all")), F.coalesce("fit_id", "all_id")
    return calls.join(per.select("name", "argc", n.alias("n"), first.alias("first_id")), ["name", "argc"]).select("call_id", "n", "first_id")


def typed_members(calls: DataFrame, members: DataFrame, parents: DataFrame, depth: int = 3) -> DataFrame:
    """call_id, id, level: the member a typed receiver means, in its class or the nearest parent up to ``depth`` that has any.

    ``calls`` has call_id, type, name; ``members`` owner, name, id; ``parents`` child, parent.
    """
    frontier, levels = calls.select("call_id", "type", "name"), []
    up = parents.select(F.col("child").alias("type"), "parent").distinct()
    for k in range(depth + 1):
        levels.append(frontier.join(members.select(F.col("owner").alias("type"), "name", "id"), ["type", "name"]).select("call_id", "id", F.lit(k).alias("level")))
        frontier = frontier.join(up, "type").select("call_id", F.col("parent").alias("type"), "name").distinct()
    found = reduce(DataFrame.unionByName, levels).distinct()
    best = found.groupBy("call_id").agg(F.min("level").alias("level"))
    return found.join(best, ["call_id", "level"], "left_semi").select("call_id", "id", "level")


# Extensions an import may leave out, in the order they are tried.
PROBE = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json"]


def normal_path(path: str):
    """A joined path with ``.`` and ``..`` resolved; null where it leaves the root."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.when(F.size(acc) == 0, F.array(F.lit(".."))).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(~F.array_contains(fold, ".."), F.array_join(fold, "/"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target, resolved: a relative specifier becomes the first file that exists among the path, the path with a known extension,
    and an index file in it; bare specifiers and misses stay as they are.

    ``imports`` has ref_id, path, spec; ``files`` path.
    """
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rel = imports.where(F.col("spec").startswith("."))
    rel = rel.withColumn("joined", F.concat(folder, F.col("spec"))).withColumn("base", normal_path("joined"))
    bare = F.regexp_replace("base", r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    tries = F.array(F.col("base"), *[F.concat(bare, F.lit(e)) for e in PROBE], *[F.concat(F.col("base"), F.lit("/index" + e)) for e in PROBE])
    cands = rel.where("base is not null").select("ref_id", F.posexplode(tries)).select("ref_id", F.col("pos").alias("ord"), F.col("col").alias("cand"))
    hit = cands.join(files.select(F.col("path").alias("cand")).distinct(), "cand", "left_semi").groupBy("ref_id").agg(F.min_by("cand", "ord").alias("hit"))
    return imports.select("ref_id", "spec").join(hit, "ref_id", "left").select("ref_id", F.coalesce("hit", "spec").alias("target"), F.col("hit").isNotNull().alias("resolved"))


def resolve_by_suffix(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target: a path tail that exactly one file ends with. ``refs`` has ref_id and tail."""
    tails = files.select("path").distinct().select("path", F.explode(path_suffixes("path")).alias("tail"))
    wanted = refs.select("tail").distinct()
    unique = tails.join(wanted, "tail", "left_semi").groupBy("tail").agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1")
    return refs.join(unique, "tail").select("ref_id", "target")


def resolve_by_prefix(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """ref_id, root: the longest root that is the path or a folder above it. ``refs`` has ref_id and path; ``roots`` root.

    The path's own prefixes are joined by equality, so no pair of path and root is tried that does not match.
    """
    each = refs.select("ref_id", F.explode(F.concat(dir_prefixes("path"), F.array("path"))).alias("root"))
    return each.join(roots.select("root").distinct(), "root").groupBy("ref_id").agg(F.max_by("root", F.length("root")).alias("root"))


def keep_first(edges: DataFrame) -> DataFrame:
    """Edges once per (source, relation, target), the first in order."""
    w = Window.partitionBy("source", "relation", "target").orderBy("ord", "edge_id")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_exports(wanted: DataFrame, exports: DataFrame, reexports: DataFrame, depth: int = 8) -> DataFrame:
    """ref_id, id, hops: the definition an exported name leads to through re-exporting files, at most ``depth`` of them.

    ``wanted`` has ref_id, path, name; ``exports`` path, name, id (definitions); ``reexports`` path, name (``*`` for all), source, source_name.
    The nearest definition wins; a name that several lead to on the same level is dropped, and so are cycles.
    """
    exports = materialize(exports.select("path", "name", "id").distinct(), "exports")
    reexports = materialize(reexports.select("path", "name", "source", "source_name").distinct(), "reexports")
    frontier = materialize(wanted.select("ref_id", "path", "name"), "wanted")
    seen, hits = frontier, []
    for k in range(depth + 1):
        hits.append(frontier.join(exports.select("path", "name", "id"), ["path", "name"]).select("ref_id", "id", F.lit(k).alias("hops")))
        named = frontier.join(reexports.where("name <> '*'"), ["path", "name"]).select("ref_id", F.col("source").alias("path"), F.col("source_name").alias("name"))
        star = frontier.join(reexports.where("name = '*'").select("path", "source"), "path").select("ref_id", F.col("source").alias("path"), "name")
        frontier = materialize(named.unionByName(star).distinct().join(seen, ["ref_id", "path", "name"], "left_anti"), "exports")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = reduce(DataFrame.unionByName, hits).distinct()
    best = found.groupBy("ref_id").agg(F.min("hops").alias("hops"))
    near = found.join(best, ["ref_id", "hops"], "left_semi")
    return near.groupBy("ref_id").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("hops").alias("hops")).where("n = 1").select("ref_id", "id", "hops")
