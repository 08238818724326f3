"""Scopes of a repository, bindings, imports of single languages, concepts and pages of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import base_name, parent_dir, path_suffixes
from loamgraph.operators.resolve import resolve_by_prefix

# Files that mark a package.
MARKERS = ["package.json", "go.mod", "pyproject.toml", "setup.py", "Cargo.toml", "composer.json", "pom.xml", "build.gradle", "build.gradle.kts"]


def discover_scopes(files: DataFrame, *, depth: int = 2) -> DataFrame:
    """prefix, markers: folders that hold a package marker, at most ``depth`` deep, without those below another one."""
    marked = files.where(base_name("path").isin(MARKERS) & F.col("path").contains("/")).select(parent_dir("path").alias("prefix"), base_name("path").alias("marker"))
    rows = marked.where(F.size(F.split("prefix", "/")) <= depth).groupBy("prefix").agg(F.array_sort(F.collect_set("marker")).alias("markers"))
    above = rows.select("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("prefix", "/"))), lambda n: F.array_join(F.slice(F.split("prefix", "/"), F.lit(1), n), "/"))).alias("up")).where("up <> prefix")
    nested = above.join(rows.select(F.col("prefix").alias("up")), "up", "left_semi").select("prefix").distinct()
    return rows.join(nested, "prefix", "left_anti")


def nearest_bindings(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """use_id, type: the type of a name from the innermost scope of its file that binds it; a scope that binds it to several types proves nothing.

    ``uses`` has use_id, path, name, scopes (open scopes, the outermost first); ``bindings`` path, scope, name, type.
    """
    each = uses.select("use_id", "path", "name", F.posexplode("scopes").alias("depth", "scope"))
    hits = each.join(bindings.select("path", "scope", "name", "type").distinct(), ["path", "scope", "name"])
    per = hits.groupBy("use_id", "depth").agg(F.count("*").alias("n"), F.min("type").alias("type"))
    return per.groupBy("use_id").agg(F.max_by(F.struct("n", "type"), "depth").alias("b")).where("b.n = 1").select("use_id", "b.type")


def go_imports(imports: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target: the first Go file, by path, of the folder an import means in the module with the longest prefix.

    ``imports`` has ref_id and spec; ``modules`` module (import path) and folder.
    """
    root = resolve_by_prefix(imports.select("ref_id", F.col("spec").alias("path")), modules.select(F.col("module").alias("root")))
    rows = imports.join(root, "ref_id").join(modules.select(F.col("module").alias("root"), "folder"), "root")
    rest = F.expr("substring(spec, length(root) + 2)")
    folder = F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.nullif(rest, F.lit("")))
    go = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).groupBy(parent_dir("path").alias("dir")).agg(F.min("path").alias("target"))
    return rows.select("ref_id", F.when(folder == "", F.lit(".")).otherwise(folder).alias("dir")).join(go, "dir").select("ref_id", "target")


def tail_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target: the longest tail of a reference that ends some file; only where at this length one file ends so.

    ``refs`` has ref_id and tail, a path such as ``a/b/C.java``. A tail several files share stops the search.
    """
    tails = refs.select("ref_id", F.posexplode(path_suffixes("tail")).alias("cut", "tail"))
    ends = files.select("path").distinct().select("path", F.explode(path_suffixes("path")).alias("tail"))
    counted = ends.join(tails.select("tail").distinct(), "tail", "left_semi").groupBy("tail").agg(F.count("*").alias("n"), F.min("path").alias("target"))
    best = tails.join(counted, "tail").groupBy("ref_id").agg(F.min_by(F.struct("n", "target"), "cut").alias("b"))
    return best.where("b.n = 1").select("ref_id", "b.target")


def package_imports(refs: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target of paths that name something in the package of the using file: the package is the longest root above the file, the
    target the file of that package that the longest tail ends; only where at this length one file ends so.

    ``refs`` has ref_id, path, tail; ``roots`` root.
    """
    own = refs.join(resolve_by_prefix(refs.select("ref_id", "path"), roots), "ref_id").select("ref_id", "root", F.posexplode(path_suffixes("tail")).alias("cut", "tail"))
    paths = files.select("path").distinct()
    placed = paths.join(resolve_by_prefix(paths.select(F.col("path").alias("ref_id"), "path"), roots).withColumnRenamed("ref_id", "path"), "path")
    ends = placed.select("path", "root", F.explode(path_suffixes("path")).alias("tail"))
    counted = ends.join(own.select("root", "tail").distinct(), ["root", "tail"], "left_semi").groupBy("root", "tail").agg(F.count("*").alias("n"), F.min("path").alias("target"))
    best = own.join(counted, ["root", "tail"]).groupBy("ref_id").agg(F.min_by(F.struct("n", "target"), "cut").alias("b"))
    return best.where("b.n = 1").select("ref_id", "b.target")


def includes(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target of ``#include``: the file beside the including one, else the only file whose path ends so. ``refs`` has ref_id, path, spec."""
    from loamgraph.operators.resolve import normal_path, resolve_by_suffix

    near = refs.withColumn("joined", F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.col("spec"))).withColumn("target", normal_path("joined"))
    near = near.select("ref_id", "target").join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select("ref_id", "target")
    far = resolve_by_suffix(refs.join(near.select("ref_id"), "ref_id", "left_anti").select("ref_id", F.col("spec").alias("tail")), files)
    return near.unionByName(far)


def federated_rows(rows: DataFrame, child: str = "child", path: str = "path") -> DataFrame:
    """The rows of all members of a workspace as one, each path below the name of its member and the member dropped."""
    return rows.withColumn(path, F.concat_ws("/", child, path)).drop(child)


def first_with_rows(candidates: list[DataFrame]) -> DataFrame:
    """The first of several candidates that has any rows, else the last: how the base of a diff is chosen. Each is probed for one row."""
    return next((c for c in candidates[:-1] if not c.isEmpty()), candidates[-1])


def concept_scores(titles: DataFrame, bodies: DataFrame, idf: DataFrame, words: list[str]) -> DataFrame:
    """id, score of concept documents: tf times idf, title three times, body once. Bags have id, term, tf."""
    w = F.broadcast(idf.where(F.col("term").isin(words)).select("term", "idf"))  # as many rows as the query has terms
    both = titles.where(F.col("term").isin(words)).select("id", "term", (3 * F.col("tf")).alias("tf")).unionByName(bodies.where(F.col("term").isin(words)).select("id", "term", "tf"))
    return both.join(w, "term").groupBy("id").agg(F.sum(F.col("tf") * F.col("idf")).alias("score"))


def paged(exact: DataFrame, ranked: DataFrame, *, exact_page: int = 10, ranked_page: int = 50) -> DataFrame:
    """query, path, page: exact candidates ten to a page and ranked ones fifty to a page, each file on the first page it is on.

    Both have query, path, score; ties go by path.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path")
    pages = lambda df, size: df.select("query", "path", (F.floor((F.row_number().over(w) - 1) / size) + 1).alias("page"))
    return pages(exact, exact_page).unionByName(pages(ranked, ranked_page)).groupBy("query", "path").agg(F.min("page").alias("page"))


def definition_lookup(nodes: DataFrame, degrees: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """id, path, start_line, end_line, exact, in_degree of the definitions of a name in the order a lookup shows them; a top-k report."""
    from loamgraph.functions.text import TEST_PATH_ASK

    rows = nodes.where("kind <> 'file'").where(F.lower("name") == name.lower()).join(degrees.withColumnRenamed("target", "id"), "id", "left")
    rows = rows.select("id", "path", "start_line", "end_line", (F.col("name") == name).alias("exact"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "exported")
    order = [F.desc("exact"), F.col("path").rlike(TEST_PATH_ASK), ~F.coalesce("exported", F.lit(False)), F.desc("in_degree"), "path", "start_line", "id"]
    return rows.orderBy(*order).limit(limit).drop("exported")


def inline_tests(nodes: DataFrame) -> DataFrame:
    """id of symbols that are tests inside code: members of a ``tests`` module or a ``Test*`` class of their file, and ``test_*`` functions of Python test files.

    An id that also stands for code outside is none.
    """
    from loamgraph.functions.text import TEST_PATH_ASK

    holder = (F.col("kind") == "module") & (F.col("name") == "tests") & F.col("path").endswith(".rs") | (F.col("kind") == "class") & F.col("name").startswith("Test") & F.col("path").endswith(".py")
    holders = nodes.where(holder).select("path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    symbols = nodes.where("kind <> 'file'")
    inside = symbols.join(holders, "path").where("start_line >= a and end_line <= b").select("id")
    named = symbols.where((F.col("kind") == "function") & F.col("name").startswith("test_") & F.col("path").rlike(TEST_PATH_ASK) & F.col("path").endswith(".py")).select("id")
    return inside.unionByName(named).distinct()


def context_check(manifest: DataFrame, files: DataFrame, nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: drifted and removed sources of a context manifest (path, hash), and the share of exported symbols its concepts cover (id)."""
    now = files.select("path", F.col("hash").alias("now"), F.lit(1).alias("there"))
    m = manifest.select("path", "hash").distinct().join(now, "path", "left")
    state = m.agg(F.count_if(F.col("there").isNull()).alias("removed"), F.count_if(F.col("there").isNotNull() & ~F.col("hash").eqNullSafe(F.col("now"))).alias("drifted"))
    public = nodes.where("kind <> 'file' and exported").select("id").distinct()
    share = public.join(covered.select("id", F.lit(1).alias("c")).distinct(), "id", "left").agg((F.count("c") / F.nullif(F.count("*"), F.lit(0))).alias("coverage"))
    return state.join(share)
