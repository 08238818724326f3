"""Call proofs: a call is extracted where the binding of its name leads to exactly one declaration, and dropped where it does not.

A name is bound by a declaration of its own file or by one import; a name bound twice in a file proves nothing. Imports lead to a
file by the rules of their language, and through files that pass names on to the one that declares them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.resolve import normal_path, resolve_by_suffix, resolve_exports, resolve_imports
from loamgraph.session import materialize

_SCRIPT, _PYTHON = r"\.[cm]?[jt]sx?$", r"\.pyi?$"


def script_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target: the file a relative specifier of a script means; ``imports`` has ref_id, path, spec."""
    found = resolve_imports(imports.where(F.col("path").rlike(_SCRIPT)), files)
    return found.where("resolved").select("ref_id", "target")


def python_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target: the file a Python module name means: relative to the folder of the file by its leading dots, else the only file whose path ends so."""
    rows = imports.where(F.col("path").rlike(_PYTHON))
    dots, tail = F.length(F.regexp_extract("spec", r"^(\.*)", 1)), F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/")
    up = F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.repeat(F.lit("../"), F.greatest(F.lit(0), dots - 1)))
    near = rows.where(dots > 0).select("ref_id", normal_path(F.concat(up, tail)).alias("base"))
    tries = near.select("ref_id", F.posexplode(F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))).alias("ord", "target"))
    hit = tries.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi").groupBy("ref_id").agg(F.min_by("target", "ord").alias("target"))
    far = rows.where(dots == 0).select("ref_id", F.explode(F.array(F.concat(tail, F.lit(".py")), F.concat(tail, F.lit("/__init__.py")))).alias("tail"))
    only = resolve_by_suffix(far, files).groupBy("ref_id").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").select("ref_id", "target")
    return hit.unionByName(only)


def proven_calls(raw: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """path, ord, target, confidence: the calls of scripts and Python files whose name leads to one declaration.

    ``raw`` and ``symbols`` are what :mod:`extract` gives. A bare name is bound by the one top-level declaration of its file, or by one import and no
    declaration; a member is proven where its receiver is an import of a whole module, or an imported or own class. Aliases,
    index files and barrels are followed; default exports and what runs into a cycle or an ambiguity are not proven.
    """
    raw = materialize(raw, "raw-edges")  # texts are read once
    named = raw.where("relation = 'imports' and spec is not null and imported is not null").select("path", "ord", "spec", "imported", "name")
    refs = named.withColumn("ref_id", F.concat_ws("\0", "path", F.col("ord").cast("string"), "name"))
    modules = script_modules(refs.select("ref_id", "path", "spec"), files).unionByName(python_modules(refs.select("ref_id", "path", "spec"), files))
    bound = materialize(refs.join(modules, "ref_id"), "bound")
    passed = bound.where(F.col("name").startswith("export ")).select("path", F.substring("name", 8, 1 << 20).alias("name"), F.col("target").alias("source"), F.col("imported").alias("source_name"))
    package = bound.where(F.col("path").rlike(r"__init__\.py$") & (F.col("imported") != "*")).select("path", "name", F.col("target").alias("source"), F.col("imported").alias("source_name"))
    passed = passed.unionByName(package)
    local = bound.where(~F.col("name").startswith("export ")).select("path", "name", "target", "imported")
    top = symbols.where("owner is null")
    declared = top.groupBy("path", "name").agg(F.count("*").alias("own"), F.min("id").alias("own_id"))
    imported = local.distinct().groupBy("path", "name").agg(F.count("*").alias("times"), F.min("target").alias("target"), F.min("imported").alias("imported"))
    calls = raw.where("relation = 'calls'").where(F.col("path").rlike(f"{_SCRIPT}|{_PYTHON}")).select("path", "ord", "name", "recv")
    key = F.coalesce("recv", "name")
    known = calls.withColumn("bound", key).join(declared.withColumnRenamed("name", "bound"), ["path", "bound"], "left").join(imported.withColumnRenamed("name", "bound"), ["path", "bound"], "left")
    single_own, single_import = F.col("own").eqNullSafe(1) & F.col("times").isNull(), F.col("own").isNull() & F.col("times").eqNullSafe(1)
    own = known.where(single_own & F.col("recv").isNull()).select("path", "ord", F.col("own_id").alias("target"))
    # through an import: the name, the member of a module, or the class of a member
    sought = F.when(F.col("recv").isNull(), F.col("imported")).when(F.col("imported") == "*", F.col("name")).otherwise(F.col("imported"))
    asked = known.where(single_import & (F.col("recv").isNotNull() | (F.col("imported") != "*"))).select(F.concat_ws("\0", "path", F.col("ord").cast("string")).alias("ref_id"), "path", "ord", "recv", "name", "imported", F.col("target").alias("file"), sought.alias("sought"))
    asked = materialize(asked, "asked")
    exports = top.where("exported").select("path", "name", "id")
    found = resolve_exports(asked.select("ref_id", F.col("file").alias("path"), F.col("sought").alias("name")).distinct(), exports, passed.distinct())
    led = asked.join(found.select("ref_id", "id"), "ref_id")
    plain = led.where(F.col("recv").isNull() | (F.col("imported") == "*")).select("path", "ord", F.col("id").alias("target"))
    members = symbols.where("owner is not null").groupBy(F.concat(F.col("path"), F.lit("#"), F.col("owner")).alias("class"), "name").agg(F.count("*").alias("n"), F.min("id").alias("member")).where("n = 1")
    of_class = led.where(F.col("recv").isNotNull() & (F.col("imported") != "*")).withColumnRenamed("id", "class")
    of_own = known.where(single_own & F.col("recv").isNotNull()).select("path", "ord", "name", F.col("own_id").alias("class"))
    member = of_class.select("path", "ord", "name", "class").unionByName(of_own).join(members, ["class", "name"]).select("path", "ord", F.col("member").alias("target"))
    return own.unionByName(plain).unionByName(member).select("path", "ord", "target", F.lit("extracted").alias("confidence"))


def judged(found: DataFrame, oracle: DataFrame) -> DataFrame:
    """confidence, n, right, wrong, unverified: links (path, line, name, target, confidence) against the rows of an oracle (path, line, name, target).

    A link is right if the oracle has the same target for the name on the line, wrong if it has others only, and unverified if it says nothing there.
    """
    keys = ["path", "line", "name"]
    said = oracle.where("target is not null").select(*keys, F.col("target").alias("said")).distinct()
    both = found.join(said, keys, "left").groupBy(*keys, "target", "confidence").agg(F.count("said").alias("n"), F.count_if(F.col("said") == F.col("target")).alias("hit"))
    return both.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(F.col("hit") > 0).alias("right"), F.count_if((F.col("n") > 0) & (F.col("hit") == 0)).alias("wrong"), F.count_if(F.col("n") == 0).alias("unverified"))
