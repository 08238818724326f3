"""Sources: file trees, diffs, commit logs, concept documents, session logs, script blocks and definitions by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.session import ship

# Folders a walk leaves out, and the largest file it takes.
SKIP_DIRS = ["node_modules", "dist", "build", "_build", "out", "target", "vendor", "coverage", "__pycache__", "venv"]
MAX_BYTES = 1_000_000
# Languages by file ending; the longest ending that fits decides.
ENDINGS = {
    ".d.ts": "typescript", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyi": "python",
    ".go": "go", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".php": "php", ".blade.php": "blade", ".r": "r", ".rs": "rust", ".rb": "ruby", ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".scala": "scala", ".lua": "lua", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".vue": "vue", ".svelte": "svelte", ".astro": "astro", ".md": "markdown",
}


def walk(spark: SparkSession, roots: dict[str, str], *, include: list[str] | None = None, exclude: list[str] | None = None, only_dirs: list[str] | None = None) -> DataFrame:
    """child, path, size, mtime_ms, content of every file below the roots (name to folder): no skipped folder, no dot folder or dot file, at most ``MAX_BYTES``.

    ``include`` and ``exclude`` are path prefixes, ``only_dirs`` folders outside which nothing counts. Roots that do not exist are an error of the reader.
    """
    parts = []
    for name, folder in roots.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        base = folder.rstrip("/")
        rel = F.regexp_replace(F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})"), "%20", " ")
        parts.append(files.where(F.col("length") <= MAX_BYTES).select(F.lit(name).alias("child"), rel.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), "content"))
    rows = reduce(DataFrame.unionByName, parts)
    skipped = r"(^|/)(" + "|".join(SKIP_DIRS) + r")/|(^|/)\.[^/]"
    rows = rows.where(~F.col("path").rlike(skipped))
    for prefixes, keep in ((include, True), (only_dirs, True), (exclude, False)):
        if prefixes:
            hit = reduce(Column.__or__, [(F.col("path") == p.rstrip("/")) | F.col("path").startswith(p.rstrip("/") + "/") for p in prefixes])
            rows = rows.where(hit if keep else ~hit)
    return rows


def decode_source(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text``: little-endian UTF-16 with a mark decoded, big-endian null, all else UTF-8 with replacement characters. Bad bytes make the JVM's decoder fail, so batches go through Python."""
    import pandas as pd

    ship(files.sparkSession)

    def decode(data: bytes | None) -> str | None:
        if data is None or data[:2] == b"\xfe\xff":
            return None
        if data[:2] == b"\xff\xfe":
            return data[2:].decode("utf-16-le", "replace")
        return data.decode("utf-8", "replace").removeprefix("\ufeff")

    def run(batches):
        for b in batches:
            yield b.drop(columns=[content]).assign(text=pd.Series([decode(bytes(x) if x is not None else None) for x in b[content]], dtype=object, index=b.index))

    kept = [f for f in files.schema.fields if f.name != content]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return files.mapInPandas(run, f"{schema}, text string")


def language(path: str | Column) -> Column:
    """Language of a path by the longest ending that fits; null for an unknown one."""
    c = F.lower(F.col(path) if isinstance(path, str) else path)
    out = F.lit(None).cast("string")
    for ending in sorted(ENDINGS, key=len):
        out = F.when(c.endswith(ending), ENDINGS[ending]).otherwise(out)
    return out


def _lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n|\r|\n"))).select(key, (F.col("pos") + 1).alias("n"), F.col("col").alias("line"))


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """diff_id, path, start_line, end_line of every changed range of a unified diff, in lines of the new file; a pure deletion is the line before it."""
    w = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(diffs, "diff_id").withColumn("path", F.last(F.nullif(F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+?)\t?$", 1), F.lit("")), ignorenulls=True).over(w))
    start = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1).try_cast("int")
    size = F.coalesce(F.regexp_extract("line", r"^@@ -\S+ \+\d+,(\d+)", 1).try_cast("int"), F.lit(1))
    hunks = rows.where(F.col("line").startswith("@@ ") & (F.col("path") != "/dev/null")).select("diff_id", "path", start.alias("start_line"), size.alias("size"))
    return hunks.where("start_line is not null").select("diff_id", "path", F.greatest(F.lit(1), "start_line").alias("start_line"), F.greatest(F.lit(1), F.col("start_line") + F.greatest(F.col("size"), F.lit(1)) - 1).alias("end_line"))


def diff_files(names: DataFrame) -> DataFrame:
    """diff_id, status, old_path, path of ``git diff --name-status`` lines."""
    cols = F.split("line", "\t")
    rows = _lines(names, "diff_id").where(F.size(cols) >= 2)
    letter = F.substring("line", 1, 1)
    status = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "R", "renamed").otherwise("modified")
    return rows.select("diff_id", status.alias("status"), F.when(F.size(cols) > 2, cols[1]).alias("old_path"), F.element_at(cols, -1).alias("path"))


def commit_log(logs: DataFrame) -> DataFrame:
    """sha, ts, person, email, path of ``git log --name-only --format=%x01%H%x02%cI%x02%an%x02%ae`` text (log_id, text); bots are left out."""
    w = Window.partitionBy("log_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(logs, "log_id").withColumn("head", F.last(F.when(F.col("line").startswith("\x01"), F.col("line")), ignorenulls=True).over(w))
    part = F.split(F.substring("head", 2, 1 << 30), "\x02")
    bot = F.lower(part[2]).contains("[bot]") | F.lower(part[3]).contains("[bot]@") | F.trim(part[2]).rlike(r"(?i)^(github-actions|dependabot|renovate)(\[bot\])?$")
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("\x01") & F.col("head").isNotNull() & ~bot).select(part[0].alias("sha"), F.to_timestamp(part[1]).alias("ts"), part[2].alias("person"), part[3].alias("email"), F.col("line").alias("path"))


def handle_of(email: str | Column) -> Column:
    """Handle of a noreply mail address; null for others."""
    return F.nullif(F.regexp_extract(F.trim(F.col(email) if isinstance(email, str) else email), r"(?i)^(?:\d+\+)?([A-Za-z0-9-]+)@users\.noreply\.[a-z.]+$", 1), F.lit(""))


def concept_documents(docs: DataFrame) -> DataFrame:
    """doc_id, title, sources, links, snippet of Markdown with front matter: scalar ``title``, lists ``sources`` and ``links``, the first line of prose."""
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    items = lambda key: F.transform(F.regexp_extract_all(F.regexp_extract(front, rf"(?m)^{key}:\s*((?:\r?\n\s*-\s*.+)+|\[.*\])", 1), F.lit(r"-\s*([^\r\n]+)|([^\[\],\s]+)"), 0), lambda s: F.trim(F.regexp_replace(s, r"^-\s*|[\"']", "")))
    prose = F.filter(F.split(body, r"\r\n|\r|\n"), lambda s: ~s.rlike(r"^\s*($|#|```|[-*>|])"))
    return docs.where("text is not null").select("doc_id", F.trim(F.regexp_replace(F.regexp_extract(front, r"(?m)^title:\s*(.+)$", 1), "[\"']", "")).alias("title"), items("sources").alias("sources"), items("links").alias("links"), F.get(prose, F.lit(0)).alias("snippet"))


def session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Session files (JSON, one document each) with a fixed schema."""
    schema = "id string, day date, tool_reads long, source_reads long, saved_tokens long, input_cost_micros long, input_tokens_billed long, savings_formula int"
    return spark.read.schema(schema).option("multiLine", "true").json(folder)


def script_blocks(pages: DataFrame) -> DataFrame:
    """path, start_line, code of every script block of a page or component, lines counted in the host file."""
    block = r"(?si)<script\b[^>]*>(.*?)</script>"
    rows = pages.where("text is not null").select("path", "text", F.posexplode(F.regexp_extract_all("text", F.lit(block), 1)).alias("k", "code"))
    before = F.expr("aggregate(slice(split(text, '(?i)<script\\\\b[^>]*>'), 1, k + 1), '', (a, s) -> concat(a, s))")
    tags = F.expr("aggregate(slice(regexp_extract_all(text, '(?i)<script\\\\b[^>]*>', 0), 1, k + 1), '', (a, s) -> concat(a, s))")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return rows.select("path", (newlines(before) + newlines(tags) + 1).alias("start_line"), "code")


def shell_functions(lines: DataFrame) -> DataFrame:
    """path, line, name of every function definition of a shell script."""
    name = F.regexp_extract("text", r"^\s*(?:function\s+([A-Za-z_][\w.:-]*)\s*(?:\(\s*\))?|([A-Za-z_][\w.:-]*)\s*\(\s*\))\s*(?:\{.*)?$", 1)
    other = F.regexp_extract("text", r"^\s*(?:function\s+([A-Za-z_][\w.:-]*)\s*(?:\(\s*\))?|([A-Za-z_][\w.:-]*)\s*\(\s*\))\s*(?:\{.*)?$", 2)
    return lines.where(F.lower("path").rlike(r"\.(sh|bash|zsh)$")).select("path", "line", F.coalesce(F.nullif(name, F.lit("")), other).alias("name")).where("name <> ''")


# One-line rules of the breadth extractor; the last group is the name.
RULES = [
    ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("), ("class", r"^\s*class\s+([A-Za-z_]\w*)"), ("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[(\[]"),
    ("function", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)"), ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)"), ("type", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)"),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"),
]


def definitions_by_rule(lines: DataFrame) -> DataFrame:
    """path, line, name, kind: definitions found by one-line rules, the first rule that fits; for languages without a front end of their own."""
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, rule in reversed(RULES):
        found = F.regexp_extract("text", rule, 1)
        name, kind = F.when(found != "", found).otherwise(name), F.when(found != "", k).otherwise(kind)
    return lines.select("path", "line", name.alias("name"), kind.alias("kind")).where("name is not null")


def missing_children(expected: DataFrame, present: DataFrame) -> DataFrame:
    """child of the expected members of a workspace that have no graph."""
    return expected.select("child").distinct().join(present.select("child").distinct(), "child", "left_anti")
