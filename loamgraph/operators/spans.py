"""Lines and spans: search, the innermost enclosing span, overlaps, covered lines.

Points and spans meet per file and block of lines: a span is listed under every block of ``BLOCK`` lines it touches, a point under
one, so the join is an equality join on (path, block) whose groups stay small even in a huge file.
"""

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import REASON, cut_units, under
from loamgraph.session import ship

BLOCK = 64  # lines


def _block(line: Column) -> Column:
    return F.floor((line - 1) / BLOCK)


def _blocked(spans: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    ok = spans.where((F.col(start) >= 1) & (F.col(end) >= F.col(start)))
    return ok.withColumn("block", F.explode(F.sequence(_block(F.col(start)), _block(F.col(end)))))


def required_texts(pattern: str) -> list[str]:
    """Texts of which every match of a regular expression holds at least one, as long as can be told; empty where none is certain."""
    from re import _constants as k
    from re import _parser

    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []  # a dialect Python does not read
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []

    def need(items) -> list[str]:
        best, run = [], ""

        def consider(texts: list[str]) -> None:
            nonlocal best
            if texts and all(texts) and len(texts) <= 16 and min(map(len, texts)) > min(map(len, best), default=0):
                best = texts

        for op, arg in items:
            if op is k.LITERAL and chr(arg) not in "\r\n":
                run += chr(arg)
                continue
            consider([run])
            run = ""
            if op is k.SUBPATTERN and not arg[1] & re.IGNORECASE:
                consider(need(arg[3]))
            elif op is k.BRANCH:
                ways = [need(way) for way in arg[1]]
                if all(ways):
                    consider([t for way in ways for t in way])
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and arg[0] > 0:
                consider(need(arg[2]))
        consider([run])
        return best

    return need(parsed)


def _holds(column: str, pattern: str, fixed: bool, ignore_case: bool) -> Column | None:
    """Whether a text holds what every match must hold; None where nothing is certain."""
    texts = [] if ignore_case else [pattern] if fixed else required_texts(pattern)
    return reduce(Column.__or__, [F.col(column).contains(t) for t in texts]) if texts else None


def search_lines(lines: DataFrame, pattern: str, *, fixed: bool = False, ignore_case: bool = False, prefix: str = "") -> DataFrame:
    """path, line, text of every line that matches a Java regular expression, or holds a fixed text; hits are trimmed and cut to 160 UTF-16 units.

    Texts that every match must hold are sought first, as that costs far less than the expression.
    """
    hit = F.col("text").rlike(("(?i)" if ignore_case else "") + (re.escape(pattern) if fixed else pattern)) if not fixed or ignore_case else F.col("text").contains(pattern)
    if not fixed and (held := _holds("text", pattern, fixed, ignore_case)) is not None:
        hit = held & hit
    return lines.where(under("path", prefix)).where(hit).select("path", "line", cut_units(F.trim("text"), 160).alias("text"))


def search_files(files: DataFrame, pattern: str, *, fixed: bool = False, ignore_case: bool = False, prefix: str = "") -> DataFrame:
    """:func:`search_lines` over files (path, content): those without a text that every match must hold are never cut into lines."""
    rows = files.where("content is not null").where(under("path", prefix))
    held = _holds("content", pattern, fixed, ignore_case)
    return search_lines(lines_of(rows if held is None else rows.where(held)), pattern, fixed=fixed, ignore_case=ignore_case)


def lines_of(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of files (path, content)."""
    return files.select("path", F.posexplode(F.split("content", r"\r\n|\r|\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points with ``id`` of the innermost span around them, null outside all: the greatest start, of equal starts the later node.

    ``points`` has path and line; ``spans`` path, start_line, end_line, id, node_key.
    """
    s = _blocked(spans.select("path", "start_line", "end_line", "id", "node_key"))
    p = points.withColumn("block", _block(F.col("line")))
    inside = p.join(s, ["path", "block"]).where("line between start_line and end_line")
    best = inside.groupBy("path", "line").agg(F.max_by("id", F.struct("start_line", "node_key")).alias("id"))
    return points.join(best, ["path", "line"], "left")


def enclosing_chain(points: DataFrame, spans: DataFrame) -> DataFrame:
    """path, line, position, id: all spans around a point, the shortest first."""
    s = _blocked(spans.select("path", "start_line", "end_line", "id"))
    inside = points.select("path", "line").distinct().withColumn("block", _block(F.col("line"))).join(s, ["path", "block"]).where("line between start_line and end_line")
    w = Window.partitionBy("path", "line").orderBy(F.col("end_line") - F.col("start_line"), "id")
    return inside.select("path", "line", F.row_number().over(w).alias("position"), "id")


def overlapping(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """path, range_start, range_end, id: spans that overlap a range, without those that contain another overlapping span of that range.

    Spans that are equal contain each other, so both are left out.
    """
    r = _blocked(ranges.select("path", F.col("start_line").alias("range_start"), F.col("end_line").alias("range_end")).distinct(), "range_start", "range_end")
    s = _blocked(spans.select("path", "start_line", "end_line", "id"))
    hits = r.join(s, ["path", "block"]).where("start_line <= range_end and end_line >= range_start").select("path", "range_start", "range_end", "id", "start_line", "end_line").distinct()
    other = hits.select("path", "range_start", "range_end", F.col("id").alias("o_id"), F.col("start_line").alias("o_start"), F.col("end_line").alias("o_end"))
    keys = ["path", "range_start", "range_end"]
    match = (F.col("h.id") != F.col("o.o_id")) & (F.col("h.start_line") <= F.col("o.o_start")) & (F.col("h.end_line") >= F.col("o.o_end"))
    for k in keys:
        match = match & (F.col(f"h.{k}") == F.col(f"o.{k}"))
    return hits.alias("h").join(other.alias("o"), match, "left_anti").select(*keys, "id")


def overlapping_all(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """path, id of every span that overlaps a range."""
    r = _blocked(ranges.select("path", F.col("start_line").alias("range_start"), F.col("end_line").alias("range_end")).distinct(), "range_start", "range_end")
    s = _blocked(spans.select("path", "start_line", "end_line", "id"))
    return r.join(s, ["path", "block"]).where("start_line <= range_end and end_line >= range_start").select("path", "id").distinct()


def covered_lines(spans: DataFrame) -> DataFrame:
    """path, covered: lines under spans of a file, each counted once, by gaps and islands."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where("start_line >= 1 and end_line >= start_line").select("path", "start_line", "end_line").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end_line") - F.greatest(F.col("before"), F.col("start_line") - 1))
    return rows.groupBy("path").agg(F.sum(fresh).alias("covered"))


def covered_chars(covered: DataFrame, files: DataFrame, *, widest: float = 200.0, share: float = 0.5) -> DataFrame:
    """path, chars: what covered lines stand for: their number times the average length of a line of the file, at most ``widest``, times ``share``.

    ``covered`` has path and covered; ``files`` path and content.
    """
    lines = F.size(F.split("content", r"\r\n|\r|\n"))
    average = files.where("content is not null").groupBy("path").agg(F.max(F.length("content") / lines).alias("average"))
    return covered.join(average, "path").select("path", F.floor(F.col("covered") * F.least(F.lit(widest), F.col("average")) * share).cast("long").alias("chars"))


def hunk_targets(ranges: DataFrame, spans: DataFrame, *, most: int = 20) -> DataFrame:
    """commit, id: the symbols that the changed ranges of a commit overlap, tests and documents left out; a commit that touches more than ``most``
    symbols links to their files instead. ``ranges`` has commit, path, start_line, end_line."""
    from loamgraph.functions.text import TEST_PATH_WHY

    r = _blocked(ranges.where(~F.col("path").rlike(TEST_PATH_WHY)).select("commit", "path", F.col("start_line").alias("range_start"), F.col("end_line").alias("range_end")).distinct(), "range_start", "range_end")
    hits = r.join(_blocked(spans.select("path", "start_line", "end_line", "id")), ["path", "block"]).where("start_line <= range_end and end_line >= range_start").select("commit", "path", "id").distinct()
    counts = hits.groupBy("commit").agg(F.count("*").alias("n"))
    return hits.join(counts, "commit").select("commit", F.when(F.col("n") > most, F.col("path")).otherwise(F.col("id")).alias("id")).distinct()


def grep_groups(hits: DataFrame, spans: DataFrame, degrees: DataFrame, *, cap: int | None = None) -> DataFrame:
    """path, id, n_hits, first_line, in_degree: hits grouped under their innermost span. ``cap`` keeps the first hits in (path, line) order, a report
    feature; then ``dropped`` tells in each row how many hits the report leaves out."""
    if cap is not None:
        total = hits.agg(F.greatest(F.lit(0), F.count("*") - cap).alias("dropped"))
        shown = grep_groups(hits.orderBy("path", "line").limit(cap), spans, degrees)
        return shown.join(F.broadcast(total))
    placed = innermost(hits.select("path", "line"), spans)
    groups = placed.groupBy("path", "id").agg(F.count("*").alias("n_hits"), F.min("line").alias("first_line"))
    return groups.join(degrees.select(F.col("target").alias("id"), "in_degree"), "id", "left").select("path", F.coalesce("id", "path").alias("id"), "n_hits", "first_line", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


# File endings whose comments begin with one mark only.
HASH_FILES = r"\.(py|pyi|rb|sh|bash|zsh|pl|r|yml|yaml|toml|ex|exs|jl|tf|cmake|mk)$|(^|/)(makefile|dockerfile|gemfile|rakefile)$"
SLASH_FILES = r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts|java|kt|kts|go|rs|c|h|cc|cpp|hpp|cs|swift|scala|dart|php|m|mm|proto|zig|sol)$"
_MARKS = re.compile(r'\\?"|//|#')


def comment_of(text: str, slash: bool, hashed: bool) -> "str | None":
    """The comment of one line, from its mark on. A quote after a backslash neither opens nor closes a string."""
    inside = False
    for m in _MARKS.finditer(text):
        mark, at = m[0], m.start()
        if mark[-1] == '"':
            inside ^= mark == '"'
        elif inside:
            continue
        elif mark == "//":
            if slash and text[at - 1 : at] != ":":
                return text[at:]
        elif hashed and (at == 0 or text[at - 1] in " \t") and text[at + 1 : at + 2] not in ("[", "!"):
            return text[at:]
    return None


def comment_lines(lines: DataFrame) -> DataFrame:
    """path, line, comment: from the first comment mark outside a double-quoted string to the end of the line.

    ``//`` counts unless a colon stands before it, ``#`` at the start of the line or after a blank and not before ``[`` or ``!``;
    which of both a file uses its ending says. Parity of quotes is beyond a regular expression that takes constant stack, so
    the lines that hold a mark at all are scanned in batches of a Pandas function.
    """
    ship(lines.sparkSession)

    @F.pandas_udf("string")
    def scan(text: pd.Series, slash: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series([comment_of(t, s, h) for t, s, h in zip(text, slash, hashed, strict=True)], dtype=object)

    low = F.lower("path")
    slash, hashed = ~low.rlike(HASH_FILES), ~low.rlike(SLASH_FILES)
    marked = lines.where(F.col("text").contains("//") | F.col("text").contains("#"))
    return marked.select("path", "line", scan("text", slash, hashed).alias("comment")).where("comment is not null")


def reason_comments(comments: DataFrame) -> DataFrame:
    """Comments that give a reason: a tag such as ``TODO`` or ``SAFETY`` as a whole word, or because, so that, never."""
    return comments.where(F.col("comment").rlike(REASON))


def source_slice(files: DataFrame, spans: DataFrame, *, most: int = 80) -> DataFrame:
    """id, code, cut: the source lines of a span, at most ``most`` of them."""
    parts = files.where("content is not null").select("path", F.split("content", r"\r\n|\r|\n").alias("parts"))
    rows = spans.where("start_line >= 1 and end_line >= start_line").select("path", "id", "start_line", "end_line").join(parts, "path").where(F.col("start_line") <= F.size("parts"))
    n = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(most))
    return rows.select("id", F.array_join(F.slice("parts", F.col("start_line"), n), "\n").alias("code"), (F.col("end_line") - F.col("start_line") + 1 > most).alias("cut"))


def evidence(edges: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """source, target, line, text: for each call the first line of the caller's span that names the callee as a whole word."""
    s = nodes.where("kind <> 'file'").select(F.col("id").alias("source"), "path", "start_line", "end_line")
    t = nodes.where("kind <> 'file'").select(F.col("id").alias("target"), F.col("name").alias("callee"))
    calls = _blocked(edges.where("relation = 'calls'").select("source", "target").distinct().join(s, "source").join(t, "target"))
    words = lines.withColumn("block", _block(F.col("line"))).select("path", "block", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0))).alias("callee"))
    hits = words.join(calls, ["path", "block", "callee"]).where("line between start_line and end_line")
    return hits.groupBy("source", "target").agg(F.min_by(F.struct("line", F.trim("text").alias("text")), "line").alias("e")).select("source", "target", "e.line", "e.text")
