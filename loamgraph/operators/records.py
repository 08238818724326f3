"""Decision records: entries of dated documents, their links to files and nodes, what supersedes what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import base_name, dir_prefixes, file_stem, normalize_heading

DATE = r"(\d{4}-\d{2}-\d{2})"


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text, fenced: lines with whether they stand in a fenced code block."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n"))).select("doc_id", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))
    fence = F.sum(F.col("text").startswith("```").cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))
    return rows.withColumn("fenced", fence % 2 == 1)


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, line, level, heading of every heading outside fenced code."""
    mark = F.regexp_extract("text", r"^(#{1,6})\s+\S", 1)
    rows = lines.where(~F.col("fenced")).select("doc_id", "line", F.length(mark).alias("level"), F.trim(F.regexp_replace("text", r"^#{1,6}\s+|\s+#*\s*$", "")).alias("heading"))
    return rows.where("level > 0")


def record_entries(docs: DataFrame) -> DataFrame:
    """doc_id, line, heading, date of the decision record a document is: its first ``Date:`` line outside code dates it, its first
    heading names it (the document's path without one). Documents without a date are no records."""
    lines = document_lines(docs)
    dated = lines.where(~F.col("fenced") & F.col("text").contains("Date:")).select("doc_id", "line", F.regexp_extract("text", DATE, 1).alias("date")).where("date <> ''")
    date = dated.groupBy("doc_id").agg(F.min_by("date", "line").alias("date"))
    head = headings(lines).groupBy("doc_id").agg(F.min_by("heading", "line").alias("heading"), F.min("line").alias("line"))
    return docs.select("doc_id", "path").join(date, "doc_id").join(head, "doc_id", "left").select("doc_id", F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("heading", "path").alias("heading"), "date")


def superseded(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, by: an entry whose heading a later one names in an explicit ``Supersedes:`` line, the smallest such document.

    The named headings are joined by equality, with or without a leading number; no entry is compared with all others.
    """
    own = entries.select("doc_id", "date", normalize_heading("heading").alias("h"))
    own = own.withColumn("key", F.explode(F.array_distinct(F.array("h", F.trim(F.regexp_replace("h", r"^(adr-\d+:|\d{4}-\d{2}-\d{2})\s*", "")), F.regexp_extract("h", r"^(adr-\d+)", 1))))).where("key <> ''")
    named = document_lines(docs).where(~F.col("fenced")).select(F.col("doc_id").alias("by"), F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\*{0,2}supersedes:?\*{0,2}:?\s*(.+)$"), 1)).alias("name"))
    named = named.select("by", normalize_heading("name").alias("key")).join(entries.select(F.col("doc_id").alias("by"), F.col("date").alias("by_date")), "by")
    hits = own.join(named, "key").where("by <> doc_id and by_date >= date")
    return hits.groupBy("doc_id").agg(F.min("by").alias("by"))


def path_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, token: path-like tokens and quoted names in a document's text."""
    found = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+"), 0), F.regexp_extract_all("text", F.lit(r"`([^`\s]+)`"), 1)))
    return docs.where("text is not null").select("doc_id", F.explode(found).alias("token"))


def static_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, id, level: level 0 where a quoted token is a node's id or name of one node, level 2 where a path token is a file's path."""
    m = path_mentions(docs)
    ids = m.join(nodes.select(F.col("id").alias("token"), "id", "kind"), "token").select("doc_id", "id", F.when(F.col("kind") == "file", 2).otherwise(0).alias("level"))
    names = nodes.where("kind <> 'file'").groupBy(F.col("name").alias("token")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    by_name = m.join(names, "token").select("doc_id", "id", F.lit(0).alias("level"))
    return ids.unionByName(by_name).groupBy("doc_id", "id").agg(F.min("level").alias("level"))


def exact_files(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, path: the files that a document links to exactly, by a node of theirs or by their path."""
    return static_links(docs, nodes).join(nodes.select("id", "path"), "id").select("doc_id", "path").distinct()


def file_mentions(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, path, weight: how strongly a document names a file; its path counts 1, its name 0.6, its stem 0.3, a folder above it 0.1 each, over the square root of how many files share the token."""
    m = path_mentions(docs)
    p = files.select("path").distinct()
    forms = p.select("path", F.explode(F.array(F.struct(F.col("path").alias("token"), F.lit(1.0).alias("w")), F.struct(base_name("path").alias("token"), F.lit(0.6).alias("w")), F.struct(file_stem("path").alias("token"), F.lit(0.3).alias("w")))).alias("f")).select("path", "f.*")
    folders = p.select("path", F.explode(dir_prefixes("path")).alias("token"), F.lit(0.1).alias("w"))
    forms = forms.unionByName(folders).groupBy("path", "token").agg(F.max("w").alias("w"))
    share = forms.groupBy("token").agg(F.count("*").alias("n"))
    return m.join(forms, "token").join(share, "token").groupBy("doc_id", "path").agg(F.sum(F.col("w") / F.sqrt("n")).alias("weight"))


def why(links: DataFrame, entries: DataFrame, gone: DataFrame) -> DataFrame:
    """node, entry, level, superseded: the records behind a node, each once with its strongest level."""
    best = links.where("node <> '' and entry is not null").groupBy("node", "entry").agg(F.min("level").alias("level"))
    out = best.join(gone.select(F.col("doc_id").alias("entry"), F.lit(True).alias("s")), "entry", "left")
    return out.select("node", "entry", "level", F.coalesce("s", F.lit(False)).alias("superseded"))


def folder_proposals(links: DataFrame, files: DataFrame, *, least: int = 3, share: float = 0.2) -> DataFrame:
    """entry, dir, n: folders in which at least ``least`` and a ``share`` of the files that an entry links to lie, without folders that a deeper one with as many makes idle."""
    paths = links.where("path <> '' and entry is not null").select("entry", "path").distinct().join(files.select("path").distinct(), "path", "left_semi")
    total = paths.groupBy("entry").agg(F.count("*").alias("all"))
    counts = paths.select("entry", F.explode(dir_prefixes("path")).alias("dir")).groupBy("entry", "dir").agg(F.count("*").alias("n"))
    kept = counts.join(total, "entry").where((F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select("entry", "dir", "n")
    deeper = kept.select("entry", F.explode(dir_prefixes("dir")).alias("dir"), F.col("n").alias("n2")).groupBy("entry", "dir").agg(F.max("n2").alias("n2"))
    return kept.join(deeper, ["entry", "dir"], "left").where("n2 is null or n2 < n").select("entry", "dir", "n")
