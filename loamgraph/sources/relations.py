"""The canonical relations of the code graph over the tables of a data folder.

Every key is in canonical spelling, every row key occurs once. Nodes keep the last row of an id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions.keys import content_hash, path_key
from loamgraph.functions.text import tokens
from loamgraph.operators.spans import lines_of
from loamgraph.sources.tables import table

WALK = ["calls", "references", "imports", "implements", "extends"]


class Relations:
    """Lazily built relations; each is a plan, not a result."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def node_rows(self) -> DataFrame:
        """Every version of every node."""
        cols = ["node_key", path_key("id").alias("id"), "name", "kind", path_key("path").alias("path"), "start_line", "end_line", "signature", "exported", "origin", "body_hash", "chars", "body_text", "summary_state", "summary", "crux", "owner", "arity", "variadic", "first_seen", "removed_at"]
        return self.raw("nodes").select(*cols).where("node_key is not null and id <> ''").dropDuplicates(["node_key"])

    @cached_property
    def nodes(self) -> DataFrame:
        """One row per id: the version seen last (first_seen, then node_key)."""
        last = Window.partitionBy("id").orderBy(F.desc_nulls_last("first_seen"), F.desc("node_key"))
        return self.node_rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.nodes.where("kind <> 'file'")

    @cached_property
    def edges(self) -> DataFrame:
        cols = ["edge_id", path_key("source").alias("source"), path_key("target").alias("target"), "relation", "confidence", "ord", "seen_at"]
        return self.raw("edges").select(*cols).where("edge_id is not null and source <> '' and target <> ''").dropDuplicates(["edge_id"])

    @cached_property
    def walk(self) -> DataFrame:
        """Edges other than ``contains``."""
        return self.edges.where(F.col("relation").isin(WALK))

    @cached_property
    def files(self) -> DataFrame:
        cols = ["file_id", "prefix", path_key("path").alias("path"), "lang", "size", "mtime_ms", content_hash("hash").alias("hash"), "content"]
        return self.raw("source_files").select(*cols).where("file_id is not null and path <> ''").dropDuplicates(["file_id"])

    @cached_property
    def lines(self) -> DataFrame:
        """path, line (from 1), text of every source file."""
        return lines_of(self.files.where("content is not null"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents").where("doc_id is not null").dropDuplicates(["doc_id"])

    @cached_property
    def scopes(self) -> DataFrame:
        return self.raw("scopes").dropDuplicates(["prefix"])

    @cached_property
    def links(self) -> DataFrame:
        cols = ["link_id", "entry", "level", path_key("node").alias("node"), path_key("path").alias("path"), "line", "name", "via", "linked_at"]
        return self.raw("record_links").select(*cols).where("link_id is not null").dropDuplicates(["link_id"])

    def lexical(self, question: str) -> DataFrame:
        """The scores of all nodes for a question, from the index of the table; the first question builds it."""
        from loamgraph.operators.askindex import AskIndex

        return AskIndex.of(self.spark, f"{self.folder.rstrip('/')}/nodes.parquet", self.nodes).lexical(question)

    @cached_property
    def terms(self) -> DataFrame:
        """id, field (``name``, ``path``, ``body``), term, tf of every node."""
        fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(c).alias("terms")) for f, c in (("name", "name"), ("path", "path"), ("body", "body_text"))])
        each = self.nodes.select("id", F.explode(fields).alias("f")).select("id", "f.field", F.explode("f.terms").alias("term"))
        return each.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def term_bag(docs: DataFrame, id_col: str, text: str, field: str = "body") -> DataFrame:
    """id, field, term, tf of one text column."""
    each = docs.select(F.col(id_col).alias("id"), F.lit(field).alias("field"), F.explode(tokens(text)).alias("term"))
    return each.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))
