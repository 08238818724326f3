"""Sinks: graph, postings, cards, context export. Commits are the file system's renames; versions are VersionedTarget's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet, range-sorted by Unicode collation of their keys, without body text."""
    nodes.drop("body_text").orderBy(F.collate("id", "UNICODE"), "id").write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    edges.orderBy(F.collate("source", "UNICODE"), "relation", F.collate("target", "UNICODE"), "edge_id").write.mode("overwrite").parquet(f"{folder}/edges.parquet")


def write_postings(terms: DataFrame, folder: str) -> None:
    """Postings by field, sorted by term in each file, so that a query's terms prune row groups."""
    terms.repartition("field", F.pmod(F.xxhash64("term"), F.lit(64))).sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(folder)


def cards(nodes: DataFrame) -> DataFrame:
    """path, card: one outline per file, a line per definition in order of the first line."""
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.coalesce("name", F.lit("?")), F.lit(" L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"))
    rows = nodes.where("kind <> 'file' and start_line is not null and end_line is not null").select("path", F.struct("start_line", "id", line.alias("text")).alias("s"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n").alias("card"))


def context_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, json: nodes and edges of a context graph as JSON lines; edges with a missing end are left out."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "name", "path")).alias("json"))
    ids = nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return n.unionByName(e.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "relation")).alias("json")))


def covers(concept_sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, covers: the exported symbols of a concept's sources, sorted. ``concept_sources`` has doc_id and path."""
    rows = concept_sources.join(nodes.where("kind <> 'file' and exported").select("path", "id"), "path")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("id")).alias("covers"))
