"""Queries p1, p2 and p4 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import drift, incremental, references
from loamgraph.plans import oracle_core
from loamgraph.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changed_files(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "build_runs"))


def _graph(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("edges", "record_links", "nodes", "modules")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(*_graph(spark, sf_dir))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_counts(*_graph(spark, sf_dir))


def p2_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_transitions(*_graph(spark, sf_dir)[:3])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "build_records"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "build_records"))


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.schema_versions(table(spark, sf_dir, "build_records"))
    return rows.select("stream", "first_record_id", "first_written_at", "n_records", F.size("steps").alias("n_steps"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_counts": p2_counts, "p2_transitions": p2_transitions, "p4_found": p4_found, "p4_table": p4_table, "p4_versions": p4_versions}
ORACLE = {"p1_found": oracle_core.P1_FOUND, "p2_found": oracle_core.P2_FOUND, "p2_counts": oracle_core.P2_COUNTS, "p2_transitions": oracle_core.P2_TRANSITIONS, "p4_found": oracle_core.P4_FOUND, "p4_versions": oracle_core.P4_VERSIONS, "p4_table": oracle_core.P4_TABLE}
