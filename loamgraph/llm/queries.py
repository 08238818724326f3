"""Queries p3 and p5 to p9 over whole tables, and the SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import documentation, handwritten, packing, quality, syntax, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documentation.documented(_table(spark, sf_dir, "source_files"), _table(spark, sf_dir, "nodes"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documentation.function_pairs(_table(spark, sf_dir, "source_files"), _table(spark, sf_dir, "nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_files(_table(spark, sf_dir, "source_files"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.fault_rates(_table(spark, sf_dir, "source_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_by_hand(_table(spark, sf_dir, "source_files"))


def p6_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.file_origins(_table(spark, sf_dir, "source_files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_all(tokens.count_tokens(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p8_containers(spark, sf_dir).where("container is not null").join(F.broadcast(_table(spark, sf_dir, "budgets").select("budget_id", "capacity_tokens").distinct()), "budget_id")
    each = rows.groupBy("budget_id", "capacity_tokens", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    return each.groupBy("budget_id", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / F.sum("capacity_tokens"), 6).alias("fill"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_table(spark, sf_dir, "documents"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "p3_found": p3_found, "p3_pairs": p3_pairs, "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_origins": p6_origins,
    "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_statistics": p9_statistics,
}
ORACLE: dict[str, str] = {}
