"""Warm refresh as Structured Streaming: versions of files arrive, the state keeps the newest of each path.

Every micro-batch is merged into the state by path and published as the next version of a target; a batch that is replayed after
a failure finds its number in the manifest and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions.keys import content_hash, path_key
from loamgraph.operators.incremental import VersionedTarget
from loamgraph.session import scratch_path


def newest(versions: DataFrame) -> DataFrame:
    """The newest version of each path: largest mtime_ms, then file_id."""
    w = Window.partitionBy("path").orderBy(F.desc_nulls_last("mtime_ms"), F.desc("file_id"))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


COMPACT = 32  # versions between two that hold everything


def merge_batch(target: VersionedTarget, batch: DataFrame, number: int) -> None:
    """Publish what a batch brings: the newest version of each of its paths, if the state has no newer one. The state itself is not
    rewritten but for a base now and then, so a batch costs its own rows and a look at the paths it names."""
    log = target.log()
    if log and log[-1]["note"]["batch"] >= number:
        return
    rows, held = newest(batch), target.read_all("state")
    if held is not None:
        known = newest(held.join(rows.select("path").distinct(), "path", "left_semi"))
        rank = F.struct(F.col("mtime_ms").isNotNull().alias("a"), F.col("mtime_ms").alias("b"), F.col("file_id").alias("c"))
        rows = rows.withColumn("_r", rank).join(known.select("path", rank.alias("_k")), "path", "left").where("_k is null or _r > _k").drop("_r", "_k")
    target.publish({"state": rows}, {"batch": number})
    if len(log) + 1 >= COMPACT:
        target.publish({"state": newest(target.read_all("state"))}, {"batch": number, "base": True})


def file_versions(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", path_key("path").alias("path"), content_hash("hash").alias("hash"), "size", "mtime_ms").where("file_id is not null and path <> ''")


def refresh_once(spark: SparkSession, folder: str, *, files_per_batch: int = 1000, root: str | None = None) -> DataFrame:
    """Run the stream over all files that are there, then stop; returns the state. A later call with the same root goes on from there."""
    root = root or scratch_path(spark, "refresh")
    target = VersionedTarget(spark, f"{root}/target")
    schema = spark.read.parquet(f"{folder.rstrip('/')}/source_files.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(f"{folder.rstrip('/')}/source_files.parquet*")
    query = (
        file_versions(source)
        .writeStream.foreachBatch(lambda batch, number: merge_batch(target, batch, number))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return newest(target.read_all("state"))
