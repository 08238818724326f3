"""Freshness: drift between snapshots, carried-over meaning, replacement by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RACY_MS = 2000.0  # a file written this close to the walk may change again without a new stat


def drift(before: DataFrame, now: DataFrame, *, walked_ms: float | None = None) -> DataFrame:
    """path, change (``added``, ``removed``, ``changed``): full outer diff of two listings (path, size, mtime_ms, hash).

    Equal size and mtime are trusted, except within two seconds of the walk; a new stat with an equal hash is no drift.
    A null hash on either side leaves the stat to decide.
    """
    b = before.select("path", F.lit(1).alias("b"), F.col("size").alias("b_size"), F.col("mtime_ms").alias("b_mtime"), F.col("hash").alias("b_hash"))
    n = now.select("path", F.lit(1).alias("n"), "size", "mtime_ms", "hash")
    both = b.join(n, "path", "full_outer")
    stat = F.col("b_size").eqNullSafe(F.col("size")) & F.col("b_mtime").eqNullSafe(F.col("mtime_ms"))
    if walked_ms is not None:
        stat = stat & ~(F.abs(F.col("mtime_ms") - walked_ms) <= RACY_MS)
    same = F.coalesce(F.col("b_hash") == F.col("hash"), stat) | stat & (F.col("b_hash").isNull() | F.col("hash").isNull())
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(~same, "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def carry_over(prior: DataFrame, now: DataFrame) -> DataFrame:
    """id, summary, state: a prior summary is kept, ``ready`` where the body hash is the same, else ``stale``; without one ``pending``."""
    p = prior.where("summary is not null").select("id", "summary", F.col("body_hash").alias("p_hash"))
    rows = now.select("id", "body_hash").join(p, "id", "left")
    state = F.when(F.col("summary").isNull(), "pending").when(F.col("p_hash").eqNullSafe(F.col("body_hash")), "ready").otherwise("stale")
    return rows.select("id", "summary", state.alias("state"))


def check(before: DataFrame, now: DataFrame) -> DataFrame:
    """id, status (``added``, ``removed``, ``changed``, ``same``) by id and body hash."""
    b = before.select("id", F.lit(1).alias("b"), F.col("body_hash").alias("b_hash"))
    n = now.select("id", F.lit(1).alias("n"), F.col("body_hash").alias("n_hash"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b_hash").eqNullSafe(F.col("n_hash")), "same").otherwise("changed")
    return b.join(n, "id", "full_outer").select("id", status.alias("status"))


def check_counts(status: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: added, removed, changed, stale, pending and whether nothing drifted."""
    c = status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed")])
    m = nodes.where("kind <> 'file'").agg(*[F.count_if(F.col("summary_state") == s).alias(s) for s in ("stale", "pending")])
    return c.join(m).withColumn("ok", (F.col("added") + F.col("removed") + F.col("changed")) == 0)


def replay(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path, action: ``reuse`` where the cache holds the file's content hash, else ``parse``."""
    c = cache.select("path", F.col("hash").alias("c_hash")).distinct()
    hit = files.join(c, (files["path"] == c["path"]) & (F.col("hash") == F.col("c_hash")), "left")
    return hit.select(files["path"], F.when(F.col("c_hash").isNotNull(), "reuse").otherwise("parse").alias("action")).distinct()


def replace_paths(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """``old`` without the rows of the paths that ``new`` has, and ``new``: what a re-extraction of changed files leaves."""
    return old.join(new.select(path).distinct(), path, "left_anti").select(old.columns).unionByName(new.select(old.columns))
