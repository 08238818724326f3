"""Aggregations: ownership, savings, sessions, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import half_life, round_tokens


def ownership(commits: DataFrame, *, now, half_days: float = 120.0, least: float = 0.15, top: int = 2) -> DataFrame:
    """area, person, score, share, n_commits, rank: decayed share of each person's distinct commits, the first ``top`` with at least ``least``.

    ``commits`` has area, person, sha, ts.
    """
    each = commits.select("area", "person", "sha", "ts").dropDuplicates(["area", "person", "sha"])
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    per = each.groupBy("area", "person").agg(F.sum(half_life(age, half_days)).alias("score"), F.count("*").alias("n_commits"))
    total = per.groupBy("area").agg(F.sum("score").alias("_t"))
    rows = per.join(total, "area").withColumn("share", F.col("score") / F.col("_t")).where(F.col("share") >= least)
    w = Window.partitionBy("area").orderBy(F.desc("score"), "person")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("area", "person", "score", "share", "n_commits", "rank")


def reviewers(scores: DataFrame, weights: DataFrame, top: int = 3) -> DataFrame:
    """person, total: weighted sum of a person's scores over areas, the first ``top``."""
    return scores.join(weights, "area").groupBy("person").agg(F.sum(F.col("score") * F.col("weight")).alias("total")).orderBy(F.desc("total"), "person").limit(top)


def savings(answers: DataFrame, files: DataFrame) -> DataFrame:
    """answer_id, saved_tokens: tokens of the distinct files an answer stands for less its own, not below 0.

    ``answers`` has answer_id, path, answer_chars; ``files`` path, chars.
    """
    base = answers.select("answer_id", "path").distinct().join(files.select("path", "chars"), "path").groupBy("answer_id").agg(F.sum("chars").alias("chars"))
    own = answers.groupBy("answer_id").agg(F.max("answer_chars").alias("answer_chars"))
    return own.join(base, "answer_id", "left").select("answer_id", F.greatest(F.lit(0), round_tokens(F.coalesce("chars", F.lit(0))) - round_tokens("answer_chars")).alias("saved_tokens"))


def daily_totals(sessions: DataFrame, last_day, days: int = 7) -> DataFrame:
    """day, n, total of the last ``days`` days, days without rows included with 0. ``sessions`` has ts and value."""
    calendar = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).alias("day"))
    per = sessions.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return calendar.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def hit_rate(events: DataFrame, key: str, hits: list[str], misses: list[str]) -> DataFrame:
    """key, rate: hits in percent of hits and misses; null where there were neither."""
    h, m = F.count_if(F.col("event_type").isin(hits)), F.count_if(F.col("event_type").isin(misses))
    return events.groupBy(key).agg((h * 100 / F.nullif(h + m, F.lit(0))).alias("rate"))


def scope_substance(nodes: DataFrame, scopes: DataFrame, least: int = 5) -> DataFrame:
    """prefix, n_symbols, folds: scopes with fewer than ``least`` symbols fold into the root."""
    per = nodes.where("kind <> 'file'").groupBy(F.substring_index("path", "/", 1).alias("prefix")).agg(F.count("*").alias("n_symbols"))
    return scopes.select("prefix").join(per, "prefix", "left").select("prefix", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols")).withColumn("folds", F.col("n_symbols") < least)


def parsed_savings(docs: DataFrame) -> DataFrame:
    """doc_id, saved: sum of ``~N tokens saved`` and ``~Nk tokens saved`` in a text."""
    parts = F.regexp_extract_all("text", F.lit(r"~([0-9.]+k?) tokens saved"), 1)
    value = F.aggregate(parts, F.lit(0.0), lambda acc, s: acc + F.regexp_replace(s, "k$", "").cast("double") * F.when(s.endswith("k"), 1000.0).otherwise(1.0))
    return docs.where("text is not null").select("doc_id", value.alias("saved")).where("saved > 0")


def normalize(scored: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``share``, the score over the maximum (of each group); 0 where the maximum is not positive."""
    best = scored.groupBy(*(by or [])).agg(F.max(score).alias("_m"))
    rows = scored.join(best, by) if by else scored.join(F.broadcast(best))
    return rows.withColumn("share", F.when(F.col("_m") > 0, F.col(score) / F.col("_m")).otherwise(F.lit(0.0))).drop("_m")


def first_and_last(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """key, first, last: values at the first and last moment, ties by value."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(at, value)).alias("first"), F.max_by(value, F.struct(at, value)).alias("last"))
