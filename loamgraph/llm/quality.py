"""Per-document text quality statistics, judged against the distribution of the document's language.

Statistics are computed once per text. Mergeable quantile sketches of each statistic, one per language and their merge for all,
turn values into percentile ranks and robust z-scores; values in the tails that speak against prose are flagged and counted. Three
tails decide that a document is no natural prose, none that it is; with one or two the exact share of its characters
that stand in running sentences decides.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.prose import STATISTICS, statistics
from loamgraph.session import materialize, ship

# The least spread of each statistic, so that a corpus of equal values has no infinite scores.
SPREAD = {
    "n_chars": 50.0, "n_words": 10.0, "mean_word_length": 0.2, "symbol_ratio": 0.01, "digit_ratio": 0.005, "punctuated_lines": 0.1, "common_words": 0.03, "sentence_share": 0.05, "repeated_lines": 0.02,
    "word_tokens": 0.02, "words_per_line": 1.0,
}
# Robust z-scores beyond which a value lies in a tail that prose does not reach; None where that side is no sign.
TAILS = {"mean_word_length": (-3.5, 3.5), "symbol_ratio": (None, 3.5), "digit_ratio": (None, 8.0), "common_words": (-3.0, None), "repeated_lines": (None, 8.0), "word_tokens": (-5.0, None), "words_per_line": (None, 5.0)}
LOW_SHARE = 0.1  # punctuated lines: values up to this quantile are a tail, as their spread is too wide for scores
DECIDING = 3  # so many tails decide without a further check


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang_found and the statistics of every document with a text beyond white space; rows of the same doc_id are one row.

    The language is found in the text, as the column is unreliable. Null, empty and blank texts give no row. Whole texts are read.
    """
    import pandas as pd

    ship(documents.sparkSession)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s[0], *s[1]) for i, s in zip(b["doc_id"], map(statistics, b["text"]), strict=True) if s]
            yield pd.DataFrame(rows, columns=["doc_id", "lang_found", *STATISTICS])

    schema = "doc_id long, lang_found string, " + ", ".join(f"{s} double" for s in STATISTICS)
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(measure, schema).dropDuplicates(["doc_id"])


def quantile_sketches(stats: DataFrame) -> DataFrame:
    """lang_found and a KLL sketch per statistic; sketches of several corpora or days merge with ``kll_merge_agg_double``."""
    return stats.groupBy("lang_found").agg(*[F.kll_sketch_agg_double(s).alias(s) for s in STATISTICS])


def _quantiles(sketches: DataFrame, prefix: str, shares: tuple[float, ...]) -> list:
    return [F.kll_sketch_get_quantile_double(F.col(s), F.lit(q)).alias(f"{prefix}_{s}_{round(100 * q)}") for s in STATISTICS for q in shares]


def _merged(sketches: DataFrame) -> DataFrame:
    return sketches.agg(*[F.kll_merge_agg_double(s).alias(s) for s in STATISTICS])


def centres(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lowest tenth and median of each statistic: a row per language, and one row for all."""
    shares = (LOW_SHARE, 0.5)
    merged = _merged(sketches)
    return sketches.select("lang_found", *_quantiles(sketches, "own", shares)), merged.select(*_quantiles(merged, "all", shares))


def scores(stats: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """The statistics with ``z_<statistic>`` (robust z-score in the document's language), ``za_<statistic>`` (among all), ``tail_<statistic>`` and ``tails``.

    A robust z-score is the distance from the median over 1.4826 times the median absolute deviation; both medians come
    from sketches, of the values and then of the deviations. A value lies in a tail beyond :data:`TAILS` in its language, or
    among all where no language was found; punctuated lines up to the lowest tenth are a tail as well. ``tails`` counts them without ``tail_sentence_share``
    (a low share), which alone calls for a check. ``sketches`` of the values may come from another corpus. There is a sketch per
    language, so at most six rows are broadcast.
    """
    own, every = centres(quantile_sketches(stats) if sketches is None else sketches)
    wide = stats.join(F.broadcast(own), "lang_found").join(F.broadcast(every))
    near = wide.select("lang_found", *[F.abs(F.col(s) - F.col(f"{p}_{s}_50")).alias(f"{p}_{s}") for s in STATISTICS for p in ("own", "all")])
    sketch = [F.kll_sketch_agg_double(f"{p}_{s}").alias(f"{p}_{s}") for s in STATISTICS for p in ("own", "all")]
    per = near.groupBy("lang_found").agg(*sketch)
    own_mad = per.select("lang_found", *[F.kll_sketch_get_quantile_double(f"own_{s}", F.lit(0.5)).alias(f"own_{s}_mad") for s in STATISTICS])
    whole = per.agg(*[F.kll_merge_agg_double(f"all_{s}").alias(s) for s in STATISTICS])
    all_mad = whole.select(*[F.kll_sketch_get_quantile_double(s, F.lit(0.5)).alias(f"all_{s}_mad") for s in STATISTICS])
    wide = wide.join(F.broadcast(own_mad), "lang_found").join(F.broadcast(all_mad))
    found = F.col("lang_found") != "other"

    def score(prefix: str, s: str):
        return (F.col(s) - F.col(f"{prefix}_{s}_50")) / F.greatest(1.4826 * F.col(f"{prefix}_{s}_mad"), F.lit(SPREAD[s]))

    out, tails = [], []
    for s in STATISTICS:
        z, za = score("own", s), score("all", s)
        out += [F.round(z, 4).alias(f"z_{s}"), F.round(za, 4).alias(f"za_{s}")]
        judged = F.when(found, z).otherwise(za)
        if s in TAILS:
            low, high = TAILS[s]
            tails.append(((judged < low) if low is not None else F.lit(False)) | ((judged > high) if high is not None else F.lit(False)))
        elif s == "punctuated_lines":
            tails.append(F.col(s) <= F.when(found, F.col(f"own_{s}_{round(100 * LOW_SHARE)}")).otherwise(F.col(f"all_{s}_{round(100 * LOW_SHARE)}")))
        else:
            continue
        out.append(tails[-1].alias(f"tail_{s}"))
    out.append((F.least(score("own", "sentence_share"), score("all", "sentence_share")) < -3.5).alias("tail_sentence_share"))
    return wide.select("doc_id", "lang_found", *STATISTICS, *out, sum(t.cast("int") for t in tails).alias("tails"))


def judged_prose(scored: DataFrame) -> DataFrame:
    """The scored documents with ``is_prose`` and ``decided_by``: ``tails``, ``no tail`` or ``sentences``."""
    checked = (F.col("tails") > 0) | F.col("tail_sentence_share")
    prose = F.when(F.col("tails") >= DECIDING, F.lit(False)).when(checked, F.col("sentence_share") >= 0.5).otherwise(True)
    by = F.when(F.col("tails") >= DECIDING, "tails").when(checked, "sentences").otherwise("no tail")
    return scored.withColumns({"is_prose": prose, "decided_by": by})


def not_prose(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that are not natural prose: three tails or more, or any tail and less than half of the text in running sentences."""
    return judged_prose(scores(materialize(document_statistics(documents), "text-statistics"))).where(~F.col("is_prose")).select("doc_id")


def scored_documents(documents: DataFrame) -> DataFrame:
    return judged_prose(scores(materialize(document_statistics(documents), "text-statistics")))
