"""Filling fixed-capacity containers with items.

The plan is made on the histogram of item sizes, which has at most as many entries as the capacity, however many items
there are: shallow combinations of sizes that fill a window below the capacity are enumerated, non-negative least squares tells
how often to repeat each, the counts are rounded down, and what is left is packed greedily, still by size and not by item.
Items then find their container by their running number among those of their size, in parallel.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import materialize, ship, shuffle_partitions

Pattern = dict[int, int]  # size -> how many of it in one container


def combinations(histogram: dict[int, int], capacity: int, *, window: int, limit: int) -> list[Pattern]:
    """Combinations of up to three distinct sizes, each repeated or not, that fill a container up to ``window`` below its capacity.

    ``limit`` bounds their number roughly; every size gets its share of them.
    """
    sizes = sorted(histogram)
    frequent = sorted(sizes, key=lambda s: (-histogram[s], s))
    out: dict[tuple, Pattern] = {}

    def put(*items: tuple[int, int]) -> None:
        p: Pattern = {}
        for s, n in items:
            if n > 0:
                p[s] = p.get(s, 0) + n
        if all(p[s] <= histogram[s] for s in p):
            out.setdefault(tuple(sorted(p.items())), p)

    def fit(room: int) -> int | None:
        k = bisect_right(sizes, room) - 1
        return sizes[k] if k >= 0 and sizes[k] >= room - window else None

    share = max(6, limit // max(1, len(sizes)))  # of each size, so that every size has patterns
    for a in sizes:
        before, most = len(out), capacity // a
        for n in range(most, 0, -1) if most <= 8 else (most, most - 1, most // 2, 2, 1):
            room = capacity - n * a
            if room <= window:
                put((a, n))
                continue
            if (b := fit(room)) is not None:
                put((a, n), (b, 1))
            if (b := fit(room // 2)) is not None and room - 2 * b <= window:
                put((a, n), (b, 2))
            for b in frequent[:12]:
                if b < room and (c := fit(room - b)) is not None:
                    put((a, n), (b, 1), (c, 1))
            if len(out) - before >= share:
                break
    return list(out.values())


def repeat_counts(histogram: dict[int, int], patterns: list[Pattern], rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: how often each pattern is to be repeated so that together they use up the histogram.

    Accelerated projected gradient steps over all patterns at once, each scaled by the diagonal of a matrix that bounds the normal matrix.
    """
    index = {s: k for k, s in enumerate(sorted(histogram))}
    wanted = np.array([float(histogram[s]) for s in sorted(histogram)])
    width = max(map(len, patterns))
    at, times = np.zeros((len(patterns), width), dtype=np.int64), np.zeros((len(patterns), width))
    for j, p in enumerate(patterns):
        at[j, : len(p)] = [index[s] for s in p]
        times[j, : len(p)] = list(p.values())
    flat = at.ravel()
    used = lambda v: np.bincount(flat, weights=(times * v[:, None]).ravel(), minlength=len(wanted))
    bound = (times * used(np.ones(len(patterns)))[at]).sum(axis=1)
    x = y = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(rounds):
        left = wanted - used(y)
        new = np.maximum(0.0, y + (times * left[at]).sum(axis=1) / bound)
        if ((new - x) * (y - new)).sum() > 0:  # overshot: start the acceleration anew
            pace = 1.0
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = np.maximum(0.0, new + (pace - 1) / after * (new - x))
        moved = float(np.abs(new - x).max(initial=0.0))
        x, pace = new, after
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], capacity: int, *, window: int | None = None, limit: int = 4000) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that use up the histogram exactly. Sizes are between 1 and the capacity."""
    left = {s: n for s, n in histogram.items() if n > 0}
    window = max(1, capacity // 64) if window is None else window
    patterns = combinations(left, capacity, window=window, limit=limit)
    out = []
    if patterns:
        wanted = repeat_counts(left, patterns)
        for j in np.argsort(-wanted, kind="stable"):
            times = min(int(wanted[j]), *(left.get(s, 0) // n for s, n in patterns[j].items()))
            if times > 0:
                out.append((patterns[j], times))
                for s, n in patterns[j].items():
                    left[s] -= n * times
                    if not left[s]:
                        del left[s]
    sizes = sorted(left)
    while sizes:  # greedy: the largest first, then the largest that still fits; whole groups of equal containers at once
        room, p, k = capacity, {}, len(sizes) - 1
        while k >= 0:
            s = sizes[k]
            n = min(left[s], room // s)
            if n:
                p[s], room = n, room - n * s
            k = min(k - 1, bisect_right(sizes, room) - 1)
        times = min(left[s] // n for s, n in p.items())
        out.append((p, times))
        for s, n in p.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.remove(s)
    return out


def segments(steps: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: starts of the running numbers that a plan step takes, how many of the size go to each container, first container."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    container = 0
    for p, times in steps:
        for s, n in p.items():
            rows.setdefault(s, []).append((taken.get(s, 0), n, container))
            taken[s] = taken.get(s, 0) + n * times
        container += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def numbered(items: DataFrame) -> DataFrame:
    """Items with ``rank``, their running number from 0 among those of their budget and size. A size that a third of all items have is
    numbered in as many parts as there are salts: each part on its own, moved on by the counts of the parts before."""
    salts = 4 * shuffle_partitions(items.sparkSession)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    counts = salted.groupBy("budget_id", "size", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("budget_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("budget_id", "size", "salt").orderBy("doc_id", "part")) - 1
    each = salted.withColumn("own", own).join(counts.select("budget_id", "size", "salt", before.alias("before")), ["budget_id", "size", "salt"])
    return each.select("budget_id", "doc_id", "part", "size", (F.col("own") + F.col("before")).alias("rank"))


_SEGMENTS = "budget_id long, size long, starts array<long>, times array<long>, first array<long>"


def plans(histograms: DataFrame) -> DataFrame:
    """budget_id, size, starts, times, first: the segments of the plan of each budget, each budget planned in a task of its own.

    ``histograms`` has budget_id, capacity, size and n: at most capacity - 1 rows to a budget, however many items there are.
    """
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        steps = plan(dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), int(rows["capacity"].iloc[0]))
        segs = segments(steps)
        return pd.DataFrame({"budget_id": rows["budget_id"].iloc[0], "size": list(segs), "starts": [v[0] for v in segs.values()], "times": [v[1] for v in segs.values()], "first": [v[2] for v in segs.values()]})

    return histograms.groupBy("budget_id").applyInPandas(one, _SEGMENTS)


def fill_all(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, container, doc_id, part, tokens: every item in a container of each capacity.

    ``sizes`` has doc_id and n_tokens, one row per item. An item above the capacity is split into full parts, each a container of
    its own (``f`` and its doc_id and part), and a rest, part 0 of no other item is ever split. Items of size 0 or null need no room:
    their container is null. Containers of several items are ``p0``, ``p1``, ... Budgets are a handful of settings; those without a capacity are left out.
    Empty tables give no rows.
    """
    import pandas as pd

    spark = sizes.sparkSession
    ship(spark)
    schema = "budget_id long, container string, doc_id long, part int, tokens long"
    caps = sorted({(r["budget_id"], r["capacity_tokens"]) for r in budgets.where("budget_id is not null and capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().collect()})
    if not caps:
        return spark.createDataFrame([], schema)
    sizes = materialize(sizes.select("doc_id", "n_tokens"), "sizes")
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in caps]))
    rows = sizes.withColumn("b", each).select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "b.*")
    some = rows.where("n_tokens > 0")
    full = some.where("n_tokens >= capacity").select("budget_id", "doc_id", "capacity", F.explode(F.expr("sequence(0, int(n_tokens div capacity) - 1)")).alias("part"))
    full = full.select("budget_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.col("part").cast("string")).alias("container"), "doc_id", "part", F.col("capacity").alias("tokens"))
    rest = some.select("budget_id", "capacity", "doc_id", F.expr("int(n_tokens div capacity)").alias("part"), F.expr("n_tokens % capacity").alias("size")).where("size > 0")
    histograms = rest.groupBy("budget_id", "capacity", "size").agg(F.count("*").alias("n"))
    # a row per size, as in the histograms
    table = {(r["budget_id"], r["size"]): tuple(np.array(r[c], dtype=np.int64) for c in ("starts", "times", "first")) for r in plans(histograms).collect()}
    segs = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = np.empty(len(b), dtype=np.int64)
            budget, size, rank = (b[c].to_numpy() for c in ("budget_id", "size", "rank"))
            order = np.lexsort((size, budget))
            cuts = np.flatnonzero(np.diff(budget[order]) | np.diff(size[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                starts, times, first = segs.value[int(budget[own[0]]), int(size[own[0]])]
                k = np.searchsorted(starts, rank[own], side="right") - 1
                where[own] = first[k] + (rank[own] - starts[k]) // times[k]
            yield pd.DataFrame({"budget_id": b["budget_id"], "container": ["p%d" % w for w in where], "doc_id": b["doc_id"], "part": b["part"], "tokens": b["size"]})

    packed = numbered(rest).mapInPandas(place, schema)
    empty = rows.where("n_tokens <= 0").select("budget_id", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("tokens"))
    return full.unionByName(packed).unionByName(empty)


def fill_containers(sizes: DataFrame, capacity: int) -> DataFrame:
    """container, doc_id, part, tokens: :func:`fill_all` for one capacity."""
    budgets = sizes.sparkSession.createDataFrame([(0, capacity)], "budget_id long, capacity_tokens long")
    return fill_all(sizes, budgets).drop("budget_id")
