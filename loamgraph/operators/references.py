"""References to records that do not exist: keyed pending-orphan state, kept up to date batch by batch.

The state is a :class:`VersionedTarget` with four parts. ``parents`` and ``refs`` hold the newest statement of each parent row and referring row
by row key, so a row that is delivered again changes nothing and one that is delivered again with a removal replaces what it said
before. ``log`` holds what each batch changed per key and period: parents that became live less those removed, and references
made; it only ever grows, and sums of it are the index that references probe. ``pending`` holds the (key, period) pairs whose
references dangle. A batch touches only its own keys: arriving parents resolve waiting orphans, removals reopen them, whatever the
order of the batches. Rows are pre-aggregated to (key, period) before they meet, so a key with a third of all references costs a
row per period, not a hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions.keys import path_key
from loamgraph.operators.incremental import VersionedTarget
from loamgraph.session import materialize, scratch_path, shuffle_partitions

PARENT = ["row"]
REFERRING = ["ref_table", "ref_id"]
GROUP = ["key", "period_end", "ref_table", "ref_field"]


def period_end(col: str | Column):
    """First moment after the month of a timestamp; null stays null."""
    return F.add_months(F.trunc(col, "month"), 1)


def parent_rows(nodes: DataFrame, *, id_col: str = "id", key_col: str = "node_key", born: str = "first_seen", gone: str = "removed_at") -> DataFrame:
    """row, is_gone, gone, born, key: what each parent row says; the order of the columns ranks statements of the same row, a removal outweighs none.

    Rows without a row key are left out.
    """
    rows = nodes.where(F.col(key_col).isNotNull())
    return rows.select(F.col(key_col).cast("long").alias("row"), F.col(gone).isNotNull().alias("is_gone"), F.col(gone).cast("timestamp_ntz").alias("gone"), F.col(born).cast("timestamp_ntz").alias("born"), path_key(id_col).alias("key"))


def referring_rows(df: DataFrame, table: str, id_col: str, fields: list[str], at: str) -> DataFrame:
    """ref_table, ref_id, period_end, refs (ref_field and key of each non-blank reference) of the rows that refer to something.

    Rows without an id or a time have no place and are left out.
    """
    refs = F.filter(F.array(*[F.struct(F.lit(f).alias("ref_field"), path_key(f).alias("key")) for f in fields]), lambda r: r["key"] != "")
    rows = df.where(F.col(at).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("ref_id"), period_end(at).alias("period_end"), refs.alias("refs"))
    return rows.where("size(refs) > 0").select(F.lit(table).alias("ref_table"), "ref_id", "period_end", "refs")


def graph_references(edges: DataFrame, record_links: DataFrame) -> DataFrame:
    """All references of the code graph: ``source`` and ``target`` of edges, ``node`` of record links."""
    return referring_rows(edges, "edges", "edge_id", ["source", "target"], "seen_at").unionByName(referring_rows(record_links, "record_links", "link_id", ["node"], "linked_at"))


def _newest(rows: DataFrame, ids: list[str], content: list[str]) -> DataFrame:
    """One row per row key: the greatest of its statements, which does not depend on the order of delivery."""
    return rows.groupBy(*ids).agg(F.max(F.struct(*content)).alias("now"))


def _parent_steps(rows: DataFrame, state: str, sign: int) -> DataFrame:
    """key, period_end, delta: arrival and removal of each parent. Without a birth there is none; an interval that ends at or before its start is empty."""
    p = rows.select(f"{state}.*").where("key <> '' and born is not null and (gone is null or gone > born)")
    steps = F.array(F.struct(period_end("born").alias("period_end"), F.lit(sign).cast("long").alias("delta")), F.struct(period_end("gone").alias("period_end"), F.lit(-sign).cast("long").alias("delta")))
    none = F.lit(None).cast("string")
    return p.select("key", F.explode(steps).alias("s")).where("s.period_end is not null").select("key", "s.period_end", none.alias("ref_table"), none.alias("ref_field"), "s.delta", F.lit(0).cast("long").alias("n_refs"))


def _reference_steps(rows: DataFrame, state: str, sign: int) -> DataFrame:
    each = rows.where(F.col(state).isNotNull()).select("ref_table", F.col(f"{state}.period_end").alias("period_end"), F.explode(f"{state}.refs").alias("r"))
    return each.select("r.key", "period_end", "ref_table", "r.ref_field", F.lit(0).cast("long").alias("delta"), F.lit(sign).cast("long").alias("n_refs"))


def live_sums(log: DataFrame) -> DataFrame:
    """key, period_end, ref_table, ref_field, delta, n_refs, live: the log summed up, with the parents live at the end of each period.

    One shuffle by key serves the sums and the running sum; a key has a row per period, field and version.
    """
    sums = log.repartition("key").groupBy(*GROUP).agg(F.sum("delta").alias("delta"), F.sum("n_refs").alias("n_refs"))
    return sums.withColumn("live", F.sum("delta").over(Window.partitionBy("key").orderBy("period_end")))  # peers of a period included


def pending_of(sums: DataFrame) -> DataFrame:
    """key, period_end, ref_table, ref_field, n_refs of the references whose key was not live at the end of their period."""
    return sums.where("n_refs > 0 and live <= 0").select(*GROUP, "n_refs")


class OrphanState:
    """The pending-orphan state below a root; a call on the root of an earlier one goes on from there."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.target = VersionedTarget(spark, root or scratch_path(spark, "orphans"))

    def _rows(self, part: str, ids: list[str]) -> DataFrame | None:
        """ids and ``now`` of every row so far."""
        rows = self.target.read_all(part)
        if rows is None or not any(m["note"].get(f"restates_{part}") for m in self.target.log()):
            return rows if rows is None else rows.select(*ids, "now")
        return rows.groupBy(*ids).agg(F.max("now").alias("now"))

    def _stage(self, part: str, batch: DataFrame, ids: list[str]) -> tuple[str, DataFrame | None]:
        """Write the rows of a batch that the state does not hold in these words; of those that say otherwise than before also what was said.

        Rows meet by their keys and a hash of what they say, so what is held is not moved as a whole.
        """
        content = [c for c in batch.columns if c not in ids]
        new, held = _newest(batch, ids, content), self._rows(part, ids)
        if held is None:
            return self.target.stage(part, new.withColumn("known", F.lit(False))), None
        both = new.join(held.select(*ids, F.xxhash64("now").alias("_old")), ids, "left").where(F.col("_old").isNull() | (F.col("_old") != F.xxhash64("now")))
        folder = self.target.stage(part, both.select(*ids, "now", F.col("_old").isNotNull().alias("known")))
        again = self._read(folder).where("known")
        if again.isEmpty():
            return folder, None
        return folder, materialize(again.select(*ids, "now").join(held.withColumnRenamed("now", "was"), ids).where(F.col("now") > F.col("was")), "restated")

    def _read(self, folder: str) -> DataFrame:
        return self.target.spark.read.parquet(f"{self.target.root}/{folder}")

    def advance(self, parents: DataFrame, refs: DataFrame) -> int:
        """Take in a batch of parent rows (:func:`parent_rows`) and referring rows (:func:`referring_rows`); returns the version published.

        Rows may be late, repeated, or state again what an earlier batch said: splitting and repeating the input in any way gives the same state.
        """
        (p, p_again), (r, r_again) = self._stage("parents", parents, PARENT), self._stage("refs", refs, REFERRING)
        steps = _parent_steps(self._read(p).where("not known"), "now", 1).unionByName(_reference_steps(self._read(r).where("not known"), "now", 1))
        for said, to_steps in ((p_again, _parent_steps), (r_again, _reference_steps)):
            if said is not None:  # the later statement in place of the earlier one
                steps = steps.unionByName(to_steps(said, "now", 1)).unionByName(to_steps(said, "was", -1))
        log = steps.groupBy(*GROUP).agg(F.sum("delta").alias("delta"), F.sum("n_refs").alias("n_refs")).where("delta <> 0 or n_refs <> 0")
        staged = self.target.stage("log", log)
        log, before, waiting = self._read(staged), self.target.read_all("log"), self.target.read("pending")
        if before is None:
            pending = pending_of(live_sums(log))
        else:  # only the keys of the batch are summed up again
            touched = log.select("key").distinct()
            pending = pending_of(live_sums(before.join(touched, "key", "left_semi").unionByName(log))).unionByName(waiting.join(touched, "key", "left_anti"))
        return self.target.publish({"parents": p, "refs": r, "log": staged, "pending": pending}, {"restates_parents": p_again is not None, "restates_refs": r_again is not None})

    def sums(self) -> DataFrame:
        """The summed log: see :func:`live_sums`."""
        return live_sums(self.target.read_all("log"))

    def pending(self, known: DataFrame | None = None) -> DataFrame:
        """The dangling (key, period, table, field) groups and their number of references; ``known`` keys always exist."""
        rows = self.target.read("pending")
        return rows if known is None else rows.join(known, "key", "left_anti")

    def orphans(self, known: DataFrame | None = None) -> DataFrame:
        """ref_table, ref_id, ref_field, key, period_end: every reference whose key was not live at the end of its period.

        Groups that hold more than one part in 4 x partitions of all references are joined by broadcast: there are at most 4 x
        partitions of them, whatever the data. All others meet in a shuffle without a hot key.
        """
        log, keys = self.target.read_all("log"), ["key", "period_end"]
        total = log.agg(F.sum("n_refs")).first()[0] or 0
        hot = max(1, total // (4 * shuffle_partitions(self.target.spark)))
        heavy = F.broadcast(log.where(F.col("n_refs") > hot).select(keys).distinct().withColumn("_hot", F.lit(True)))
        refs = self._rows("refs", REFERRING).select("ref_table", "ref_id", F.col("now.period_end").alias("period_end"), F.explode("now.refs").alias("r"))
        refs = refs.select("ref_table", "ref_id", "r.ref_field", "r.key", "period_end").join(heavy, keys, "left")
        waiting = self.pending(known).select(keys).distinct().join(heavy, keys, "left")
        usual = refs.where("_hot is null").join(waiting.where("_hot is null").select(keys), keys, "left_semi")
        few = refs.where("_hot").join(F.broadcast(waiting.where("_hot").select(keys)), keys, "left_semi")
        return usual.unionByName(few).drop("_hot")

    def counts(self, known: DataFrame | None = None) -> DataFrame:
        """ref_table, ref_field, period, n_orphans: the snapshot of the counts, from the state alone."""
        return self.pending(known).groupBy("ref_table", "ref_field", month_of("period_end").alias("period")).agg(F.sum("n_refs").alias("n_orphans"))

    def transitions(self) -> DataFrame:
        """key, period, event, n_refs: ``resolved`` where a key came to be live in a period, so that the ``n_refs`` references of earlier periods, which
        all dangled at the end of the one before, stand; ``reopened`` where it was gone again, so that they dangle. Keys without earlier references are left out."""
        per = self.sums().groupBy("key", "period_end").agg(F.sum("n_refs").alias("n"), F.max("live").alias("live"))
        w = Window.partitionBy("key").orderBy("period_end")
        rows = per.withColumn("was", F.coalesce(F.lag("live").over(w), F.lit(0))).withColumn("n_refs", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        event = F.when((F.col("was") <= 0) & (F.col("live") > 0), "resolved").when((F.col("was") > 0) & (F.col("live") <= 0), "reopened")
        return rows.select("key", month_of("period_end").alias("period"), event.alias("event"), "n_refs").where("event is not null and n_refs > 0")


def month_of(col: str) -> Column:
    return F.date_format(F.add_months(col, -1), "yyyy-MM")


def replayed(edges: DataFrame, record_links: DataFrame, nodes: DataFrame, root: str | None = None) -> OrphanState:
    """The state of the whole code graph, taken in as it came: first all that was loaded up to the middle of the time that the edges
    span, when later removals were not known yet, then what has come since, with those removals stated again."""
    state = OrphanState(edges.sparkSession, root)
    span = edges.agg(F.min("seen_at").alias("a"), F.max("seen_at").alias("b")).select(F.expr("timestampadd(SECOND, int(least(2000000000L, timestampdiff(SECOND, a, b) div 2)), a)").cast("timestamp_ntz").alias("t")).first()[0]
    refs = lambda e, k: graph_references(e, k)
    if span is None:
        state.advance(parent_rows(nodes), refs(edges, record_links))
        return state
    early = lambda c: F.coalesce(F.col(c) <= F.lit(span), F.lit(False))
    first = nodes.where(early("first_seen")).withColumn("removed_at", F.when(early("removed_at"), F.col("removed_at")))
    state.advance(parent_rows(first), refs(edges.where(early("loaded_at")), record_links.where(early("linked_at"))))
    rest = nodes.where(~early("first_seen") | (F.col("removed_at").isNotNull() & ~early("removed_at")))
    state.advance(parent_rows(rest), refs(edges.where(~early("loaded_at")), record_links.where(~early("linked_at"))))
    return state


def module_keys(modules: DataFrame) -> DataFrame:
    return modules.select(path_key("module_id").alias("key")).where("key is not null").distinct()


def orphan_report(edges: DataFrame, record_links: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """ref_table, ref_id, ref_field, period (``YYYY-MM``): every reference to a key that did not exist at the end of its month."""
    rows = replayed(edges, record_links, nodes).orphans(module_keys(modules))
    return rows.select("ref_table", "ref_id", "ref_field", month_of("period_end").alias("period"))


def orphan_counts(edges: DataFrame, record_links: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """ref_table, ref_field, period, n_orphans: the periodic snapshot of the counts."""
    return replayed(edges, record_links, nodes).counts(module_keys(modules))


def orphan_transitions(edges: DataFrame, record_links: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, period, event, n_refs: what became of the references to each key: see :meth:`OrphanState.transitions`."""
    return replayed(edges, record_links, nodes).transitions()
