"""Processing only new or changed records: the target is the state.

Every target row carries the key and version of the source record it stands for. A call anti-joins the source against the target; what
is left are the records nobody has processed, however late they were loaded and whatever run or group they belong to. They are
processed in the order of their runs and published with the next target version in one atomic step, so a call that dies before a
publication leaves the old version in place, and the next call finds exactly what is missing. There is no watermark beside the data.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions.keys import content_hash, path_key
from loamgraph.session import materialize, scratch_path


class VersionedTarget:
    """A table of immutable versions below one folder of the shared file system.

    Data of a version are written first, to a folder of a random name. The version exists once its manifest, a small file
    ``manifest/<number>.json``, is there: it is written under another name and renamed, and the rename fails if the
    number is taken. Folders that no manifest names are ignored.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self._hadoop.Path(f"{self.root}/{rest}" if rest else self.root)

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"manifest/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, part: str, version: int | None = None) -> DataFrame | None:
        """A named part of a version (the last one by default); None if there is none."""
        known = self.versions()
        if not known:
            return None
        folder = self.manifest(known[-1] if version is None else version)["parts"].get(part)
        return None if folder is None else self.spark.read.parquet(f"{self.root}/{folder}")

    def log(self) -> list[dict]:
        """Manifests in order, from the last one that is a base (its parts hold all that came before) on."""
        known = [self.manifest(v) for v in self.versions()]
        base = max((k for k, m in enumerate(known) if m["note"].get("base")), default=0)
        return known[base:]

    def read_all(self, part: str, numbered: str | None = None) -> DataFrame | None:
        """The union of a part over all versions since the last base; ``numbered`` names a column for the version of each row."""
        found = [(m["version"], f) for m in self.log() if (f := m["parts"].get(part))]
        if not found:
            return None
        if numbered is None:  # one scan of many folders
            return self.spark.read.parquet(*[f"{self.root}/{f}" for _, f in found])
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/{f}").withColumn(numbered, F.lit(v)) for v, f in found])

    def stage(self, name: str, df: DataFrame, by: list[str] | None = None) -> str:
        """Write rows to a folder that no manifest names yet; parts of later versions may name it or folders in it."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, parts: dict[str, DataFrame | str], note: dict | None = None) -> int:
        """Write the parts (a folder's name stands for rows that are already written) and make them the next version, all or nothing."""
        known = self.versions()
        version = known[-1] + 1 if known else 1
        folders = {name: df if isinstance(df, str) else self.stage(f"{name}-{version:08d}", df) for name, df in parts.items()}
        staged = self._path(f"staged/{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps({"version": version, "parts": folders, "note": note or {}}).encode()))
        out.close()
        self._fs.mkdirs(self._path("manifest"))
        final = self._path(f"manifest/{version:08d}.json")
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise RuntimeError(f"version {version} was published by another run")
        return version

    def vacuum(self) -> int:
        """Delete folders that a call which died left behind; returns their number. Not to be run beside a writer."""
        if not self._fs.exists(self._path("data")):
            return 0
        named = {f.split("/")[1] for v in self.versions() for f in self.manifest(v)["parts"].values()}
        lost = [s.getPath() for s in self._fs.listStatus(self._path("data")) if s.getPath().getName() not in named]
        return sum(self._fs.delete(p, True) for p in lost)


def changed_since(source: DataFrame, target: DataFrame | None, keys: list[str], *, run: str, before: str, version: str) -> DataFrame:
    """Rows of ``source`` whose (keys, version) the target does not hold for the run before theirs; versions compare null-safe."""
    if target is None:
        return source
    cols = [*keys, run, version]
    held = target.select(*[F.col(c).alias(f"_h_{c}") for c in cols])
    match = (F.col(f"_h_{run}") == F.col(before)) & F.col(f"_h_{version}").eqNullSafe(F.col(version))
    for c in keys:
        match = match & (F.col(f"_h_{c}") == F.col(c))
    return source.join(held, match, "left_anti")


class IncrementalRun:
    """Drives a source of listings into a :class:`VersionedTarget`.

    The source has a row per key and run: keys, run, ``before`` (the run that it follows, null for the first), ``seq`` (the place of
    the run in its group), version. Sources grow and are corrected; rows are not taken back. A version of the target has two parts: ``rows``, the source records it stands
    for, and ``changes``, those of them that are new or changed since the run before. A record counts as processed if
    the target has a row of the same key, run, ``before`` and version. So a record that came late, a corrected one, and
    all of a run that another was put before are found by one anti-join; the records of the run after a late one are
    judged anew with it. Rows of a later version replace those of the same key and run.
    """

    def __init__(self, target: VersionedTarget, keys: list[str], *, group: str, run: str = "run_id", before: str = "before", seq: str = "seq", version: str = "version"):
        self.target, self.keys, self.group, self.run_col, self.before, self.seq, self.version = target, keys, group, run, before, seq, version

    @property
    def _id(self) -> list[str]:
        return [self.run_col, *self.keys]

    def _restated(self) -> bool:
        return any(m["note"].get("restates") for m in self.target.log())

    def rows(self) -> DataFrame | None:
        """The records that the target stands for."""
        if not self._restated():
            return self.target.read_all("rows")
        every = self.target.read_all("rows", numbered="_v")
        others = [c for c in every.columns if c not in [*self._id, "_v"]]
        return every.groupBy(*self._id).agg(F.max_by(F.struct(*others), "_v").alias("_s")).select(*self._id, "_s.*")

    def changes(self) -> DataFrame | None:
        """The records that are new or changed since the run before theirs, as far as the source has been processed."""
        if not self._restated():
            return self.target.read_all("changes")
        last = self.target.read_all("rows", numbered="_v").groupBy(*self._id).agg(F.max("_v").alias("_v"))
        return self.target.read_all("changes", numbered="_v").join(last, [*self._id, "_v"], "left_semi").drop("_v")

    def pending(self, source: DataFrame) -> tuple[DataFrame, bool]:
        """Source records to process, and whether some stand for records that the target has already."""
        held = self.rows()
        if held is None:
            return source, False
        ours = held.select(*[F.col(c).alias(f"_h_{c}") for c in [*self._id, self.before, self.version]])
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_h_{c}") for c in self._id])
        same = same & F.col(self.before).eqNullSafe(F.col(f"_h_{self.before}")) & F.col(self.version).eqNullSafe(F.col(f"_h_{self.version}"))
        fresh = materialize(source.join(ours, same, "left_anti"), "fresh")  # read three times
        # what follows a fresh record was judged without it
        touched = fresh.select(*self.keys, F.col(self.run_col).alias(self.before)).withColumn("_fresh", F.lit(True))
        after = source.join(touched.drop("_fresh"), [*self.keys, self.before], "left_semi").join(fresh.select(*self._id), self._id, "left_anti")
        todo = fresh.unionByName(after)
        return todo, not todo.join(held.select(*self._id), self._id, "left_semi").isEmpty()

    def run(self, source: DataFrame, span: int = 1, most: int | None = None) -> list[int]:
        """Process what the target does not hold yet, run after run of every group; returns the versions published.

        A publication takes ``span`` of the runs of each group that have something to process; ``most`` ends the call after so many
        publications, the next goes on from there. Nothing new: publishes nothing.
        """
        todo, restates = self.pending(source)
        place = Window.partitionBy(self.group).orderBy(self.seq)
        runs = todo.groupBy(self.group, self.seq).agg(F.count("*").alias("n")).withColumn("_k", F.ceil(F.row_number().over(place) / span).cast("int"))
        turn = runs.select(F.col(self.group).alias("_g"), F.col(self.seq).alias("_s"), "_k")
        own = todo.join(turn, F.col(self.group).eqNullSafe(F.col("_g")) & (F.col(self.seq) == F.col("_s"))).drop("_g", "_s")
        staged = self.target.stage("rows", own, by=["_k"])  # written once; each publication names its folder
        spark, out = source.sparkSession, []
        turns = sorted(r[0] for r in spark.read.parquet(f"{self.target.root}/{staged}").select("_k").distinct().collect()) if self._any(staged) else []
        for k in turns[:most]:
            folder = f"{staged}/_k={k}"
            new = spark.read.schema(own.drop("_k").schema).parquet(f"{self.target.root}/{folder}")
            held = self.rows() if span == 1 else self._with(new)
            changes = changed_since(new, held, self.keys, run=self.run_col, before=self.before, version=self.version)
            out.append(self.target.publish({"rows": folder, "changes": changes}, {"restates": restates}))
        return out

    def _any(self, folder: str) -> bool:
        path = self.target._path(folder)
        return any(s.isDirectory() for s in self.target._fs.listStatus(path))

    def _with(self, new: DataFrame) -> DataFrame:
        """The held records with the new ones in place of those of the same key and run."""
        held, cols = self.rows(), [*self._id, self.version]
        new = new.select(cols)
        return new if held is None else held.select(cols).join(new.select(*self._id), self._id, "left_anti").unionByName(new)

    def compact(self) -> int:
        """Publish all that holds now as one base version, so that later calls read no history."""
        return self.target.publish({"rows": self.rows(), "changes": self.changes()}, {"base": True})


def listed_files(snapshots: DataFrame, build_runs: DataFrame) -> DataFrame:
    """One row per file that a run listed: prefix, run_id, status, run_seq, path, version.

    Spelling of paths and hashes is canonical; of several rows of a path in a run the one with the largest snap_id holds;
    rows with the same snap_id are one row. A null hash takes the hash of the file's last hashed row in the order of the
    prefix's runs (started_at, then run_id; null last); with none before, the stat stands in, prefixed ``stat:``, so it
    equals no hash. Rows of unknown runs and blank paths are left out.
    """
    order = F.struct(F.col("started_at").isNull(), "started_at", "run_id")
    runs = build_runs.select("run_id", "prefix", "started_at", "status").dropDuplicates(["run_id"])
    runs = runs.where(F.col("run_id").isNotNull()).withColumn("run_seq", F.row_number().over(Window.partitionBy("prefix").orderBy(order)))
    held = (
        snapshots.select("run_id", "snap_id", path_key("path").alias("path"), content_hash("hash").alias("hash"), "size", "mtime_ms")
        .where("run_id is not null and path <> ''")
        .groupBy("run_id", "path")
        .agg(F.max_by(F.struct("hash", "size", "mtime_ms"), F.coalesce("snap_id", F.lit(-1))).alias("s"))
    )
    rows = held.join(runs.select("run_id", "prefix", "status", "run_seq"), "run_id").select("prefix", "run_id", "status", "run_seq", "path", "s.*")
    known = F.last("hash", ignorenulls=True).over(Window.partitionBy("prefix", "path").orderBy("run_seq"))
    stat = F.concat_ws(":", F.lit("stat"), F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce(F.col("mtime_ms").cast("string"), F.lit("")))
    return rows.select("prefix", "run_id", "status", "run_seq", "path", F.coalesce(known, stat).alias("version"))


def ok_listings(listed: DataFrame, build_runs: DataFrame) -> DataFrame:
    """Listings of the ``ok`` runs: prefix, run_id, before (the ok run of the prefix before it, null for the first), seq (1, 2, ... per prefix), path, version."""
    runs = build_runs.where("status = 'ok'").select("run_id", "prefix", "started_at").dropDuplicates(["run_id"])
    order = Window.partitionBy("prefix").orderBy(F.struct(F.col("started_at").isNull(), "started_at", "run_id"))
    runs = runs.select("run_id", F.lag("run_id").over(order).alias("before"), F.row_number().over(order).alias("seq"))
    return listed.where("status = 'ok'").join(runs, "run_id").select("prefix", "run_id", "before", "seq", "path", "version")


def replay_ok_runs(snapshots: DataFrame, build_runs: DataFrame, root: str | None = None, span: int = 1) -> IncrementalRun:
    """Bring a target up to date with the ok runs of every prefix, ``span`` of each prefix's runs to a publication.

    ``root`` is the target's folder; a call with the folder of an earlier one processes only what has come since.
    """
    spark = snapshots.sparkSession
    root = root or scratch_path(spark, "incremental")
    source = materialize(ok_listings(listed_files(snapshots, build_runs), build_runs), "listings")  # read several times
    run = IncrementalRun(VersionedTarget(spark, root), ["path"], group="prefix")
    run.run(source, span)
    return run


def changed_files(snapshots: DataFrame, build_runs: DataFrame, root: str | None = None, span: int = 1) -> DataFrame:
    """run_id, path: for each ok run but the first of its prefix, the files that are new or changed since the ok run before.

    Empty tables give no rows.
    """
    changes = replay_ok_runs(snapshots, build_runs, root, span).changes()
    if changes is None:
        return snapshots.sparkSession.createDataFrame([], "run_id long, path string")
    return changes.where("before is not null").select("run_id", "path").distinct()
