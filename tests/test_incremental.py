import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loamgraph.operators.incremental import IncrementalRun, VersionedTarget, changed_files, listed_files, ok_listings

SNAP = "snap_id long, run_id long, prefix string, path string, size long, mtime_ms double, hash string, loaded_at timestamp_ntz, version string, seq int"
RUN = "run_id long, prefix string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, path string"


def day(n):
    return datetime(2025, 1, n)


def tables(spark, snaps, runs):
    full = [(i, r, "p", path, size, m, h, day(1), "clash", 9) for i, (r, path, size, m, h) in enumerate(snaps)]
    return spark.createDataFrame(full, SNAP), spark.createDataFrame([(r, "p", at, at, st, "clash") for r, at, st in runs], RUN)


def test_changes_between_ok_runs_whatever_failed(spark, rows):
    snaps, runs = tables(
        spark,
        [(9, "p/a", 1, 1.0, "AA"), (9, "p/b", 1, 1.0, "bb"), (3, "p/a", 1, 1.0, "xx"), (5, "./p/a", 1, 1.0, "sha256:aa"), (5, "p\\b", 1, 1.0, "cc"), (5, " p/c ", 1, 1.0, "dd")],
        [(9, day(1), "ok"), (3, day(2), "failed"), (5, day(3), "ok")],
    )
    assert rows(changed_files(snaps, runs)) == [(5, "p/b"), (5, "p/c")]


def test_null_hash_takes_the_last_hash_of_any_run(spark, rows):
    snaps, runs = tables(spark, [(1, "p/a", 1, 1.0, "aa"), (2, "p/a", 1, 1.0, "bb"), (3, "p/a", 1, 1.0, None)], [(1, day(1), "ok"), (2, day(2), "aborted"), (3, day(3), "ok")])
    assert rows(changed_files(snaps, runs)) == [(3, "p/a")]


def test_file_that_was_away_comes_back(spark, rows):
    snaps, runs = tables(spark, [(1, "p/a", 1, 1.0, "aa"), (2, "p/b", 1, 1.0, "bb"), (3, "p/a", 1, 1.0, "aa")], [(1, day(1), "ok"), (2, day(2), "ok"), (3, day(3), "ok")])
    assert rows(changed_files(snaps, runs)) == [(2, "p/b"), (3, "p/a")]


def test_largest_snapshot_holds_and_repeated_rows_count_once(spark, rows):
    snaps, runs = tables(spark, [(1, "p/a", 1, 1.0, "aa"), (2, "p/a", 1, 1.0, "zz"), (2, "p/a", 1, 1.0, "aa")], [(1, day(1), "ok"), (2, day(2), "ok")])
    assert rows(changed_files(snaps.union(snaps), runs.union(runs))) == []


def test_one_publication_per_run_gives_the_same(spark, rows):
    listing = [(r, f"p/{k}", 1, 1.0, f"h{(r * k) % 3}") for r in range(1, 8) for k in range(5) if (r + k) % 4]
    snaps, runs = tables(spark, listing, [(r, day(r), "ok" if r != 4 else "failed") for r in range(1, 8)])
    assert rows(changed_files(snaps, runs, span=64)) == rows(changed_files(snaps, runs)) == rows(changed_files(snaps, runs, span=3))


def bring(spark, root, snaps, runs, span=1, most=None):
    """One call on a persistent root: what is processed, and the answer so far."""
    source = ok_listings(listed_files(snaps, runs), runs)
    run = IncrementalRun(VersionedTarget(spark, root), ["path"], group="prefix")
    return run, run.run(source, span, most)


def answer(run):
    return sorted((r.run_id, r.path) for r in run.changes().where("before is not null").collect())


def processed(run, versions):
    return sorted({(r.run_id, r.path) for v in versions for r in run.target.read("rows", v).collect()})


def test_uneven_groups_on_one_root(spark, rows, tmp_path):
    def some(listing, runs):
        full = [(k, r, p, f"{p}/{x}", 1, 1.0, h, day(1), "clash", 9) for k, (r, p, x, h) in enumerate(listing)]
        return spark.createDataFrame(full, SNAP), spark.createDataFrame([(r, p, day(d), day(d), "ok", "clash") for r, p, d in runs], RUN)

    listing = [(10 + k, "b", "f", f"h{k}") for k in range(4)] + [(1, "a", "f", "x"), (2, "a", "f", "x"), (1, "a", "g", "y"), (2, "a", "g", "y")]
    runs = [(10 + k, "b", 1 + k) for k in range(4)] + [(1, "a", 1), (2, "a", 2)]
    root = str(tmp_path / "t")
    run, out = bring(spark, root, *some(listing, runs))
    assert len(out) == 4 and answer(run) == [(11, "b/f"), (12, "b/f"), (13, "b/f")]
    more = listing + [(3, "a", "f", "new"), (3, "a", "g", "y"), (3, "a", "h", "z")]  # the third ok run of a group, when another has had four
    run, out = bring(spark, root, *some(more, [*runs, (3, "a", 3)]))
    assert len(out) == 1 and processed(run, out) == [(3, "a/f"), (3, "a/g"), (3, "a/h")]
    assert answer(run) == [(3, "a/f"), (3, "a/h"), (11, "b/f"), (12, "b/f"), (13, "b/f")]
    assert bring(spark, root, *some(more, [*runs, (3, "a", 3)]))[1] == []  # nothing new


def test_late_corrected_and_put_between(spark, rows, tmp_path):
    root = str(tmp_path / "t")
    runs = [(1, day(1), "ok"), (2, day(3), "ok"), (3, day(5), "ok")]
    first = [(1, "p/a", 1, 1.0, "aa"), (3, "p/a", 1, 1.0, "bb"), (3, "p/b", 1, 1.0, "cc"), (2, "p/b", 1, 1.0, "dd")]
    run, _ = bring(spark, root, *tables(spark, first, runs))
    assert answer(run) == [(2, "p/b"), (3, "p/a"), (3, "p/b")]
    # loaded late for run 2: the row itself is processed, and what run 3 listed of the same path is judged anew
    run, out = bring(spark, root, *tables(spark, late := [*first, (2, "p/a", 1, 1.0, "bb")], runs))
    assert processed(run, out) == [(2, "p/a"), (3, "p/a")] and answer(run) == [(2, "p/a"), (2, "p/b"), (3, "p/b")]
    # a larger snap_id corrects run 2
    run, out = bring(spark, root, *tables(spark, fixed := [*late, (2, "p/b", 1, 1.0, "cc")], runs))
    assert processed(run, out) == [(2, "p/b"), (3, "p/b")] and answer(run) == [(2, "p/a"), (2, "p/b")]
    # an ok run whose report came late stands between 2 and 3
    snaps, all_runs = tables(spark, [*fixed, (9, "p/a", 1, 1.0, "zz")], [*runs, (9, day(4), "ok")])
    run, out = bring(spark, root, snaps, all_runs)
    assert processed(run, out) == [(3, "p/a"), (3, "p/b"), (9, "p/a")]
    assert answer(run) == rows(changed_files(snaps, all_runs)) == [(2, "p/a"), (2, "p/b"), (3, "p/a"), (3, "p/b"), (9, "p/a")]
    run.compact()
    assert answer(run) == rows(changed_files(snaps, all_runs)) and bring(spark, root, snaps, all_runs)[1] == []
    assert run.target.vacuum() >= 0 and answer(run) == rows(changed_files(snaps, all_runs))


def test_any_order_of_loading_gives_the_same(spark, rows, tmp_path):
    rnd = random.Random(5)
    listing = [(r, f"p/{k}", 1, 1.0, rnd.choice(["h1", "h2", None])) for r in range(1, 7) for k in range(6) if rnd.random() < 0.7]
    runs = [(r, day(r), "failed" if r == 3 else "ok") for r in range(1, 7)]
    snaps, all_runs = tables(spark, listing, runs)
    loads = rnd.sample(range(len(listing)), len(listing))
    for cut in (9, 18, len(listing)):
        come = snaps.where(F.col("snap_id").isin(loads[:cut]))
        run, _ = bring(spark, str(tmp_path / "t"), come, all_runs, span=1 if cut != 18 else 2)
    assert answer(run) == rows(changed_files(snaps, all_runs)) == rows(changed_files(snaps, all_runs, span=9))


def test_a_call_that_dies_before_a_publication_skips_and_repeats_nothing(spark, rows, tmp_path, monkeypatch):
    snaps, runs = tables(spark, [(1, "p/a", 1, 1.0, "aa"), (2, "p/a", 1, 1.0, "bb"), (3, "p/a", 1, 1.0, "cc")], [(k, day(k), "ok") for k in (1, 2, 3)])
    root = str(tmp_path / "t")
    run, out = bring(spark, root, snaps, runs, most=1)
    assert out == [1]
    real = VersionedTarget._path

    def dies(self, rest):
        if rest.startswith("staged"):
            raise OSError("lost")
        return real(self, rest)

    monkeypatch.setattr(VersionedTarget, "_path", dies)
    with pytest.raises(OSError):
        bring(spark, root, snaps, runs)
    monkeypatch.undo()
    assert run.target.versions() == [1]
    run, out = bring(spark, root, snaps, runs)
    assert processed(run, out) == [(2, "p/a"), (3, "p/a")] and answer(run) == [(2, "p/a"), (3, "p/a")]
    assert run.target.vacuum() == 2 and answer(run) == [(2, "p/a"), (3, "p/a")]  # what the dead call had written


def test_a_number_is_published_once(spark, tmp_path):
    a, b = VersionedTarget(spark, str(tmp_path / "t")), VersionedTarget(spark, str(tmp_path / "t"))
    df = spark.range(3)
    assert a.publish({"x": df}) == 1
    b.versions = lambda: []
    with pytest.raises(RuntimeError):
        b.publish({"x": df})


def test_nulls_and_empty_tables(spark, rows):
    snaps, runs = tables(spark, [], [])
    assert rows(changed_files(snaps, runs)) == []
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None), (1, 1, None, None, None, None, None, None, None, None), (2, 2, None, "p/a", None, None, None, None, None, None)], SNAP)
    some = spark.createDataFrame([(1, "p", None, None, "ok", None), (2, "p", day(1), None, "ok", None), (None, None, None, None, None, None)], RUN)
    assert rows(changed_files(odd, some)) == []  # run 2 comes first, run 1 lists nothing


def test_scratch_is_cleaned(spark):
    from pathlib import Path

    from loamgraph.session import clean_scratch, materialize, shared_dir

    clean_scratch(spark)
    df = materialize(spark.range(5), "probe")
    assert df.count() == 5
    assert clean_scratch(spark) == 1 and not list(Path(shared_dir(spark)).glob("probe-*")) and clean_scratch(spark) == 0
