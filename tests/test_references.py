from datetime import datetime

from loamgraph.operators import references as R

NODE = "node_key long, id string, first_seen timestamp_ntz, removed_at timestamp_ntz, key string, delta int"
EDGE = "edge_id long, source string, target string, seen_at timestamp_ntz, loaded_at timestamp_ntz, period_end int"
LINK = "link_id long, node string, linked_at timestamp_ntz, live string"


def at(m, d=10):
    return datetime(2025, m, d)


def tables(spark, nodes, edges, links, modules=("mod:x",)):
    return (
        spark.createDataFrame([(*e, e[3], 0) for e in edges], EDGE),
        spark.createDataFrame([(*x, "") for x in links], LINK),
        spark.createDataFrame([(k, *n, "clash", 7) for k, n in enumerate(nodes)], NODE),
        spark.createDataFrame([(m, m) for m in modules], "module_id string, name string"),
    )


def test_missing_removed_late_and_reopened(spark, rows):
    nodes = [("a", at(1), None), ("b", at(2), None), ("c", at(1), at(3)), ("d", at(1), at(2)), ("d", at(4), None)]
    edges = [(1, "a", "b", at(1)), (2, "a", "b", at(2)), (3, "a", "c", at(2)), (4, "a", "c", at(3)), (5, "d", "mod:x", at(2)), (6, " ./d", "a", at(4)), (7, "nope", "", at(1))]
    got = rows(R.orphan_report(*tables(spark, nodes, edges, [(1, "zz", at(5)), (2, None, at(5)), (3, "a", at(5))])))
    assert got == [("edges", 1, "target", "2025-01"), ("edges", 4, "target", "2025-03"), ("edges", 5, "source", "2025-02"), ("edges", 7, "source", "2025-01"), ("record_links", 1, "node", "2025-05")]


def test_removed_at_the_end_of_the_month_still_counts(spark, rows):
    nodes = [("a", at(1), datetime(2025, 2, 1)), ("b", datetime(2025, 2, 1), None)]
    got = rows(R.orphan_report(*tables(spark, nodes, [(1, "a", "b", at(1)), (2, "a", "b", at(2))], [])))
    assert got == [("edges", 1, "target", "2025-01"), ("edges", 2, "source", "2025-02")]


def fed(spark, parts):
    state = R.OrphanState(spark)
    for nodes, edges, links in parts:
        state.advance(R.parent_rows(nodes), R.graph_references(edges, links))
    return state


def test_state_is_the_same_however_the_input_is_split_and_repeated(spark, rows):
    nodes = [("a", at(1), at(3)), ("b", at(2), None), ("a", at(5), None), ("c", at(4), at(6))]
    edges, links, n, m = tables(spark, nodes, [(k, "a", "b" if k % 3 else "c", at(1 + k % 6)) for k in range(20)], [(k, "c", at(k)) for k in range(1, 5)])
    whole = fed(spark, [(n, edges, links)])
    parts = [(n.where(f"node_key % 3 = {k}"), edges.where(f"edge_id % 3 = {2 - k}"), links.where(f"link_id % 3 = {k}")) for k in (2, 0, 1)]
    split = fed(spark, [*parts[:2], (n, edges.where("edge_id < 7"), links), parts[2], (n, edges, links)])
    assert rows(split.pending()) == rows(whole.pending()) and rows(split.orphans()) == rows(whole.orphans()) and rows(split.counts()) == rows(whole.counts())
    assert rows(split.sums().where("delta <> 0 or n_refs <> 0"), "key", "period_end", "delta", "n_refs") == rows(whole.sums(), "key", "period_end", "delta", "n_refs")
    assert rows(split.counts()) == rows(R.orphan_counts(edges, links, n, m.limit(0)))


def test_a_row_delivered_again_with_its_removal(spark, rows):
    edges, links, open_, _ = tables(spark, [("a", at(1), None)], [(1, "a", "a", at(3))], [])
    closed = tables(spark, [("a", at(1), at(2))], [], [])[2]
    none = edges.limit(0)
    for parts in ([(open_, edges, links), (closed, none, links)], [(closed, edges, links), (open_, none, links)], [(open_.union(closed), edges, links)]):
        state = fed(spark, parts)
        assert rows(state.orphans(), "ref_id", "ref_field") == [(1, "source"), (1, "target")]
        assert rows(state.counts()) == [("edges", "source", "2025-03", 1), ("edges", "target", "2025-03", 1)]


def test_a_call_touches_only_the_keys_of_its_batch(spark, rows, tmp_path):
    edges, links, n, _ = tables(spark, [("a", at(1), None), ("b", at(6), None)], [(k, "a", f"g{k}", at(1)) for k in range(30)] + [(99, "b", "a", at(2))], [])
    root = str(tmp_path / "t")
    R.OrphanState(spark, root).advance(R.parent_rows(n.where("id = 'a'")), R.graph_references(edges, links))
    state = R.OrphanState(spark, root)  # another process, the same root
    state.advance(R.parent_rows(tables(spark, [("zz", at(1), None), ("zz", at(1), None), ("b", at(1), None)], [], [])[2].where("node_key = 2")), R.graph_references(edges, links))
    assert rows(state.target.read("log"), "key", "delta") == [("b", 1)] and rows(state.target.read("refs")) == []
    assert rows(state.orphans(), "ref_id") == [(k,) for k in sorted(range(30), key=lambda k: repr((k,)))]


def test_transitions(spark, rows):
    edges, links, n, _ = tables(spark, [("a", at(2), at(4)), ("a", at(6), None)], [(1, "a", "a", at(1)), (2, "a", "x", at(5))], [])
    got = rows(R.orphan_transitions(edges, links, n))
    assert got == [("a", "2025-02", "resolved", 2), ("a", "2025-04", "reopened", 2), ("a", "2025-06", "resolved", 3)]


def test_hot_key_takes_the_broadcast_path(spark, rows):
    edges = [(k, "ghost" if k % 2 else f"g{k}", "a", at(1)) for k in range(400)]
    got = R.orphan_report(*tables(spark, [("a", at(1), None)], edges, []))
    assert got.count() == 400


def test_nulls_repeats_and_empty_tables(spark, rows):
    e, k, n, m = tables(spark, [], [], [], modules=())
    assert rows(R.orphan_report(e, k, n, m)) == []
    e, k, n, m = tables(spark, [(None, None, None), ("a", None, None), ("a", at(3), at(2))], [(None, None, None, None), (1, "a", None, None), (2, "a", "a", at(1)), (2, "a", "a", at(1))], [(None, None, None)], modules=(None,))
    assert rows(R.orphan_report(e, k, n, m)) == [("edges", 2, "source", "2025-01"), ("edges", 2, "target", "2025-01")]
    assert rows(R.orphan_counts(e, k, n, m)) == [("edges", "source", "2025-01", 1), ("edges", "target", "2025-01", 1)]
