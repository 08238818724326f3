import json
from datetime import datetime, timedelta

from loamgraph.operators import drift as D

REC = "record_id long, stream string, prefix string, written_at timestamp_ntz, payload string, fields string"


def records(spark, payloads, stream="s"):
    t = datetime(2025, 1, 1)
    return spark.createDataFrame([(k + 1, stream, "p", t + timedelta(hours=k), p, "clash") for k, p in enumerate(payloads)], REC)


def test_every_kind_of_change(spark, rows):
    p = ['{"version":1,"files":2}', '{"ver":2,"files":2,"note":"x"}', '{"ver":2,"note":"x","files":"2"}', '{"ver":2,"files":"2","walkedAtMs":5}', '{"ver":2.0,"files":"2","walkedAtMs":5}']
    assert rows(D.schema_changes(records(spark, p))) == [("s", 2, "note", "added"), ("s", 2, "ver", "renamed"), ("s", 3, "files", "retyped"), ("s", 4, "note", "removed"), ("s", 4, "walkedAtMs", "added"), ("s", 5, "ver", "retyped")]


def test_same_type_but_another_meaning_is_no_rename(spark, rows):
    assert rows(D.schema_changes(records(spark, ['{"totalCount":1}', '{"walkedAtMs":1}']))) == [("s", 2, "totalCount", "removed"), ("s", 2, "walkedAtMs", "added")]
    assert rows(D.schema_changes(records(spark, ['{"nodeCount":1}', '{"node_count":"1"}']))) == [("s", 2, "nodeCount", "removed"), ("s", 2, "node_count", "added")]


def test_null_keeps_the_type(spark, rows):
    assert rows(D.schema_changes(records(spark, ['{"a":1}', '{"a":null}', '{"a":2}', '{"a":null}', '{"a":"x"}']))) == [("s", 5, "a", "retyped")]
    assert rows(D.schema_changes(records(spark, ['{"a":null}', '{"a":2}']))) == []


def test_what_is_no_object_is_skipped(spark, rows):
    p = ['{"a":1}', None, "null", "[]", '{"a":1,"b"', '"x"', '{"a":1} tail', '{"a":1},{"c":1}', "", '{"a":1,"b":2}']
    assert rows(D.schema_changes(records(spark, p))) == [("s", 10, "b", "added")]


def test_hot_stream_over_many_partitions_equals_a_plain_loop(spark, rows):
    import random

    rnd, payloads = random.Random(1), []
    now = {"version": 1, "nodeCount": 5}
    for _ in range(600):
        if rnd.random() < 0.2:
            k = rnd.choice(["version", "ver", "nodeCount", "node_count", "nodes", "x", "y"])
            if k in now:
                del now[k]
            else:
                now[k] = rnd.choice([1, "s", None, 2.5])
        if rnd.random() < 0.1 and now:
            now[rnd.choice(list(now))] = rnd.choice([None, 1, "t", [1], {"z": 1}, True])
        payloads.append(json.dumps(now))
    kind = lambda v: None if v is None else {bool: "boolean", int: "integer", float: "decimal", str: "string", list: "array", dict: "object"}[type(v)]
    want, prev = [], None
    for k, p in enumerate(payloads):
        schema = {f: kind(v) for f, v in json.loads(p).items()}
        if prev is None:
            prev = schema
        else:
            changes, prev = D.compare(prev, schema)
            want += [("s", k + 1, f, c) for f, c in changes]
    df = records(spark, payloads).union(records(spark, ['{"q":1}', '{"r":1}'], "t").selectExpr("record_id + 10000", "stream", "prefix", "written_at", "payload", "fields"))
    got = rows(D.schema_changes(df))
    assert [g for g in got if g[0] == "s"] == sorted(want, key=repr)
    assert [g for g in got if g[0] == "t"] == [("t", 10002, "q", "removed"), ("t", 10002, "r", "added")]


def test_repeats_nulls_long_and_empty(spark, rows):
    df = records(spark, ['{"a":1}', '{"b":1}'])
    assert rows(D.schema_changes(df.union(df))) == [("s", 2, "a", "removed"), ("s", 2, "b", "added")]
    assert rows(D.schema_changes(df.limit(0))) == []
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, None, None, None, '{"a":1}', None), (2, "s", None, None, '{"a":1}', None), (3, "s", None, datetime(2025, 1, 1), json.dumps({f"f{k}": k for k in range(3000)}), None)], REC)
    assert D.schema_changes(odd).count() == 3001


def test_consistent_table(spark, rows):
    p = ['{"version":1,"languages":["a"],"wiringMtimeMs":5}', '{"ver":"2","langs":"b","mtime":6.5,"host":{"x":1}}', '{"version":{"major":3}}']
    got = rows(D.consistent_table(records(spark, p)), "record_id", "version", "languages", "wiring_mtime_ms", "extras")
    assert got == [(1, 1, ["a"], 5.0, "{}"), (2, 2, ["b"], 6.5, '{"host":{"x":1}}'), (3, None, None, None, '{"version":{"major":3}}')]


def test_second_name_of_a_field_stays_in_the_extras(spark, rows):
    got = rows(D.consistent_table(records(spark, ['{"ver":1,"version":2}', '{"edges":3,"edge_count":4}'])), "version", "edge_count", "extras")
    assert got == [(2, None, '{"ver":1}'), (None, 4, '{"edges":3}')]


def test_versions_and_their_steps(spark):
    p = ['{"version":1}', '{"schema_version":"1"}', '{"schema_version":"2"}', '{"version":1}', None]
    got = {r.first_record_id: r for r in D.schema_versions(records(spark, p)).collect()}
    assert {k: r.n_records for k, r in got.items()} == {1: 2, 2: 2}
    assert [x for x in got[2].steps if not x.startswith("default")] == ["rename schema_version to ver", "rename ver to version", "cast version from string to integer"]
    assert "default files to null" in got[1].steps and not [x for x in got[1].steps if x.startswith(("rename", "cast"))]
    assert D.schema_versions(records(spark, p).limit(0)).count() == 0


def test_an_object_is_no_string(spark, rows):
    got = rows(D.consistent_table(records(spark, ['{"extractor":{"name":"native"}}', '{"extractor":"native"}'])), "extractor", "extras")
    assert got == [("native", "{}"), (None, '{"extractor":{"name":"native"}}')]
