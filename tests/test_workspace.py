from loamgraph.operators import workspace as W
from loamgraph.streaming.sessions import sessions


def paths(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "path string")


def test_scopes(spark, rows):
    got = rows(W.discover_scopes(paths(spark, "package.json", "a/package.json", "a/b/Cargo.toml", "c/d/go.mod", "c/d/pom.xml", "x/y/z/go.mod", "e/readme")))
    assert got == [("a", ["package.json"]), ("c/d", ["go.mod", "pom.xml"])]


def test_bindings(spark, rows):
    uses = spark.createDataFrame([(1, "f", "x", ["top", "fn"]), (2, "f", "x", ["top"]), (3, "f", "y", ["top", "fn"]), (4, "f", "z", ["top"])], "use_id long, path string, name string, scopes array<string>")
    bind = spark.createDataFrame([("f", "top", "x", "A"), ("f", "fn", "x", "B"), ("f", "fn", "y", "C"), ("f", "fn", "y", "D"), ("f", "top", "y", "E")], "path string, scope string, name string, type string")
    assert rows(W.nearest_bindings(uses, bind)) == [(1, "B"), (2, "A")]


def test_single_language_imports(spark, rows):
    files = paths(spark, "svc/a/x.go", "svc/a/b_test.go", "svc/a/b.go", "svc/main.go", "src/a/b/C.java", "lib/q/C.java", "inc/u.h", "src/v.h", "src/main.c")
    imports = spark.createDataFrame([(1, "host/m/a"), (2, "host/m"), (3, "other/x")], "ref_id long, spec string")
    modules = spark.createDataFrame([("host", "zzz"), ("host/m", "svc")], "module string, folder string")
    assert rows(W.go_imports(imports, modules, files)) == [(1, "svc/a/b.go"), (2, "svc/main.go")]
    refs = spark.createDataFrame([(1, "a/b/C.java"), (2, "zz/C.java"), (3, "w/q/C.java")], "ref_id long, tail string")
    assert rows(W.tail_imports(refs, files)) == [(1, "src/a/b/C.java"), (3, "lib/q/C.java")]
    inc = spark.createDataFrame([(1, "src/main.c", "v.h"), (2, "src/main.c", "u.h"), (3, "src/main.c", "../inc/u.h"), (4, "src/main.c", "none.h")], "ref_id long, path string, spec string")
    assert rows(W.includes(inc, files)) == [(1, "src/v.h"), (2, "inc/u.h"), (3, "inc/u.h")]


def test_pages_and_lookup(spark, rows):
    exact = spark.createDataFrame([("q", f"e{k:02}", float(20 - k)) for k in range(12)], "query string, path string, score double")
    ranked = spark.createDataFrame([("q", f"r{k:02}", float(90 - k)) for k in range(55)] + [("q", "e11", 100.0)], "query string, path string, score double")
    got = {p: n for _, p, n in rows(W.paged(exact, ranked))}
    assert got["e00"] == 1 and got["e10"] == 2 and got["e11"] == 1 and got["r48"] == 1 and got["r49"] == 2 and len(got) == 67
    n = spark.createDataFrame([("a", "Load", "function", "src/x.py", 1, 2, True), ("b", "load", "function", "tests/x.py", 1, 2, True), ("c", "load", "function", "src/y.py", 1, 2, False)], "id string, name string, kind string, path string, start_line int, end_line int, exported boolean")
    d = spark.createDataFrame([("c", 3)], "target string, in_degree long")
    assert [r["id"] for r in W.definition_lookup(n, d, "load").collect()] == ["c", "b", "a"]


def test_inline_tests_and_context(spark, rows):
    n = spark.createDataFrame([("t", "TestX", "class", "tests/a.py", 1, 9, True), ("m", "run", "method", "tests/a.py", 2, 3, True), ("f", "test_y", "function", "tests/b.py", 1, 2, True), ("g", "test_z", "function", "src/b.py", 1, 2, True)], "id string, name string, kind string, path string, start_line int, end_line int, exported boolean")
    assert rows(W.inline_tests(n)) == [("f",), ("m",), ("t",)]
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    files = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, hash string")
    assert rows(W.context_check(manifest, files, n, spark.createDataFrame([("f",)], "id string"))) == [(1, 1, 0.25)]


def test_sessions_stream_equals_batch(spark, rows, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, t + timedelta(minutes=m), 1.0) for m in (0, 10, 35, 90)] + [(2, t, 2.0), (None, t, 1.0), (3, None, 1.0)], "user_id long, ts timestamp_ntz, value double")
    batch = rows(sessions(df), "user_id", "n", "total")
    assert batch == [(1, 1, 1.0), (1, 3, 3.0), (2, 1, 2.0), (None, 1, 1.0)]
    df.write.parquet(f"{tmp_path}/in")
    stream = sessions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table("sessions_out"), "user_id", "n", "total")
    assert set(got) <= set(batch)  # the last sessions wait for the watermark
