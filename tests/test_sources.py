import codecs

import pytest
from pyspark.sql import functions as F

from loamgraph.api import Graph
from loamgraph.operators import answers
from loamgraph.sources import repository as S
from loamgraph.sources import sinks


def test_walk_and_decode(spark, rows, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.txt": codecs.BOM_UTF16_LE + "hé".encode("utf-16-le"), "src/c.txt": codecs.BOM_UTF16_BE + b"\0x", "src/d.txt": b"a\xffb", "node_modules/e.js": b"1", ".git/f": b"1", "big.bin": b"0" * (S.MAX_BYTES + 1)}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = S.decode_source(S.walk(spark, {"one": str(tmp_path)}))
    assert rows(got, "child", "path", "text") == [("one", "src/a.py", "x = 1\n"), ("one", "src/b.txt", "hé"), ("one", "src/c.txt", None), ("one", "src/d.txt", "a�b")]
    assert rows(S.walk(spark, {"one": str(tmp_path)}, exclude=["src"]), "path") == []
    assert rows(S.walk(spark, {"one": str(tmp_path)}, only_dirs=["src"], include=["src/a.py"]), "path") == [("src/a.py",)]


def test_languages(spark):
    df = spark.createDataFrame([("a.d.ts",), ("A.PY",), ("x.blade.php",), ("Makefile",), (None,)], "path string")
    assert [r[0] for r in df.select(S.language("path")).collect()] == ["typescript", "python", "blade", None, None]


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def f\n+a\n@@ -9 +12 @@\n-b\n+c\n--- a/y\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"


def test_diffs(spark, rows):
    assert rows(S.diff_ranges(spark.createDataFrame([(1, DIFF), (2, None)], "diff_id long, text string"))) == [(1, "x.py", 12, 12), (1, "x.py", 3, 6)]
    assert rows(S.diff_files(spark.createDataFrame([(1, "A\ta.py\nR090\tb.py\tc.py\nD\td\nM\te\n")], "diff_id long, text string"))) == [(1, "added", None, "a.py"), (1, "deleted", None, "d"), (1, "modified", None, "e"), (1, "renamed", "b.py", "c.py")]


def test_commit_log(spark, rows):
    log = "\x01s1\x022025-01-01T00:00:00+00:00\x02Ann\x021+ann-x@users.noreply.host.com\n\na.py\nb.py\n\x01s2\x022025-01-02T00:00:00+00:00\x02renovate[bot]\x02r@x\n\nc.py\n"
    got = S.commit_log(spark.createDataFrame([(1, log)], "log_id long, text string"))
    assert rows(got, "sha", "person", "path", S.handle_of("email").alias("h")) == [("s1", "Ann", "a.py", "ann-x"), ("s1", "Ann", "b.py", "ann-x")]


def test_concepts_scripts_and_shell(spark, rows):
    text = "---\ntitle: \"The cache\"\nsources:\n  - src/a.py\n  - src/b.py\nlinks: [x, y]\n---\n# Head\n\nFirst prose line.\n"
    assert rows(S.concept_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))) == [(1, "The cache", ["src/a.py", "src/b.py"], ["x", "y"], "First prose line.")]
    page = "<html>\n<script>\nlet a = 1\n</script>\n<p>\n<SCRIPT type='x'>let b</SCRIPT>\n"
    assert rows(S.script_blocks(spark.createDataFrame([("p.vue", page)], "path string, text string"))) == [("p.vue", 2, "\nlet a = 1\n"), ("p.vue", 6, "let b")]
    lines = spark.createDataFrame([("a.sh", 1, "build() {"), ("a.sh", 2, "function clean {"), ("a.sh", 3, "  echo x()"), ("a.py", 4, "f() {")], "path string, line int, text string")
    assert rows(S.shell_functions(lines)) == [("a.sh", 1, "build"), ("a.sh", 2, "clean")]


def test_sinks(spark, rows, tmp_path):
    n = spark.createDataFrame([("b", "b", "function", "p", 2, 3, "x", True), ("_a", "a", "function", "p", 1, 1, "x", False), ("p", "p", "file", "p", 1, 9, None, True)], "id string, name string, kind string, path string, start_line int, end_line int, body_text string, exported boolean")
    e = spark.createDataFrame([(1, "b", "_a", "calls"), (2, "b", "gone", "calls")], "edge_id long, source string, target string, relation string")
    sinks.write_graph(n, e, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/nodes.parquet")
    assert "body_text" not in back.columns and back.count() == 3 and spark.read.parquet(f"{tmp_path}/edges.parquet").count() == 2
    assert rows(sinks.cards(n)) == [("p", "- function a L1-L1\n- function b L2-L3")]
    assert sinks.context_json(n, e).where("kind = 'edge'").count() == 1
    sinks.write_postings(spark.createDataFrame([("a", "name", "x", 1)], "id string, field string, term string, tf long"), f"{tmp_path}/post")
    assert spark.read.parquet(f"{tmp_path}/post").where("field = 'name'").count() == 1


@pytest.mark.parametrize("text,want", [(None, 1), ("", 1), ("3", 3), ("2.9", 2), ("0", 1), ("all", None), ("MAX", None)])
def test_depths(text, want):
    assert answers.parse_depth(text) == want


def test_small_kernels():
    with pytest.raises(ValueError):
        answers.parse_depth("deep")
    assert answers.structural_intent("who calls parse_row?") == ("in", ["parse_row"])
    assert answers.structural_intent("what does Loader.run call")[0] == "out" and answers.structural_intent("where is the cache") is None
    assert answers.coarsen({"a/b/c": 1, "a/b": 2, "a": 5, "d": 1}, 2) == {"a": 8, "d": 1} and answers.coarsen({}, 2) == {}
    assert len(answers.plan_id("x")) == 8


def test_annotated_rows(spark, rows):
    s = spark.createDataFrame([("a.py", 1, 9, "a.py#f", 1)], "path string, start_line int, end_line int, id string, node_key long")
    df = spark.createDataFrame([(1, "a.py:3: x"), (2, "free text"), (3, "b.py:1:y")], "row_id long, row string")
    assert rows(answers.annotate_rows(df, s)) == [(1, "a.py", 3, "a.py#f"), (2, None, None, None), (3, "b.py", 1, None)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    code = "def load_cache(x):\n    return parse_row(x)\n\ndef parse_row(x):\n    raise ValueError('stale cache')\n"
    n = "node_key long, id string, name string, kind string, path string, start_line int, end_line int, signature string, exported boolean, origin string, body_hash string, chars long, body_text string, summary_state string, summary string, crux struct<code:string,start_line:int,end_line:int>, owner string, arity int, variadic boolean, first_seen timestamp_ntz, removed_at timestamp_ntz"
    node = lambda k, i, name, kind, a, b, body: (k, i, name, kind, "p/cache.py", a, b, None, True, "ast", str(k), 1, body, "pending", None, None, None, 1, None, None, None)
    spark.createDataFrame([node(1, "p/cache.py", "cache.py", "file", 1, 5, None), node(2, "p/cache.py#load_cache", "load_cache", "function", 1, 2, "load cache"), node(3, "p/cache.py#parse_row", "parse_row", "function", 4, 5, "stale cache")], n).write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([(1, "p/cache.py#load_cache", "./p/cache.py#parse_row", "calls", "extracted", 1, None, None)], "edge_id long, source string, target string, relation string, confidence string, ord long, seen_at timestamp_ntz, loaded_at timestamp_ntz").write.parquet(f"{folder}/edges.parquet")
    spark.createDataFrame([(1, "p", "p/cache.py", "python", 1, 1.0, "aa", None, None, code)], "file_id long, prefix string, path string, lang string, size long, mtime_ms double, hash string, error string, broken boolean, content string").write.parquet(f"{folder}/source_files.parquet")
    spark.createDataFrame([(7, "# ADR-1: Cache\nDate: 2025-01-01", "en", "s", 1, "adr/1.md", None)], "doc_id long, text string, lang string, source string, n_chars long, path string, updated_at timestamp_ntz").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 7, 2, "p/cache.py#parse_row", "p/cache.py", 4, "parse_row", "symbol", None)], "link_id long, entry long, level int, node string, path string, line int, name string, via string, linked_at timestamp_ntz").write.parquet(f"{folder}/record_links.parquet")
    return str(folder)


def test_verbs(spark, rows, small):
    g = Graph(spark, small)
    assert g.ask("load the cache").first()["id"] == "p/cache.py#load_cache"
    assert rows(g.ask("who calls parse_row"), "id") == [("p/cache.py#load_cache",)]
    assert rows(g.find("raise ValueError"), "id", "n_hits", "in_degree") == [("p/cache.py#parse_row", 1, 1)]
    assert rows(g.callers("parse_row", depth="all"), "id", "depth") == [("p/cache.py#load_cache", 1)]
    ranges = spark.createDataFrame([("p/cache.py", 5, 5)], "path string, start_line int, end_line int")
    assert rows(g.impact(ranges), "id", "depth") == [("p/cache.py#load_cache", 1)]
    assert rows(g.map(), "dir", "n_files", "n_symbols", "dropped") == [("p", 1, 2, 0)]
    assert [r["name"] for r in g.symbols("cache.py").collect()] == ["load_cache", "parse_row"]
    assert rows(g.why("parse_row")) == [("p/cache.py#parse_row", 7, 2, False)]
    assert rows(g.check(g.relations.nodes.where("kind = 'file'")), "added", "removed", "ok") == [(2, 0, False)]


def test_stream_goes_on_where_it_stopped(spark, rows, small, tmp_path):
    import shutil

    from loamgraph.streaming.refresh import refresh_once

    folder = tmp_path / "t"
    shutil.copytree(f"{small}/source_files.parquet", folder / "source_files.parquet")
    assert rows(refresh_once(spark, str(folder), root=str(tmp_path / "r")), "path", "hash") == [("p/cache.py", "aa")]
    newer = spark.read.parquet(f"{folder}/source_files.parquet").withColumn("file_id", F.lit(2).cast("long")).withColumn("mtime_ms", F.lit(2.0)).withColumn("hash", F.lit("bb"))
    newer.write.mode("append").parquet(f"{folder}/source_files.parquet")
    assert rows(refresh_once(spark, str(folder), root=str(tmp_path / "r")), "path", "hash") == [("p/cache.py", "bb")]
