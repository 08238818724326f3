import math
import random

import pytest

from loamgraph.functions import keys, text
from loamgraph.operators import graph, records, resolve, rollups, spans, textsearch
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_path_keys_and_hashes(spark):
    got = [one(spark, keys.path_key(F.lit(s))) for s in (" a/b ", "./a", "././a", "a\\b", "A~2", " x\t", "", None)]
    assert got == ["a/b", "a", "./a", "a/b", "A~2", "x", "", None]
    assert [one(spark, keys.content_hash(F.lit(s))) for s in ("SHA256:AB", "ab", " ", None)] == ["ab", "ab", None, None]


def test_tokens_and_query_terms(spark):
    assert one(spark, text.tokens(F.lit("getHTTPServer2Go the user_id x İstanbul"))) == ["httpserver2", "go", "user", "id", "stanbul"]
    assert text.query_terms("How does the fooBar work") == ["foo", "bar"] and text.query_terms("work foo work") == ["work", "foo"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) is None


def test_paths(spark):
    assert one(spark, text.dir_key(F.lit("a/b/c.py"), 1)) == "a" and one(spark, text.dir_key(F.lit("c.py"), 2)) == "."
    assert one(spark, text.dir_prefixes(F.lit("a/b/c.py"))) == ["a", "a/b"] and one(spark, text.path_suffixes(F.lit("a/b"))) == ["a/b", "b"]
    assert one(spark, text.file_stem(F.lit("a/b.test.ts"))) == "b.test" and one(spark, text.file_stem(F.lit(".env"))) == ".env"
    assert one(spark, resolve.normal_path(F.lit("a/b/../c/./d"))) == "a/c/d" and one(spark, resolve.normal_path(F.lit("../a"))) is None
    assert one(spark, text.strip_ordinals(F.lit("a#B~2.c~3"))) == "a#B.c"


def test_units_and_redaction(spark):
    assert one(spark, text.utf16_length(F.lit("a\U0001f642"))) == 3
    assert one(spark, text.cut_units(F.lit("\U0001f642\U0001f642"), 3)) == "\U0001f642" and one(spark, text.cut_units(F.lit("abc"), 5)) == "abc"
    red = lambda s: one(spark, text.redact(F.lit(s)))
    assert red("token = 0123456789abcdef") == "token = [redacted]" and red("https://u:pw@h/x") == "https://h/x" and red("plain words") == "plain words"
    assert "[redacted]" in red("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----") and red("eyJhbGciOiJI.eyJzdWIiOiIx.sig") == "[redacted]"
    assert red("auth: Basic abc") == "auth: Basic [redacted]" and red("Bearer abc, x") == "Bearer [redacted], x" and red('AccountKey="a b"; x') == "AccountKey=[redacted]; x"
    assert red("token: &str") == "token: &str" and red("token == x") == "token == x" and red("hf_" + "a" * 30) == "[redacted]" and red("hf_" + "a" * 29) == "hf_" + "a" * 29
    assert red("ghp_12345678 xghp_12345678") == "[redacted] xghp_12345678" and red("sk-ant-1234567 sk-12345678 npm_1234") == "sk-ant-1234567 [redacted] npm_1234"
    assert red("a" * 39 + "1/") == "[redacted]" and red("a" * 41) == "a" * 41 and red("\x1b[31mred\x1b[0m\ttext\n") == "red text"
    assert red("-----BEGIN X-----\nabc") == "[redacted]" and red("a -----BEGIN X-----b-----END X----- c") == "a [redacted] c"


def edges(spark, *pairs):
    return spark.createDataFrame([(k, s, t, "calls", k) for k, (s, t) in enumerate(pairs)], "edge_id long, source string, target string, relation string, ord long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i, i.split("#")[-1].split(".")[-1] if "#" in i else i.rsplit("/", 1)[-1], "function" if "#" in i else "file", i.split("#")[0], k + 1, k + 2) for k, i in enumerate(ids)], "id string, name string, kind string, path string, start_line int, end_line int")


def test_reach_equals_a_plain_search(spark):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(90)]
    seeds = [("o1", "n0"), ("o1", "n3"), ("o2", "n7")]
    want = set()
    for o in ("o1", "o2"):
        depth = {i: 0 for p, i in seeds if p == o}
        queue = list(depth)
        for i in queue:
            for s, t in pairs:
                if t == i and s not in depth:
                    depth[s] = depth[i] + 1
                    queue.append(s)
        want |= {(o, i, d) for i, d in depth.items() if d}
    got = graph.reach(edges(spark, *pairs), spark.createDataFrame(seeds, "origin string, id string")).select("origin", "id", "depth", "parent").collect()
    assert {tuple(r)[:3] for r in got} == want
    at = {(r["origin"], r["id"]): r["depth"] for r in got} | {s: 0 for s in seeds}
    assert all((r["id"], r["parent"]) in pairs and at[(r["origin"], r["parent"])] == r["depth"] - 1 for r in got)


def test_reach_prefers_the_first_edge_and_ends(spark):
    got = graph.reach(edges(spark, ("c", "b"), ("c", "a"), ("a", "s"), ("b", "s"), ("s", "s")), spark.createDataFrame([("o", "s")], "origin string, id string")).collect()
    assert {(r["id"], r["depth"]): r["parent"] for r in got} == {("a", 1): "s", ("b", 1): "s", ("c", 2): "a"}
    assert graph.reach(edges(spark, ("a", "b")), spark.createDataFrame([("o", "zz")], "origin string, id string")).count() == 0


def test_in_degree_counts_self_loops_and_dangling(spark, rows):
    assert rows(graph.in_degree(edges(spark, ("a", "a"), ("a", "gone"), ("b", "a")))) == [("a", 2), ("gone", 1)]


@pytest.mark.parametrize("local", [True, False])
def test_pagerank_equals_a_plain_loop(spark, local):
    rnd = random.Random(7)
    ids = [f"p/f#n{k}" for k in range(25)]
    pairs = [(rnd.choice(ids[:20]), rnd.choice(ids[:20])) for _ in range(40)] + [("gone", ids[0])]
    seeds = {ids[0]: 2.0, ids[1]: 1.0, ids[24]: 1.0, "gone": 5.0}
    inside = {i: v for i, v in seeds.items() if i in ids}
    r = {i: inside.get(i, 0) / sum(inside.values()) for i in ids}
    near = {i: [] for i in ids}
    for s, t in pairs:
        if s in near and t in near:
            near[s].append(t)
            near[t].append(s)
    mass = dict(r)
    for _ in range(25):
        lost = sum(mass[i] for i in ids if not near[i])
        new = {i: 0.25 * r[i] + 0.75 * lost * r[i] for i in ids}
        for i in ids:
            for j in near[i]:
                new[j] += 0.75 * mass[i] / len(near[i])
        mass = new
    top = max(mass.values())
    df = textsearch.pagerank(nodes(spark, *ids), edges(spark, *pairs), spark.createDataFrame(list(seeds.items()), "id string, weight double"), local_links=10**6 if local else 0)
    got = {x["id"]: x["rank"] for x in df.collect()}
    assert set(got) == {i for i in ids if mass[i] > 0}
    assert all(abs(got[i] - mass[i] / top) < 1e-9 for i in got)


def test_symbol_resolution_order(spark, rows):
    n = nodes(spark, "a/parser.py", "a/parser.py#load", "b/x.ts", "b/x.ts#ts", "b/x.ts#C.load")
    assert [i for i, _ in rows(graph.resolve_symbol(n, "load"))] == ["a/parser.py#load", "b/x.ts#C.load"]
    assert rows(graph.resolve_symbol(n, "x.ts")) == [("b/x.ts", 2)] and rows(graph.resolve_symbol(n, "foo.ts")) == [("b/x.ts#ts", 3)]
    assert rows(graph.resolve_symbol(n, "load", prefix="b/")) == [("b/x.ts#C.load", 1)] and rows(graph.resolve_symbol(n, "nothing")) == []


def span_rows(spark, *s):
    return spark.createDataFrame([("p", a, b, i, k) for k, (a, b, i) in enumerate(s)], "path string, start_line int, end_line int, id string, node_key long")


def test_spans_equal_brute_force(spark, rows):
    rnd = random.Random(2)
    s = [(a := rnd.randrange(1, 300), a + rnd.randrange(0, 150), f"s{k}") for k in range(60)]
    points = [(line,) for line in range(1, 460, 7)]
    df, pts = span_rows(spark, *s), spark.createDataFrame([("p", x) for (x,) in points], "path string, line int")
    for r in spans.innermost(pts, df).collect():
        inside = [(a, k, i) for k, (a, b, i) in enumerate(s) if a <= r["line"] <= b]
        assert r["id"] == (max(inside)[2] if inside else None)
    chain = {}
    for r in spans.enclosing_chain(pts, df).collect():
        chain.setdefault(r["line"], []).append((r["position"], r["id"]))
    assert all([i for _, i in sorted(v)] == [i for _, i in sorted((b - a, i) for a, b, i in s if a <= line <= b)] for line, v in chain.items())
    covered = {x for a, b, _ in s for x in range(a, b + 1)}
    assert rows(spans.covered_lines(df)) == [("p", len(covered))]


def test_overlap_drops_containers_and_equal_spans(spark, rows):
    df = span_rows(spark, (1, 100, "outer"), (10, 20, "inner"), (30, 40, "e1"), (30, 40, "e2"))
    ranges = spark.createDataFrame([("p", 12, 13), ("p", 35, 35), ("p", 90, 95)], "path string, start_line int, end_line int")
    assert rows(spans.overlapping(ranges, df)) == [("p", 12, 13, "inner"), ("p", 90, 95, "outer")]
    assert len(rows(spans.overlapping_all(ranges, df))) == 4


@pytest.mark.parametrize("line,slash,hashed,want", [('x = "//a" // b', True, False, "// b"), ("http://a", True, False, None), ("#[attr] # x", True, True, "# x"), ("a#b", False, True, None), ('"\\"" # c', False, True, "# c"), ('s = "open # x', True, True, None), ("#!sh", True, True, None)])
def test_comment_scan(line, slash, hashed, want):
    assert spans.comment_of(line, slash, hashed) == want


def test_comment_lines_of_very_long_lines(spark, rows):
    long = '"a"/' * 30_000
    df = spark.createDataFrame([("a.js", 1, long + " // end"), ("a.py", 1, "x = 1 # TODO y"), ("a.js", 2, None)], "path string, line int, text string")
    assert rows(spans.comment_lines(df)) == [("a.js", 1, "// end"), ("a.py", 1, "# TODO y")]
    assert rows(spans.reason_comments(spans.comment_lines(df))) == [("a.py", 1, "# TODO y")]


def test_name_resolution_rules(spark, rows):
    sym = spark.createDataFrame([("a.py#f", "a.py", "f"), ("b.py#f", "b.py", "f"), ("b.py#g", "b.py", "g"), ("c.py#h1", "c.py", "h"), ("c.py#h2", "c.py", "h"), ("d.go#k", "d.go", "k")], "id string, path string, name string")
    raw = spark.createDataFrame([(1, "a.py", "f"), (2, "c.py", "f"), (3, "a.py", "g"), (4, "c.py", "h"), (5, "a.py", "k"), (6, "x", "k")], "ref_id long, path string, name string")
    assert rows(resolve.resolve_names(raw, sym)) == [(1, "a.py#f", "extracted"), (3, "b.py#g", "inferred"), (6, "d.go#k", "inferred")]


def test_arity_members_imports_and_exports(spark, rows):
    c = spark.createDataFrame([(1, "x", 2, 2, None), (1, "y", 2, 3, None), (2, "x", 1, 3, None), (2, "y", 1, 4, False), (3, "v", 1, 2, True), (3, "u", 1, None, None)], "call_id long, id string, argc int, arity int, variadic boolean")
    assert rows(resolve.narrow_by_arity(c)) == [(1, "x"), (2, "x"), (2, "y"), (3, "u"), (3, "v")]
    calls = spark.createDataFrame([(1, "C", "m"), (2, "C", "k")], "call_id long, type string, name string")
    members = spark.createDataFrame([("A", "m", "A.m"), ("B", "m", "B.m"), ("A", "k", "A.k")], "owner string, name string, id string")
    parents = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "C")], "child string, parent string")
    assert rows(resolve.typed_members(calls, members, parents)) == [(1, "B.m", 1), (2, "A.k", 2)]
    files = spark.createDataFrame([("a/b.ts",), ("a/c/index.ts",), ("d.js",)], "path string")
    imports = spark.createDataFrame([(1, "a/x.ts", "./b"), (2, "a/x.ts", "./c"), (3, "a/x.ts", "../d.js"), (4, "a/x.ts", "lib"), (5, "a/x.ts", "../../up"), (6, "a/x.ts", "./b.js")], "ref_id long, path string, spec string")
    assert [r[1:] for r in rows(resolve.resolve_imports(imports, files))] == [("a/b.ts", True), ("a/c/index.ts", True), ("d.js", True), ("lib", False), ("../../up", False), ("a/b.ts", True)]
    wanted = spark.createDataFrame([(1, "i.ts", "f"), (2, "i.ts", "g"), (3, "i.ts", "loop")], "ref_id long, path string, name string")
    exports = spark.createDataFrame([("m.ts", "f2", "m#f"), ("n.ts", "g", "n#g"), ("o.ts", "g", "o#g")], "path string, name string, id string")
    re_ = spark.createDataFrame([("i.ts", "f", "m.ts", "f2"), ("i.ts", "*", "n.ts", None), ("i.ts", "*", "o.ts", None), ("n.ts", "*", "i.ts", None)], "path string, name string, source string, source_name string")
    assert rows(resolve.resolve_exports(wanted, exports, re_)) == [(1, "m#f", 1)]


def test_record_entries_and_successors(spark, rows):
    docs = spark.createDataFrame([(1, "adr/1.md", "# ADR-0001: Keep it\n\nDate: 2025-01-01\n"), (2, "adr/2.md", "# ADR-0002: Drop it\nDate: 2025-02-01\n**Supersedes:** ADR-0001: Keep it\n```\nSupersedes: ADR-0002: Drop it\n```"), (3, "x.md", "```\nDate: 2025-01-01\n```"), (4, "y.md", "Date: 2025-03-01"), (5, "z", None)], "doc_id long, path string, text string")
    entries = records.record_entries(docs)
    assert rows(entries) == [(1, 1, "ADR-0001: Keep it", "2025-01-01"), (2, 1, "ADR-0002: Drop it", "2025-02-01"), (4, 1, "y.md", "2025-03-01")]
    assert rows(records.superseded(entries, docs)) == [(1, 2)]


def test_topic_links_find_the_odd_record(spark):
    recs = spark.createDataFrame([(f"r{k}", "common", 1) for k in range(60)] + [("r7", "ledger", 9), ("r7", "stamp", 9)], "id string, term string, tf long")
    files = spark.createDataFrame([("f", "ledger", 3), ("f", "stamp", 3), ("f", "common", 1), ("g", "other", 1)], "id string, term string, tf long")
    got = textsearch.topic_links(recs, files).collect()
    assert [(r["file"], r["record"]) for r in got] == [("f", "r7")]


def shuffled(spark, run):
    """Rows that the stages of ``run`` wrote for a shuffle."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def test_topic_links_shuffle_no_pairs(spark):
    rnd = random.Random(5)
    recs = spark.createDataFrame([(k, f"w{t}", 1 + t % 3) for k in range(400) for t in rnd.sample(range(40), 8)], "id long, term string, tf long")
    files = spark.createDataFrame([(f"f{k}", f"w{t}", 1) for k in range(300) for t in rnd.sample(range(40), 10)], "id string, term string, tf long")
    assert shuffled(spark, lambda: textsearch.topic_links(recs, files, z_min=1.0).collect()) < 300 * 400 / 4


def test_topics_of_all_records_shuffle_no_pairs(spark):
    from types import SimpleNamespace

    from loamgraph.plans import answer_queries

    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.sample([f"word{k}" for k in range(40)], n))
    docs = spark.createDataFrame([(k, f"adr/{k}.md", f"Date: 2025-01-01 {say(10)}") for k in range(400)], "doc_id long, path string, text string")
    nodes = spark.createDataFrame([(f"src/f{k}.py#g", "function", f"g{k}", f"src/f{k}.py", say(10)) for k in range(400)], "id string, kind string, name string, path string, summary string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are larger
    try:
        assert shuffled(spark, lambda: answer_queries.x19_record_topics(SimpleNamespace(documents=docs, nodes=nodes)).collect()) < 400 * 400 / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_topics_equal_to_six_decimals_go_by_record(spark):
    # the text of record 5 is one word in a billion longer than that of record 90, so its score is less, but not to six decimals of z
    recs = [(k, "common", 1) for k in range(200)] + [(k, "ledger", 40) for k in (5, 90, 120)] + [(5, "rest", 1_000_000_001), (90, "rest", 1_000_000_000), (120, "rest", 999_999_999)]
    recs = spark.createDataFrame(recs, "id long, term string, tf long")
    files = spark.createDataFrame([("f", "ledger", 3), ("f", "common", 1), ("g", "other", 1)], "id string, term string, tf long")
    got = textsearch.topic_links(recs, files).collect()
    assert [r["record"] for r in sorted(got, key=lambda r: r["record"])] == [5, 90] and len({r["z"] for r in got}) == 1


def test_topics_in_blocks_of_records(spark):
    from pyspark.sql.types import LongType

    from loamgraph.operators import products

    rnd = random.Random(7)
    posts = spark.createDataFrame([(k, f"w{t}", rnd.random()) for k in range(90) for t in rnd.sample(range(12), 3)], "key long, term string, w double")
    files = spark.createDataFrame([(f"f{k}", [f"w{t}" for t in rnd.sample(range(12), 4)] + ["unseen"], [k]) for k in range(20)], "file string, terms array<string>, known array<long>")
    written = products.write_postings(posts, "posts")
    one, many = ({(r["file"], r["record"]): (r["score"], r["z"]) for r in products.outstanding(files, written, LongType(), z_min=1.0, per_file=3, **x).collect()} for x in ({}, {"limit": 20, "cells": 200}))
    assert len(written) > 1 and len(one) == 60 and one.keys() == many.keys() and all(f != f"f{k}" for f, k in one)
    assert all(abs(a - b) < 1e-5 for k in one for a, b in zip(one[k], many[k]))


def test_rounding_is_that_of_spark(spark):
    import numpy as np

    from loamgraph.operators import products

    rnd = random.Random(9)
    values = [rnd.random() * 10 ** rnd.randint(-7, 8) for _ in range(2000)] + [round(rnd.random() * 100, 6) + 5e-7 for _ in range(2000)] + [1.0000005, 2.5e-6, 4.5]
    want = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(F.round("v", 6)).collect()]
    assert products.round6(np.array(values)).tolist() == want


def test_topics_of_all_records_without_exact_links(spark):
    import re
    from types import SimpleNamespace

    from loamgraph.plans import answer_queries

    # an odd record under adr/, one under guide/, two that name the file, and an odd document without a date
    odd = {3: "ledger stamp", 7: "ledger stamp ledger stamp", 9: "ledger stamp see src/f.py", 11: "ledger stamp ledger stamp in `weigh`"}
    texts = [(k, ("adr", "guide", "docs", "notes")[k % 4] + f"/{k}.md", f"# Note {k}\n\nDate: 2025-01-01\n\ncommon {odd.get(k, '')}") for k in range(200)]
    texts.append((500, "adr/500.md", "# Note\n\ncommon ledger stamp ledger stamp ledger stamp"))
    docs = spark.createDataFrame(texts, "doc_id long, path string, text string")
    nodes = [("src/f.py", "file", "f.py", "src/f.py", None), ("src/f.py#weigh", "function", "weigh", "src/f.py", "ledger stamp common"), ("src/g.py", "file", "g.py", "src/g.py", "other words")]
    nodes = spark.createDataFrame(nodes, "id string, kind string, name string, path string, summary string")
    got = answer_queries.x19_record_topics(SimpleNamespace(documents=docs, nodes=nodes)).collect()

    bags = {k: [w for w in re.findall("[a-z0-9]{2,}", t.lower()) if w not in text.STOP_WORDS] for k, _, t in texts if k != 500}
    n, mean_len = len(bags), sum(map(len, bags.values())) / len(bags)
    score = {}
    for k, bag in bags.items():
        for t in ("ledger", "stamp", "common"):
            df, tf = sum(t in b for b in bags.values()), bag.count(t)
            if tf:
                score[k] = score.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean_len))
    mean = sum(score.values()) / n
    sd = (sum((v - mean) ** 2 for v in score.values()) / n) ** 0.5
    z = {k: (v - mean) / sd for k, v in score.items()}
    assert sorted(k for k, v in z.items() if v >= 4.5) == [3, 7, 9, 11]
    assert sorted((r["file"], r["record"]) for r in got) == [("src/f.py", 3), ("src/f.py", 7)]
    assert all(abs(r["z"] - z[r["record"]]) < 1e-5 and abs(r["score"] - score[r["record"]]) < 1e-5 for r in got)


def test_texts_as_queries_equal_brute_force(spark):
    from types import SimpleNamespace

    from loamgraph.plans import graph_queries

    rnd = random.Random(3)
    words = [f"word{k}" for k in range(12)]
    fields = {f"n{k}": {f: [rnd.choice(words) for _ in range(rnd.randint(1, 9))] for f in ("name", "path", "body")} for k in range(30)}
    terms = spark.createDataFrame([(i, f, t, bag.count(t)) for i, fs in fields.items() for f, bag in fs.items() for t in set(bag)], "id string, field string, term string, tf long")
    heads = {k: " ".join(rnd.sample(words, 2)) for k in (0, 50, 100)}
    bodies = {k: " ".join(rnd.choice(words + ["unseen"]) for _ in range(20)) for k in (0, 50, 51, 100, 150)}
    texts = {k: (f"# {heads[k]}\n\n" if k in heads else "") + b for k, b in bodies.items()} | {200: None, 250: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["query"], r["id"]): r["score"] for r in graph_queries.x20_text_links(SimpleNamespace(documents=docs, terms=terms)).collect()}

    n, want = len(fields), {}
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t in words for d in [sum(any(t in b for b in fs.values()) for fs in fields.values())] if d}
    mean = {f: sum(len(fs[f]) for fs in fields.values()) / n for f in ("name", "path", "body")}
    for k, t in texts.items():
        bag = (t or "").replace("#", "").split() if k % 50 == 0 else []
        for term in set(bag) & set(idf):
            c = bag.count(term) + 2 * (term in heads.get(k, "").split())
            for i, fs in fields.items():
                x = sum(w * fs[f].count(term) / (0.25 + 0.75 * len(fs[f]) / mean[f]) for f, w in (("name", 3), ("path", 2), ("body", 0.5)))
                if x:
                    want[k, i] = want.get((k, i), 0) + (1 + math.log(c)) * idf[term] ** 2 * x / (1.2 + x)
    assert got.keys() == want.keys() and {k for k, _ in got} == {0, 50, 100, 150}
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_texts_as_queries_shuffle_no_pairs(spark):
    from types import SimpleNamespace

    from loamgraph.plans import graph_queries

    rnd = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    terms = spark.createDataFrame([(f"n{k}", "body", t, 1) for k in range(600) for t in rnd.sample(words, 5)], "id string, field string, term string, tf long")
    docs = spark.createDataFrame([(50 * k, " ".join(rnd.sample(words, 12))) for k in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are larger
    try:
        n = []
        assert shuffled(spark, lambda: n.append(graph_queries.x20_text_links(SimpleNamespace(documents=docs, terms=terms)).count())) < 600 * 400 / 4
        assert n[0] > 600 * 400 / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ownership_decays(spark):
    commits = spark.createDataFrame([("a", "x", 1, "2025-01-01"), ("a", "x", 1, "2025-01-01"), ("a", "y", 2, "2024-09-03")], "area string, person string, sha long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["person"]: r["score"] for r in rollups.ownership(commits, now="2025-01-01", least=0.0).collect()}
    assert got == {"x": 1.0, "y": 0.5}


def test_index_is_kept_up_to_date(spark, rows, tmp_path):
    from loamgraph.operators.askindex import AskIndex
    from loamgraph.operators.incremental import VersionedTarget

    cols = "id string, name string, path string, body_text string, term string"
    first = [(f"n{k}", f"loadCache{k}", f"src/a{k}.py", "cache lock " * k + "stale", "clash") for k in range(6)] + [("z", None, "src/z.py", None, None)]
    second = [*first[1:4], ("n4", "dropLock4", "src/a4.py", "the session lock", "clash"), ("new", "session", "tests/new.py", "cache session stale", "clash")]
    index, fresh = AskIndex(VersionedTarget(spark, str(tmp_path / "a"))), AskIndex(VersionedTarget(spark, str(tmp_path / "b")))
    index.refresh(spark.createDataFrame(first, cols))
    df = spark.createDataFrame(second, cols)
    index.refresh(df)
    fresh.refresh(df)
    for question in ("how does the cache resolve a stale session lock", "session", "nothing of that kind"):
        got = [r6 for r6 in rows(index.lexical(question).select("id", F.round("lexical", 9)))]
        assert got == rows(fresh.lexical(question).select("id", F.round("lexical", 9))) == rows(textsearch.lexical_scan(df, question).select("id", F.round("lexical", 9)))
    assert {r.id for r in index.target.read("postings").collect()} == {"n4", "new"}  # nothing else was read again
    assert {r.id for r in index.docs().collect()} == {"n1", "n2", "n3", "n4", "new"}
    index.refresh(df.limit(0))
    assert index.lexical("cache").count() == 0


def test_labels_numbers_signatures(spark):
    label = lambda t: one(spark, text.short_label(F.lit(t)))
    assert label("Concept: Short name") == "Short name" and label("Loading rules for everything that is read") == "Loading rules"
    assert label("a for the one and only very long label") == "a for the one and only very…" and label("x" * 40) == "x" * 30 + "…" and label("Cache of the session: what remains after it") == "Cache of the session: what…"
    assert [one(spark, text.short_number(F.lit(n))) for n in (7, 999, 1000, 1949, 9949, 9950, 84_499)] == ["7", "999", "1.0k", "1.9k", "9.9k", "10k", "84k"]
    assert one(spark, text.thousands(F.lit(1234567))) == "1,234,567"
    sig = lambda n, s: one(spark, text.trim_signature(F.lit(n), F.lit(s)))
    assert sig("f", "export async function f(a: string): void") == "(a: string): void" and sig("W", "interface W") is None and sig("x", "const x = (a) => 1") == "(a) => 1"
