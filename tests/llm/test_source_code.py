import ast
import hashlib

import pytest

from loamgraph.llm import documentation as D
from loamgraph.llm import handwritten as H
from loamgraph.llm.gll import Parser
from loamgraph.llm.lexing import language_of, lex
from loamgraph.llm.syntax import broken_files, fault_kind, fault_rates, syntax_fault

FILE = "file_id long, prefix string, path string, lang string, size long, mtime_ms double, hash string, error string, broken boolean, content string, fault string, kind string"
NODE = "id string, path string, start_line int, summary string, summary_state string, description string"

VALID = {
    "js": ['import a, { b as c } from "m";\nexport * from "./x";\nexport default async function* f({ a, b: [c] }, ...d) {\n  for await (const x of y) { if (!x) continue; else break }\n  label: while (true) { break label }\n  const r = /a[/]b/g.test(s) ? `t${`n${1}`}` : a?.b ?? {};\n  return { a, get x() { return 1 }, async *[k]() {}, ...r };\n}\nclass A extends B { static #p = 1; static { } constructor() { super() } get v() { return this.#p } }\nlet z = a\n  .b\n  .c\nswitch (z) { case 1: default: }\ndo { z++ } while (z < 3)\ntry { x() } catch { y() } finally { }\nvar f = x => x * 2, g = async (a) => { };', "", "  \n"],
    "ts": ["import type { A } from './a';\ninterface I<T extends object = {}> extends J { readonly a?: string; [k: string]: unknown; m(x: number): void }\nexport abstract class C<T> implements I<T> { private x!: Map<string, Array<number>>; constructor(private readonly a: string) { super() } abstract f(): void; }\ntype U = | 'a' | { b: number };\nfunction isA(x: unknown): x is A { return (x as A).a !== undefined }\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number; }\nconst f = <T,>(a: T): T => a satisfies T;\nlet v = x!;"],
    "py": ['def f(a, /, b, *, c: int = 1) -> None:\n    """doc <<<<<<< """\n    x = {k: v for k, v in a}\n    match x:\n        case {"a": 1}:\n            pass\n'],
    "java": ['package a.b;\nimport static java.util.List.*;\n@Ann(value = {1, 2})\npublic final class A<T extends Comparable<T>> extends B implements C, D {\n  private static final int[] X = { 1, 2, };\n  A() { this(1); }\n  @Override public <R> R f(List<? super T> a, int... b) throws E {\n    for (int i = 0, j = 1; i < 3; i++) { if (i == 2) continue; else return (R) x; }\n    Runnable r = () -> { }; var t = """\n      text "block" ;\n      """;\n    switch (t) { case "a" -> x(); default -> { } }\n    char c = \'\\u0041\'; Object o = new Object() { int k = 1; };\n    return a.stream().map(String::valueOf).toList();\n  }\n  enum K { A(1), B { void x() { } }; K() { } K(int i) { } }\n  record P(int x, int y) { }\n}\n'],
    "rs": ['use std::{collections::HashMap, fmt};\n/* a /* nested */ comment */\n#[derive(Debug)]\npub struct A<\'a, T: Clone> where T: Copy { pub(crate) x: &\'a str, y: Vec<T> }\nimpl<\'a, T> A<\'a, T> { pub fn f(&mut self, c: char) -> Option<u8> { let r = r#"raw " "#; let x = \'a\'; if let Some(v) = self.g()? { return Some(v as u8) } match c { \'x\' | \'y\' if true => 1, _ => 0 }; for i in 0..10 { } loop { break } let v = vec![1, 2]; println!("{}", x); Some(b\'a\') } }\nmacro_rules! m { ($x:expr) => { $x + 1 } }\n'],
    "go": ['package a\n\nimport (\n\t"fmt"\n\tx "y"\n)\n\ntype T struct {\n\tA int `json:"a"`\n\tB map[string][]int\n}\n\nfunc (t *T) F(a, b int, c ...string) (int, error) {\n\tif x := a; x > 0 {\n\t\treturn x, nil\n\t} else {\n\t\tgo func() { fmt.Println(`raw`) }()\n\t}\n\tv := []T{\n\t\t{A: 1},\n\t\t{A: 2},\n\t}\n\tfor i := range v {\n\t\tswitch i {\n\t\tcase 1:\n\t\tdefault:\n\t\t}\n\t}\n\tch <- 1\n\treturn a, nil\n}\n'],
}


@pytest.mark.parametrize("lang", VALID)
def test_valid_files_are_valid(lang):
    for text in VALID[lang]:
        assert syntax_fault(lang, text) is None
        assert syntax_fault(lang, text.replace("\n", "\r\n")) is None


@pytest.mark.parametrize("lang", VALID)
def test_damage_is_found(lang):
    text = VALID[lang][0]
    assert fault_kind(syntax_fault(lang, text + "\n<<<<<<< HEAD\n=======\n>>>>>>> x\n")) == "merge marker"
    assert syntax_fault(lang, text + "\n)")
    assert syntax_fault(lang, "(" + text)
    for other, texts in VALID.items():  # wrong extension; every JavaScript file is a TypeScript file
        if other != lang and (other, lang) != ("js", "ts"):
            assert syntax_fault(lang, texts[0]), (lang, other)


@pytest.mark.parametrize("cut", range(12, 200, 9))
def test_cut_python_agrees_with_the_parser(cut):
    text = VALID["py"][0][:cut]
    try:
        ast.parse(text)
        assert syntax_fault("py", text) is None
    except SyntaxError:
        assert syntax_fault("py", text)


@pytest.mark.parametrize(
    "lang,text",
    [("js", 'const s = "abc\n'), ("js", "let x = `a${1`"), ("js", "x = {\n a: 1\n b: 2 }"), ("js", "if (x {"), ("js", "const a"), ("js", "a b"), ("js", "x = 3 +"), ("js", "function f(a: string) {}"), ("js", "/* open"), ("js", "# a comment"), ("js", "<!DOCTYPE html>\n<p>hi</p>"), ("ts", "let x = ;"), ("java", "class A { int f() { return 1 } }"), ("java", "class A { int x = 1; } }"), ("java", "int x;"), ("rs", "fn f() { let x = 1 }"), ("rs", "fn f() -> { x "), ("rs", "let x = 1;"), ("go", "func f() {}"), ("go", "package a\nfunc f() {\n\tg(1\n}\n"), ("go", "package a\nx := 1\n")],
)
def test_single_faults(lang, text):
    assert syntax_fault(lang, text)


def test_markers_in_strings_and_comments_are_valid():
    assert syntax_fault("js", "/*\n<<<<<<< HEAD\n=======\n*/\nconst s = `\n=======\n`;") is None
    assert syntax_fault("py", 's = """\n<<<<<<< a\n"""\n') is None


def test_anonymous_classes_with_long_arguments():
    def java(args, call="new Table"):
        return f"class A {{\n  void f() {{\n    Table t = {call}({args}) {{\n      public int size() {{ return 1; }}\n    }};\n  }}\n}}\n"

    many = ", ".join(f"g({k})" for k in range(400))
    assert syntax_fault("java", java("1")) is None
    assert syntax_fault("java", java(many)) is None
    assert syntax_fault("java", java(f"h({many}), new B({many})")) is None
    assert syntax_fault("java", java(many, "make")) is not None


def files(spark, *rows):
    full = [(k, "p", path, None, None, None, hashlib.sha256((c or "").encode()).hexdigest(), "old", None, c, "clash", "clash") for k, (path, c) in enumerate(rows)]
    return spark.createDataFrame(full, FILE)


def test_broken_files_and_rates(spark, rows):
    df = files(spark, ("p/a.py", "x = ("), ("p/b.py", "x = 1"), ("p/c.js", None), ("p/d.txt", "((("), (None, "((("), ("p/e.go", ""), ("p/f.js", "x = [" * 20000))
    assert rows(broken_files(df.union(df))) == [(0,), (6,)]
    assert ("p", "py", 2, 1, 0.5) in rows(fault_rates(df.union(df)))
    assert rows(broken_files(df.limit(0))) == []


# --- functions and documentation ---------------------------------------------------------------------------------------


def names(lang, text):
    return [(f.name, f.line) for f in Parser(lang, lex(lang, text)).functions()]


def test_every_form_of_a_function():
    js = "function a() {}\nexport const b = (x) => x;\nconst c = async function () {};\nclass K {\n  static async d() {}\n  get e() { return 1 }\n  f = (x) => { call(x); }\n}\nconst o = { g() {}, h: () => 1 };\nif (x) { y(1) }\nfor (;;) { z() }\n"
    assert names("js", js) == [("a", 1), ("b", 2), ("c", 3), ("d", 5), ("e", 6), ("f", 7), ("g", 9), ("h", 9)]
    assert names("ts", "export const f = <T,>(a: T): Promise<T> => a;\nfunction g<T extends { a: 1 }>(x: T): x is T { }\n") == [("f", 1), ("g", 2)]
    assert names("java", "class A {\n  public static <T> List<T> f(int a) throws E { g(a); new B(1); return h(2); }\n  int[] k() { return null; }\n  abstract void m();\n}") == [("f", 2), ("k", 3), ("m", 4)]
    assert names("rs", "impl A {\n  pub fn f<'a>(&self) -> u8 { g(1) }\n}\nfn k() {}") == [("f", 2), ("k", 4)]
    assert names("go", "package a\nfunc F(a int) {}\nfunc (t *T) G() int {\n\treturn F(1)\n}") == [("F", 2), ("G", 3)]
    assert names("py", "async def f(a: dict[str, int] = {}) -> list[int]:\n    def g(): pass\n") == [("f", 1), ("g", 2)]


def test_long_lists_in_angle_brackets():
    fields = "; ".join(f"f{k}: string" for k in range(300))
    assert names("ts", f"class A {{\n  async load(a: number): Promise<{{ {fields} }}> {{ return a; }}\n}}\n") == [("load", 2)]
    assert names("ts", f"const f = (a: number): Promise<{{ {fields} }}> => g(a);\n") == [("f", 1)]
    many = ", ".join(f"T{k}" for k in range(300))
    assert names("ts", f"function f<{many}>(a: T1) {{ }}\n") == [("f", 1)]
    assert names("rs", f"fn f<{many}>(a: T1) {{ }}\n") == [("f", 1)]
    nested = "M<K, " * 300 + "V" + ">" * 300
    assert names("ts", f"function f(a): {nested} {{ }}\nconst g = (a): {nested} => a;\n") == [("f", 1), ("g", 2)]
    assert names("ts", "if (a < b) { }\n" * 3 + "const x = a < b;\nfunction f<T>(a: T) { }\n") == [("f", 5)]


def test_intact_functions_of_broken_files():
    assert names("js", "function a() {}\nfunction b( {\nfunction c() { return [1 }\nfunction d() {}\n")[0] == ("a", 1)
    assert ("d", 4) in names("js", "function a() {}\nfunction b( {\nfunction c() { return [1 }\nfunction d() {}\n")
    assert names("py", "def a(:\n    pass\ndef b():\n    return (1\n\ndef c():\n    pass\n")[-1] == ("c", 6)


@pytest.mark.parametrize(
    "lines,name,real",
    [
        (["Reads the cache and drops stale rows."], "load", True),
        (["TODO"], "f", False), (["TODO: write docs for this function"], "f", False), (["Loads the row cache."], "loadRowCache", False), (["Verifys the stale term."], "verify_stale_term", False),
        (["the loader of things"], "load_things", True), (["@param a the a", "@returns nothing at all here"], "f", False), (["eslint-disable-next-line no-unused-vars, max-len"], "f", False),
        (["let total = 360;", "if (total > 4) {"], "f", False), (["Copyright 2020 the authors of this file", "Licensed under MIT"], "f", False), (["----------"], "f", False), ([], "f", False),
        (["Args:", "    x: value of the thing"], "f", False), (["Prüft, ob der Verweis noch gültig ist."], "check", True), (["Method foo()."], "foo", False), (["three words only"], "f", False),
        (["Answers whether pending TODO entries may be dropped."], "f", True), (["x" * 100_000 + " a b c d"], "f", True),
    ],
)
def test_what_is_documentation(lines, name, real):
    assert bool(D.description(lines, name)) is real


def test_where_documentation_may_stand():
    def of(lang, text):
        return {f.name: said for f, said, _, _ in D.documented_functions(lang, lex(lang, text), text)}

    doc = "Reads all rows and drops the stale ones."
    assert of("js", f"/** {doc} */\nfunction a() {{}}\n\n// {doc}\n\nfunction b() {{}}\nx(); // {doc}\nfunction c() {{}}\n") == {"a": doc, "b": None, "c": None}
    assert of("java", f"class A {{\n  /** {doc} */\n  @Ann(x = 1)\n  public int f() {{ return 1; }}\n}}") == {"f": doc}
    assert of("rs", f"/// {doc}\n#[inline]\npub fn f() {{}}\n") == {"f": doc}
    assert of("py", f'@cache\n# {doc}\ndef f():\n    pass\n\ndef g():\n    """{doc}"""\n') == {"f": doc, "g": doc}
    assert of("py", f'# TODO\ndef f():\n    """{doc}\n\n    :param x: y\n    """\n') == {"f": doc}


def test_code_runs_to_the_end_of_the_body():
    def of(lang, text):
        return {f.name: (first, last) for f, _, first, last in D.documented_functions(lang, lex(lang, text), text)}

    bounds = "".join(f"    T{k}: Clone + Send,\n" for k in range(30))
    assert of("rs", f"fn f<T>(a: T) -> u8\nwhere\n{bounds}{{\n  1\n}}\nfn g();\nfn h() {{\n}}\n") == {"f": (1, 35), "g": (36, 36), "h": (37, 38)}
    fields = "".join(f"  f{k}: string;\n" for k in range(30))
    assert of("ts", f"function f(a): Promise<{{\n{fields}}}> {{\n  g();\n}}\nfunction k(a): {{ x: 1 }} {{\n}}\nfunction o(a): string;\n") == {"f": (1, 34), "k": (35, 36), "o": (37, 37)}
    assert of("go", "func f(a int) (b struct {\n\tx int\n}, c error) {\n\tg()\n}\nfunc e() interface{} {\n\tg()\n}\nfunc asm(a int) int\nfunc h() {\n}\n") == {"f": (1, 5), "e": (6, 8), "asm": (9, 9), "h": (10, 11)}
    assert of("js", "const f = (a) =>\n  a.map(b)\n    .filter(c => {\n      return c;\n    });\nconst g = 1;\n") == {"f": (1, 5)}
    assert of("js", "const f = (a) =>\n  a +\n  b\n    .c(1)\nconst g = (a) => ({\n  x: 1,\n})\nrun()\nconst h = (a) => {\n  b()\n}\n") == {"f": (1, 4), "g": (5, 7), "h": (9, 11)}
    assert of("ts", "const o = { f: (a) =>\n  g<A, B>(a)\n    .b, h: () => 1 };\n") == {"f": (1, 3), "h": (3, 3)}
    assert of("js", "class A {\n  f() {\n    a();\n  }\n  g() {\n    b();\n  }\n}\n") == {"f": (2, 4), "g": (5, 7)}


def test_pairs_and_summaries(spark, rows):
    doc = "Reads all rows and drops the stale ones."
    df = files(spark, ("p/a.js", f"/** {doc} */\nfunction a() {{}}\nfunction b() {{}}\nfunction c() {{}}\n"), ("p/b.js", f"/** {doc} */\nfunction a() {{}}\n}}"), ("p/c.py", None), (None, "x"))
    nodes = spark.createDataFrame([("1", "./p/a.js", 3, "Walks the ledger and keeps open entries.", "ready", "x"), ("2", "p/a.js", 4, "Walks the ledger and keeps open entries.", "stale", "x"), ("3", "p/a.js", 4, "n/a", "ready", "x"), ("4", None, None, None, None, None)], NODE)
    assert rows(D.documented(df.union(df), nodes.union(nodes))) == [(0, 2), (0, 3)]
    got = rows(D.function_pairs(df, nodes), "file_id", "name", "code", "origin")
    assert got == [(0, "a", "function a() {}", "comment"), (0, "b", "function b() {}", "summary"), (1, "a", "function a() {}", "comment")]
    assert rows(D.documented(df.limit(0), nodes.limit(0))) == []


def test_repeated_short_templates_are_dropped(spark):
    same = "".join(f"// see manual chapter {k} first\nfunction f{k}() {{}}\n" for k in range(40))
    long = "".join(f"// reads row {k} and then tells the caller which of them was stale\nfunction g{k}() {{}}\n" for k in range(40))
    df, nodes = files(spark, ("p/a.js", same), ("p/b.js", long)), spark.createDataFrame([], NODE)
    assert {r["file_id"] for r in D.documented(df, nodes).collect()} == {1}


# --- origin ----------------------------------------------------------------------------------------------------------


def test_origins():
    hand = "import x from 'y';\nexport function f(a) {\n  return a;\n}\n"
    assert H.origin_of("p/src/a.js", hand)[0] == "hand"
    assert H.origin_of("p/src/a.js", "// Code generated by x. DO NOT EDIT.\n" + hand)[0] == "generated"
    assert H.origin_of("p/src/gen/a.js", "// Once generated from a schema, now maintained by hand.\n" + hand)[0] == "hand"
    assert H.origin_of("p/src/a.js", "// Helpers for reading auto-generated files.\n" + hand)[0] == "hand"
    assert H.origin_of("p/src/a.js", 'const HEADER = "// Code generated by x. DO NOT EDIT.";\n' + hand)[0] == "hand"
    assert H.origin_of("p/src/a.js", "// Vendored from lib 1.2.3; upstream changes only\n" + hand)[0] == "vendored"
    assert H.origin_of("p/node_modules/x/a.js", hand)[0] == "vendored" and H.origin_of("p/src/vendors/a.js", hand)[0] == "hand"
    assert H.origin_of("p/src/generators/a.js", hand)[0] == "hand" and H.origin_of("p/a_pb2.py", "x = 1\n")[0] == "generated"
    assert H.origin_of("p/a.js", "export default [" + "[1.5, 2.5, 3.5],\n" * 60 + "]")[0] == "data"
    assert H.origin_of("p/a.js", "!function(){" + "var a=1,b=function(c){return c*a+1};" * 30 + "}()")[0] == "minified"
    assert H.origin_of("p/a.js", 'const T = "' + "A sentence of prose in a test. " * 40 + '";\n' + hand)[0] == "hand"


def test_notes_below_a_long_banner():
    banner = "".join(f"// Clause {k} of the licence.\n" for k in range(60))
    code = "export function f(a) {\n  return a;\n}\n"
    assert H.origin_of("p/src/a.js", banner + code) == ("hand", "none")
    assert H.origin_of("p/src/a.js", banner + "// Code generated by protoc. DO NOT EDIT.\n" + code) == ("generated", "note")
    assert H.origin_of("p/src/a.js", banner + "// Vendored from the upstream repository.\n" + code) == ("vendored", "note")
    assert H.origin_of("p/gen/a.js", banner + "// Now maintained by hand.\n" + code) == ("hand", "note")
    assert H.origin_of("p/src/a.js", banner + code + "// Code generated by protoc. DO NOT EDIT.\n") == ("hand", "none")
    doc = '"""' + "Some words of the module.\n" * 60 + '@generated\n"""\nx = 1\n'
    assert H.origin_of("p/src/a.py", doc) == ("generated", "note")


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(H.glob_regex(g), p))
    assert hit("*.pb.go", "a/b/x.pb.go") and not hit("/*.pb.go", "a/x.pb.go") and hit("a/**/x.js", "a/b/c/x.js") and hit("a/**/x.js", "a/x.js")
    assert not hit("a/*.js", "a/b/x.js") and hit("x?.[ch]", "q/xy.c") and hit("dist/**", "dist/x/y.js") and not hit("dist/**", "a/dist/x/y.js")
    assert H.glob_regex("dist/") is None and H.glob_regex("!x.js") is None  # attributes do not reach below a folder, and know no negation


def test_attribute_lines():
    got = H.attribute_lines('# *.c linguist-generated\n*.js linguist-generated -text\n"a b.js" linguist-vendored=false\n*.ts !linguist-generated\ndist/ linguist-generated\n')
    assert [(n, kind, said) for n, _, kind, said in got] == [(2, "generated", True), (3, "vendored", False), (4, "generated", None)]


def test_attribute_files_win_and_are_mined(spark, rows):
    hand = "function f(a) {\n  return a;\n}\n"
    own = [("p/.gitattributes", "*.js linguist-generated\nsrc/keep/* -linguist-generated\nout/** linguist-vendored=true\n"), ("p/src/.gitattributes", "b.js linguist-generated=false\n"), ("p/a.js", hand), ("p/src/b.js", hand), ("p/src/keep/c.js", hand), ("p/out/d.ts", hand)]
    own += [(f"p/out/deep/f{k}.ts", hand) for k in range(30)] + [("q/deep/x.ts", hand), ("q/other/x.ts", hand)]
    got = {r["path"]: (r["kind"], r["evidence"]) for r in H.file_origins(files(spark, *own)).collect()}
    assert got["p/a.js"] == ("generated", "attribute file") and got["p/src/b.js"] == ("hand", "attribute file") and got["p/src/keep/c.js"] == ("hand", "attribute file")
    assert got["p/out/d.ts"][0] == "vendored" and got["q/deep/x.ts"] == ("vendored", "mined pattern") and got["q/other/x.ts"] == ("hand", "none")


def test_unspecified_again(spark):
    own = [("p/.gitattributes", "*.js linguist-generated\n"), ("p/src/.gitattributes", "b.js !linguist-generated\n"), ("p/src/b.js", ""), ("p/src/c.js", "")]
    got = {r["path"]: (r["kind"], r["evidence"]) for r in H.file_origins(files(spark, *own)).collect()}
    assert got["p/src/b.js"] == ("hand", "none") and got["p/src/c.js"] == ("generated", "attribute file")


def test_patterns_are_mined_from_the_notes_of_the_files(spark):
    hand, made = "def f(a):\n    return a\n", "# Code generated by protoc. DO NOT EDIT.\nx = 1\n"
    own = [(f"r{k % 7}/src/{'deep' if k % 3 else 'core'}/f{k}.py", hand) for k in range(300)]
    own += [(f"r{k % 7}/emitted/g{k}.py", made if k % 2 else hand) for k in range(40)]
    own += [(f"r{k % 7}/mixed/g{k}.py", made if k % 2 else hand.replace("def", "# Once generated, now maintained by hand.\ndef")) for k in range(40)]
    got = {r["path"]: (r["kind"], r["evidence"]) for r in H.file_origins(files(spark, *own)).collect()}
    assert got["r0/emitted/g0.py"] == ("generated", "mined pattern") and got["r1/emitted/g1.py"] == ("generated", "note")
    assert got["r0/mixed/g0.py"] == ("hand", "note") and got["r0/src/core/f0.py"] == ("hand", "none")


def test_origin_edge_cases(spark, rows):
    df = files(spark, (None, None), ("", ""), ("p/a.min.js", None), ("p/a.js", "x" * 300_000), ("p/node_modules/a.js", ""))
    assert rows(H.not_by_hand(df.union(df))) == [(2,), (4,)]
    assert rows(H.not_by_hand(df.limit(0))) == []


def test_languages():
    assert [language_of(p) for p in ("a/b.py", "x.d.ts", "Makefile", None, "a.JS", "b\\c.rs")] == ["py", "ts", None, None, "js", "rs"]
