from loamgraph.operators import extract as X
from loamgraph.operators import proofs as P

FILES = "path string, content string, name string"


def files(spark, **texts):
    return spark.createDataFrame([(p, t, "clash") for p, t in texts.items()], FILES)


def tree(spark, texts):
    return spark.createDataFrame([(p, t, "clash") for p, t in texts.items()], FILES)


JS = """import { a as b, c } from "./m.js";
import * as ns from './n';
// function no() {}
export class Box extends Base {
  static make(x, y = [1, 2]) {
    return new Box(x);
  }
  run(cb) { if (cb) { cb(this.size(), "f(x) {"); } }
}
export const arrow = async (p) => {
  ns.go(p);
};
function plain(...rest) { return b(1, [2, 3]); }
"""


def test_script(spark):
    symbols, edges = X.extract("a/x.ts", JS)
    assert [(s["name"], s["kind"], s["owner"], s["start_line"], s["end_line"], s["arity"], s["exported"]) for s in symbols] == [
        ("Box", "class", None, 4, 9, None, True), ("make", "method", "Box", 5, 7, 2, True), ("run", "method", "Box", 8, 8, 1, True), ("arrow", "function", None, 10, 12, 1, True), ("plain", "function", None, 13, 13, 1, False)
    ]
    calls = [(e["name"], e["recv"], e["argc"], e["scope"]) for e in edges if e["relation"] == "calls"]
    assert calls == [("Box", None, 1, "make"), ("cb", None, 2, "run"), ("size", "this", 0, "run"), ("go", "ns", 1, "arrow"), ("b", None, 2, "plain")]
    assert [(e["spec"], e["imported"], e["name"]) for e in edges if e["relation"] == "imports"] == [("./m.js", "a", "b"), ("./m.js", "c", "c"), ("./n", "*", "ns")]
    assert [e["name"] for e in edges if e["relation"] == "extends"] == ["Base"]


def test_other_languages():
    py = 'from .m import (\n    a as b,\n    c)\nimport os.path as p\n\nclass K(Base):\n    def one(self, x, *rest):\n        """def no(): pass"""\n        return b(\n            x)\n\ndef two(a,\n        b=1):\n    return 1\nx = two(1)\n'
    symbols, edges = X.extract("q.py", py)
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"], s["arity"]) for s in symbols] == [("K", "class", 6, 10, None), ("one", "method", 7, 10, 2), ("two", "function", 12, 14, 2)]
    assert [(e["spec"], e["imported"], e["name"]) for e in edges if e["relation"] == "imports"] == [(".m", "a", "b"), (".m", "c", "c"), ("os.path", "*", "p")]
    java = "import a.b.C;\npublic class T implements I {\n  public int f(List<A, B> x, int y) { return g(x); }\n  T() { }\n  abstract void h();\n}\n"
    assert [(s["name"], s["kind"], s["arity"], s["exported"]) for s in X.extract("T.java", java)[0]] == [("T", "class", None, True), ("f", "method", 2, True), ("T", "method", 0, False), ("h", "method", 0, False)]
    go = 'package p\nimport (\n\t"a/b"\n\tq "c/d"\n)\ntype S struct {\n\tn int\n}\nfunc (s *S) Run(a int) int {\n\treturn b.Go(a)\n}\nfunc lone() {}\n'
    symbols, edges = X.extract("x.go", go)
    assert [(s["name"], s["kind"], s["owner"], s["end_line"]) for s in symbols] == [("S", "struct", None, 8), ("Run", "method", "S", 11), ("lone", "function", None, 12)]
    assert [(e["spec"], e["name"]) for e in edges if e["relation"] == "imports"] == [("a/b", "b"), ("c/d", "q")]
    rs = "use a::b::{c, d as e};\npub struct S { n: i64 }\nimpl S {\n    pub fn run(&self, x: i64) -> i64 { c(x) }\n}\nfn lone<T: A>(x: T) {}\n"
    assert [(s["name"], s["owner"], s["arity"]) for s in X.extract("x.rs", rs)[0]] == [("S", None, None), ("run", "S", 1), ("lone", None, 1)]


def test_extraction_edges(spark, rows):
    df = spark.createDataFrame([(None, "x", ""), ("a.py", None, ""), ("b.txt", "def f(): pass", ""), ("c.py", "", ""), ("d.js", "function ( {{{ ]] `", ""), ("e.py", "def f(): pass\ndef f(): pass\n" + "x = 1\n" * 20_000, "")], FILES)
    assert rows(X.extract_symbols(df), "id", "name") == [("e.py#f", "f"), ("e.py#f~2", "f")]
    assert X.extract_symbols(df.limit(0)).count() == 0 and X.extract_edges(df.limit(0)).count() == 0


def test_proofs(spark, rows):
    df = tree(
        spark,
        {
            "s/lib/real.ts": "export function work(a) { return a; }\nexport class Tool { static spin() { return 1; } }\n",
            "s/lib/index.ts": "export { work as toil } from './real';\nexport * from './real';\n",
            "s/app.ts": "import { toil as t, Tool } from './lib';\nimport * as all from './lib/real';\nimport { work } from './lib/real';\nfunction work2() { t(1); all.work(2); Tool.spin(); own(); gone(); }\nfunction own() {}\nfunction work() { work(); }\n",
            "p/pkg/__init__.py": "from .core import make\n",
            "p/pkg/core.py": "def make(x):\n    return x\n",
            "p/pkg/use.py": "from . import core\nfrom .core import make as m\nfrom pkg import make\nimport core2\n\ndef f():\n    m(1)\n    make(2)\n    core2.make(3)\n",
        },
    )
    symbols, raw = X.extract_symbols(df), X.extract_edges(df)
    proven = P.proven_calls(raw, symbols, df)
    got = rows(proven.join(raw.select("path", "ord", "name", "recv"), ["path", "ord"]), "path", "recv", "name", "target")
    assert got == sorted([
        ("p/pkg/use.py", None, "m", "p/pkg/core.py#make"), ("p/pkg/use.py", None, "make", "p/pkg/core.py#make"),
        ("s/app.ts", "Tool", "spin", "s/lib/real.ts#Tool.spin"), ("s/app.ts", "all", "work", "s/lib/real.ts#work"), ("s/app.ts", None, "own", "s/app.ts#own"), ("s/app.ts", None, "t", "s/lib/real.ts#work"),
    ], key=repr)


def test_judged(spark, rows):
    found = spark.createDataFrame([("a", 1, "f", "x", "extracted"), ("a", 2, "g", "y", "extracted"), ("a", 3, "h", "z", "inferred")], "path string, line int, name string, target string, confidence string")
    oracle = spark.createDataFrame([("a", 1, "f", "x"), ("a", 1, "f", "q"), ("a", 2, "g", "q"), ("a", 2, "g", None)], "path string, line int, name string, target string")
    assert rows(P.judged(found, oracle)) == [("extracted", 2, 1, 1, 0), ("inferred", 1, 0, 0, 1)]
