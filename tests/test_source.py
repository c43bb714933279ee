"""The scanner of C-like source on files whose functions are known, and byte edits inside them."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomstone.functions import source, text as T
from loomstone.functions.parse import checks_anywhere, parsed_label
from loomstone.operators.spans import apply_edits, greedy_fixes, splice_functions

FILE = """#include <x>
#define BAD(x) { x
// void no() {
namespace a {
class B : public C {
public:
  B(int n) : x_(n), y_{n, 1} { run(); }
  ~B() = default;
  int get() const override { return "}"[0]; }
  template <class T>
  T cast(T v)
  {
    auto f = [](int k) { return k; };
    if (v) { return v; }
    return f('{');
  }
  static int table[];
};
int B::table[] = {1, 2};
struct P { int x; };
enum class E { one, two };
}
extern "C" {
int operator_like(void) { return 0; }
}
B operator+(const B& l, const B& r) { return l; }
bool B::operator()(int k) const { return k; }
int declared(int);
/* int hidden() { } */
const char* raw = R"x(int inner() { )x";
"""


def test_functions_of_a_file():
    found, sound = source.functions(FILE)
    assert sound
    assert [n for *_, n in found] == ["B", "get", "cast", "operator_like", "operator+", "B::operator()"]
    assert FILE[found[2][0] :].startswith("template <class T>") and FILE[: found[2][1]].endswith("f('{');\n  }")


@pytest.mark.parametrize(("code", "ok", "n"), [("int f() { return 1; }", True, 1), ("int f() { return 1;", False, 0), ("", True, 0), ("int f() {} int g() {}", True, 2), ("int x = 3;", True, 0), ('char c = \'"\'; void f() { s = "{"; }', True, 1), ("f() }", False, 0), ("A::A() = default;", True, 0)])
def test_syntax(spark, code, ok, n):
    r = spark.createDataFrame([(code,)], "c string").select(source.syntax_of("c").alias("s")).first().s
    assert (r.parse_ok, r.function_definitions, r.single_function) == (ok, n, n == 1)


def test_lines_and_bytes(spark):
    code = "// é\nint a;\n  int f()\n  {\n    return 1;\n  }\n"
    r = spark.createDataFrame([(code,), (None,)], "c string").select(source.functions_of("c").alias("f")).collect()
    f = r[0].f[0]
    assert (f.name, f.start_line, f.end_line, f.indent) == ("f", 3, 6, "  ") and code.encode()[f.start : f.end].decode() == f.code
    assert r[1].f == []


def test_macros(spark):
    code = "#define CALL(x) x\n  # define ALONE 1\n#define VALUE 2\nvoid f() {\n  CALL(1);\n  ALONE;\n  int a = ALONE;\n  VALUE // note\n  other(1);\n}"
    df = spark.createDataFrame([(code,)], "c string")
    names = df.select(source.defined_macros(F.col("c")).alias("m")).first().m
    assert [(m.name, m.function_like) for m in names] == [("CALL", True), ("ALONE", False), ("VALUE", False)]
    ask = {code.index("CALL(1)"): True, code.index("ALONE;"): True, code.rindex("ALONE"): False, code.index("VALUE //"): True, code.index("other"): False}
    rows = spark.createDataFrame([(code, o) for o in ask], "c string, o int")
    got = rows.select("o", source.at_macro(F.col("c"), F.col("o"), F.array(F.lit("CALL")), F.array(F.lit("ALONE"), F.lit("VALUE"))).alias("m")).collect()
    assert {r.o: r.m for r in got} == ask


EDITS = "array<struct<o:bigint,n:bigint,text:string>>"


def edits(*spans):
    return [Row(o=o, n=n, text=t) for o, n, t in spans]


def test_edits_inside_a_function(spark):
    text = "x\n  int f() {\r\n    a;\r\n  }\ny"
    start, end = text.index("int"), text.index("\ny")
    cases = {"": "int f() {\n  a;\n}", "b": "int f() {\n  b;\n}"}
    at = text.index("a;")
    df = spark.createDataFrame([(text, edits((at, 1, k)) if k else [], k) for k in cases] + [(text, edits((0, 1, "z")), None), (text, edits((end, 1, "z")), None)], f"s string, e {EDITS}, k string")
    got = df.select("k", apply_edits("s", "e", F.lit(start), F.lit(end)).alias("x")).collect()
    assert [r.x for r in got] == [cases[""], cases["b"], None, None]


def test_greedy_fixes(spark):
    code = "void f() {\n\tif (a) b;\n\té = 0;\n}"
    o = lambda s: len(code[: code.index(s)].encode())
    fs = [Row(check="z", fix=edits((o("b;"), 2, "b;\n}"), (o(" b;"), 0, " {"))), Row(check="y", fix=edits((o("b;") + 2, 0, "!"))), Row(check="x", fix=edits((o("0;"), 1, "ü"))), Row(check="w", fix=[])]
    df = spark.createDataFrame([(code, fs), (code, fs[3:]), (code, [Row(check="c", fix=edits((o("é"), 1, "")))]), (None, None)], f"c string, f array<struct<check:string,fix:{EDITS}>>")
    got = [r.r for r in df.select(greedy_fixes("c", "f").alias("r")).collect()]
    assert got[0].code == "void f() {\n\tif (a) { b;\n\t}\n\té = ü;\n}" and got[0].checks == ["x", "z"]
    assert got[1:] == [None, None, None]


def test_splice_function(spark):
    raw = "int g() { }\r\n  int f() {\r\n    return 1;\r\n  }\r\n"
    before = "int f() {\n  return 1;\n}"
    rows = [("int f() {\n  return 2;\n\n}", None), ("int g() {\n  return 2;\n}", "exactly the same named function"), ("int x; int f() { }", "text outside its function"), ("int f() { // NOLINT\n}", "suppression"), ("int f() { } int h() { }", "exactly the same named function")]
    df = spark.createDataFrame([(raw, 2, 4, before, c) for c, _ in rows] + [(raw, 1, 4, before, before), (raw, 2, 4, "int f() { }", before)], "raw string, a int, b int, before string, c string")
    got = [r.spliced for r in splice_functions(df, "raw", "a", "b", "before", "c").collect()]
    assert got[0].text == "int g() { }\r\n  int f() {\r\n    return 2;\r\n\r\n  }\r\n" and got[0].reject is None
    for r, (_, why) in zip(got[1:], rows[1:], strict=False):
        assert r.text is None and why in r.reject
    assert all("no longer matches" in r.reject for r in got[5:])


def test_answers_inside_others(spark):
    texts = {'{ bad {"checks": ["a"]} }': (["a"], True), '{ oops {"checks": ["a"]}': (["a"], True), '{"r": {"checks": ["a"]}}': (["a"], True), '} {"checks": 1} {"checks": ["b", 2]}': (["b"], True), "{" * 2000: ([], False)}
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", checks_anywhere("s").alias("r")).collect()
    assert {r.s: (r.r.checks, r.r.valid) for r in got} == texts


def test_fences(spark):
    texts = {"say\n```cpp\nint a;\n  ```\n```\nbye": "int a;\n  ```", "inline ```cpp\nx\n``` end": "inline ```cpp\nx\n``` end", "```python\nx\n```": "```python\nx\n```", "```C++\r\n x \n```  ": "x", "```\na\n```\n```\nb\n```": "```\na\n```\n```\nb\n```", " plain ": "plain", "```c\nx": "```c\nx"}
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.fenced(F.col("s")).alias("r")).collect()
    assert {r.s: r.r for r in got} == texts


def test_labels(spark):
    texts = {
        '{"smells": ["B, A"], "severity": 5, "explanation": "x-y, a-b, x-y"}': (["A", "B"], 5, ["a-b", "x-y"], None),
        '{"smells": [], "severity": 0, "explanation": "No smells detected"}': ([], 0, [], None),
        '{"smells": [], "severity": 1, "explanation": "No smells detected"}': (None, None, None, "clean label with severity or checks set"),
        '{"smells": ["Other"], "severity": 1, "explanation": "x-y"}': (None, None, None, "category outside the vocabulary"),
        '{"smells": ["A"], "severity": 1, "explanation": "Not a check"}': (None, None, None, "smelly label without valid check names"),
        '{"smells": ["A"], "severity": 1}': (None, None, None, "unexpected label keys"),
        "[1]": (None, None, None, "unexpected label keys"), "{": (None, None, None, "label is not JSON"),
    }
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", parsed_label(F.col("s"), ["A", "B"]).alias("r")).collect()
    assert {r.s: (r.r.smells, r.r.severity, r.r.checks, r.r.reject) for r in got} == texts


def test_quick_ratio(spark):
    from collections import Counter

    pairs = [("abc", "bcd"), ("", ""), ("aab", ""), ("x" * 4000 + "y", "y"), ("é\U0001f600a", "a\U0001f600"), (None, "a")]
    got = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>").select("i", T.quick_ratio(F.col("p.a"), F.col("p.b")).alias("r")).collect()
    for r in got:
        a, b = ((x or "")[:3000] for x in pairs[r.i])
        want = 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a or b else 1.0
        assert abs(r.r - want) < 1e-12, r
