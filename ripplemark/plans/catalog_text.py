"""Registered queries of the functions over source text, paths and reports.

Each runs over one text for every part of the star schema.  A text is one of several written out here, with the part's
key in it and a number of blank lines before it; what must come out is written beside it, and the SQL only lists that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import extract as E
from ripplemark.functions import scalars as X
from ripplemark.plans.catalog import ORACLE_SQL, QUERIES, table
from ripplemark.sources import files as S
from ripplemark.sources import git

KEY = "CAST(p_partkey AS STRING)"


def quoted(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


def keyed(text: str | None) -> str:
    """SQL for ``text`` with the key in the place of ``{k}``."""
    return f"replace({quoted(text)}, '{{k}}', {KEY})" if text and "{k}" in text else quoted(text)


def _chosen(texts: list[str | None]) -> Column:
    """The text that a part has, with its key in it."""
    key, out = F.col("p_partkey"), F.lit(None).cast("string")
    for i, t in enumerate(texts):
        if t is not None:
            out = F.when(key % len(texts) == i, F.replace(F.lit(t), F.lit("{k}"), key.cast("string"))).otherwise(out)
    return out


def register(name: str, run, sql: str | None) -> None:
    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def extraction(name: str, path: str, variants: list[tuple[str, list[tuple]]], make, columns: list[str], shift: tuple[str, ...] = ()) -> None:
    """A table function over files at ``path``: every variant is a text and the rows that it gives.

    ``shift`` columns are line numbers, moved by the blank lines before the text.
    """

    def run(spark, sf_dir: str) -> DataFrame:
        blank = F.repeat(F.lit("\n"), (F.col("p_partkey") % 5).cast("int"))
        files = table(spark, sf_dir, "part").select(_chosen([path] * len(variants)).alias("file_path"), F.concat(blank, _chosen([t for t, _ in variants])).alias("content"))
        return make(files).select("file_path", *columns)

    rows = []
    for i, (_, expected) in enumerate(variants):
        for r in expected:
            values = [f"CAST({v} + p_partkey % 5 AS INT) AS {c}" if c in shift else f"CAST({v} AS DOUBLE) AS {c}" if isinstance(v, float) else f"{keyed(v)} AS {c}" for c, v in zip(columns, r, strict=True)]
            rows.append(f"SELECT {keyed(path)} AS file_path, {', '.join(values)} FROM part WHERE p_partkey % {len(variants)} = {i}")
    register(name, run, " UNION ALL ".join(rows))


def cases(name: str, function, variants: list[tuple[tuple[str | None, ...], str | None]]) -> None:
    """A column function of strings: every variant is its arguments and the result as text."""

    def run(spark, sf_dir: str) -> DataFrame:
        args = [_chosen([v[0][i] for v in variants]).alias(f"a{i}") for i in range(len(variants[0][0]))]
        rows = table(spark, sf_dir, "part").select("p_partkey", *args)
        return rows.select("p_partkey", function(*[F.col(f"a{i}") for i in range(len(args))]).cast("string").alias("result"))

    whens = " ".join(f"WHEN {i} THEN {keyed(out)}" for i, (_, out) in enumerate(variants))
    register(name, run, f"SELECT p_partkey, CASE p_partkey % {len(variants)} {whens} END AS result FROM part")


# --- code units --------------------------------------------------------------------------------------------------

UNITS: dict[str, tuple[str, list[tuple[str, list[tuple]]]]] = {
    "py": ("s/f{k}.py", [
        ("import os\n\nclass C{k}(Base):\n    @property\n    def go(self):\n        return 1\n\n    async def stay(self):\n        pass\n\ndef top{k}():\n    def inner():\n        return {}\n    return inner\n",
         [("C{k}", "class", 3, 9), ("C{k}.go", "function", 5, 6), ("C{k}.stay", "async_function", 8, 9), ("top{k}", "function", 11, 14), ("inner", "function", 12, 13)]),
        ("if True:\n    def guarded{k}(): return 'def no(): pass'\nx = lambda: 0\n", [("guarded{k}", "function", 2, 2)]),
        ("'''def text{k}(): pass'''\n", []),
    ]),
    "py_broken": ("s/b{k}.py", [
        ("class C{k}:\n    def go(self):\n        x = (\n\ndef top{k}(:\n    return 1\n", [("C{k}", "class", 1, 3), ("C{k}.go", "function", 2, 3), ("top{k}", "function", 5, 6)]),
        ("async def wait{k}(a):\n    b = [\n    c\nprint(\n", [("wait{k}", "async_function", 1, 3)]),
    ]),
    "js": ("s/f{k}.js", [
        ("export default async function load{k}(a) {\n  if (a) { return \"}\"; }\n  /* } */\n}\nexport class K{k} extends Base {\n}\n", [("load{k}", "function", 1, 4), ("K{k}", "class", 5, 6)]),
        ("const add{k} = (a, b) => {\n  return a + b;\n};\nlet one{k} = async x => x;\n", [("add{k}", "function", 1, 3), ("one{k}", "function", 4, 4)]),
        ("describe('suite {k}', () => {\n  it(\"works {k}\", () => {\n    f(`}`);\n  });\n  test.only('more', () => {});\n});\n", [("suite {k}", "test_suite", 1, 6), ("works {k}", "test_case", 2, 4), ("more", "test_case", 5, 5)]),
    ]),
    "go": ("s/f{k}.go", [
        ("package p\n\nfunc Run{k}(a int) error {\n\treturn nil\n}\n\ntype T{k} struct {\n\tx int\n}\n\nfunc (t *T{k}) Go() {\n}\n", [("Run{k}", "function", 3, 5), ("T{k}", "struct", 7, 9), ("Go", "function", 11, 12)]),
        ("type I{k} interface {\n\tM()\n}\nfunc Map{k}[T any](x T) T {\n\treturn x // }\n}\n", [("I{k}", "interface", 1, 3), ("Map{k}", "function", 4, 6)]),
    ]),
    "rust": ("s/f{k}.rs", [
        ("pub struct S{k} {\n  x: u8,\n}\n\nimpl S{k} {\n  pub async fn go(&self) -> u8 {\n    1\n  }\n}\n", [("S{k}", "struct", 1, 3), ("S{k}", "impl", 5, 9), ("go", "function", 6, 8)]),
        ("enum E{k} { A, B }\npub(crate) unsafe fn raw{k}<T>(t: T) {\n}\n", [("E{k}", "enum", 1, 1), ("raw{k}", "function", 2, 3)]),
    ]),
    "csharp": ("s/F{k}.cs", [
        ("public sealed class C{k}\n{\n    [Fact]\n    public async Task<int> Go{k}(int a)\n    {\n        return 1;\n    }\n}\n", [("C{k}", "class", 1, 8), ("Go{k}", "function", 4, 7)]),
        ("internal interface I{k} {\n}\npublic record R{k} {\n}\nenum E{k} { A }\n", [("I{k}", "interface", 1, 2), ("R{k}", "record", 3, 4), ("E{k}", "enum", 5, 5)]),
    ]),
    "java": ("s/F{k}.java", [
        ("public final class C{k} {\n  @Override\n  public static int go{k}(int a) {\n    return a;\n  }\n}\n", [("C{k}", "class", 1, 6), ("go{k}", "function", 3, 5)]),
        ("interface I{k} {\n  void m{k}();\n}\nenum E{k} { A }\n", [("I{k}", "interface", 1, 3), ("m{k}", "function", 2, 2), ("E{k}", "enum", 4, 4)]),
    ]),
    "cpp": ("s/f{k}.cpp", [
        ("namespace n{k} {\nclass C{k} {\n};\n}\nint C{k}::go(int a) {\n  return a; // }\n}\n", [("n{k}", "namespace", 1, 4), ("C{k}", "class", 2, 3), ("C{k}::go", "function", 5, 7)]),
        ("template <class T>\nstruct S{k} {\n};\nenum class E{k} { A };\nstatic inline int f{k}(int a) {\n}\n", [("S{k}", "struct", 2, 3), ("E{k}", "enum", 4, 4), ("f{k}", "function", 5, 6)]),
    ]),
    "kotlin": ("s/f{k}.kt", [
        ("data class D{k}(val x: Int) {\n  override fun go{k}(): Int {\n    return 1\n  }\n}\n", [("D{k}", "class", 1, 5), ("go{k}", "function", 2, 4)]),
        ("object O{k} {\n}\ninterface I{k} {\n}\nsuspend fun String.ext{k}() {\n}\n", [("O{k}", "object", 1, 2), ("I{k}", "interface", 3, 4), ("ext{k}", "function", 5, 6)]),
    ]),
    "swift": ("s/f{k}.swift", [
        ("final class C{k} {\n  static func go{k}() {\n  }\n}\n", [("C{k}", "class", 1, 4), ("go{k}", "function", 2, 3)]),
        ("protocol P{k} {\n}\nactor A{k} {\n}\npublic struct S{k} {\n}\n", [("P{k}", "protocol", 1, 2), ("A{k}", "actor", 3, 4), ("S{k}", "struct", 5, 6)]),
    ]),
    "php": ("s/f{k}.php", [
        ("<?php\nabstract class C{k} {\n  public static function go{k}() {\n  }\n}\n", [("C{k}", "class", 2, 5), ("go{k}", "function", 3, 4)]),
        ("<?php\ntrait T{k} {\n}\nfunction free{k}($a) {\n}\n", [("T{k}", "trait", 2, 3), ("free{k}", "function", 4, 5)]),
    ]),
    "ruby": ("s/f{k}.rb", [
        ("module M{k}\n  class C{k}\n    def go?\n      1\n    end\n  end\nend\n", [("M{k}", "module", 1, 7), ("C{k}", "class", 2, 6), ("go?", "function", 3, 5)]),
        ("def self.top{k}(a)\n  if a\n    b\n  end\nend\n", [("top{k}", "function", 1, 5)]),
    ]),
    "dart": ("s/f{k}.dart", [
        ("abstract class C{k} {\n  int go{k}(int x) {\n    return x;\n  }\n}\n", [("C{k}", "class", 1, 5), ("go{k}", "function", 2, 4)]),
        ("mixin M{k} {\n}\nvoid main{k}() {\n}\n", [("M{k}", "mixin", 1, 2), ("main{k}", "function", 3, 4)]),
    ]),
}

for _name, (_path, _variants) in UNITS.items():
    extraction(f"extract_units_{_name}", _path, _variants, lambda f: E.code_units(f), ["name", "unit_type", "line_start", "line_end"], ("line_start", "line_end"))


# --- dependencies ------------------------------------------------------------------------------------------------

_PLAIN = ["name", "dep_type", "module_path"]
DEPS: dict[str, tuple[str, list[tuple[str, list[tuple]]]]] = {
    "py": ("s/f{k}.py", [
        ("import os\nimport a.b{k}\nfrom pkg.m{k} import x, y as z\nx(1)\nobj.call{k}()\n", [("os", "import", "os"), ("b{k}", "import", "a.b{k}"), ("x", "import", "pkg.m{k}"), ("y", "import", "pkg.m{k}"), ("x", "call", None), ("call{k}", "call", None)]),
        ("def f{k}():\n    import late{k}\n    return f{k}\n", [("late{k}", "import", "late{k}")]),
    ]),
    "py_broken": ("s/b{k}.py", [
        ("from m{k} import x\nimport os\nif go{k}(:\n", [("x", "import", "m{k}"), ("os", "import", "os"), ("go{k}", "call", None)]),
        ("while (a{k}(\n", [("a{k}", "call", None)]),
    ]),
    "go": ("s/f{k}.go", [
        ("import (\n\t\"fmt\"\n\tu \"ex.com/m/util{k}\"\n)\n", [("fmt", "import", "fmt"), ("util{k}", "import", "ex.com/m/util{k}")]),
        ("import \"a/b{k}\"\n", [("b{k}", "import", "a/b{k}")]),
    ]),
    "rust": ("s/f{k}.rs", [
        ("use crate::a::{b{k}, c as d};\n", [("b{k}", "import", "crate.a"), ("c", "import", "crate.a")]),
        ("use std::fs::File{k};\n", [("File{k}", "import", "std.fs")]),
    ]),
    "csharp": ("s/F{k}.cs", [("using A.B{k};\nusing static M.Math;\n", [("B{k}", "import", "A.B{k}"), ("Math", "import", "M.Math")]), ("// nothing {k}\n", [])]),
    "java": ("s/F{k}.java", [("import a.b.C{k};\nimport static a.D.e;\nimport a.x.*;\n", [("C{k}", "import", "a.b.C{k}"), ("e", "import", "a.D.e")]), ("import q.R{k};\n", [("R{k}", "import", "q.R{k}")])]),
    "kotlin": ("s/f{k}.kt", [("import a.b.C{k}\nimport a.x.*\n", [("C{k}", "import", "a.b.C{k}")]), ("val x = {k}\n", [])]),
    "cpp": ("s/f{k}.cpp", [("#include <vector>\n#include \"x/y{k}.h\"\n", [("vector", "import", "vector"), ("y{k}", "import", "x/y{k}.h")]), ("int a{k};\n", [])]),
    "swift": ("s/f{k}.swift", [("@testable import App{k}\nimport struct Lib.Thing\n", [("App{k}", "import", "App{k}"), ("Thing", "import", "Lib.Thing")]), ("let a = {k}\n", [])]),
    "php": ("s/f{k}.php", [("<?php\nuse A\\B{k};\nrequire_once 'x/y{k}.php';\n", [("B{k}", "import", "A\\B{k}"), ("y{k}", "import", "x/y{k}.php")]), ("<?php\necho {k};\n", [])]),
    "ruby": ("s/f{k}.rb", [("require 'json'\nrequire_relative 'lib/z{k}'\n", [("json", "import", "json"), ("z{k}", "import", "lib/z{k}")]), ("puts {k}\n", [])]),
    "dart": ("s/f{k}.dart", [("import 'package:p/q{k}.dart';\n", [("q{k}", "import", "package:p/q{k}.dart")]), ("var a = {k};\n", [])]),
}

for _name, (_path, _variants) in DEPS.items():
    extraction(f"extract_deps_{_name}", _path, _variants, lambda f: E.dependencies(f), _PLAIN)

_FULL = ["name", "dep_type", "module_path", "require_type", "confidence", "taint_source"]


def _js(name: str, kind: str, module: str | None, how: str | None = None, confidence: float = -1.0, taint: str | None = None) -> tuple:
    return (name, kind, module, how, confidence, taint)


JS_DEPS = [
    ("import D, { a as b } from './m{k}.js';\nimport * as all from \"lib{k}\";\ngo{k}(1);\n",
     [_js("m{k}", "import", "./m{k}.js"), _js("D", "import", "./m{k}.js"), _js("a", "import", "./m{k}.js"), _js("lib{k}", "import", "lib{k}"), _js("go{k}", "call", None)]),
    ("const P = './x{k}';\nrequire(P);\nrequire(other);\nconst { Z } = require('./z{k}');\nimport('./lazy{k}');\n",
     [_js("z{k}", "import", "./z{k}"), _js("Z", "import", "./z{k}"), _js("import(./lazy{k})", "dynamic_import", "./lazy{k}"), _js("require(P)", "tainted_import", "./x{k}", "variable", 1.0, "P=./x{k}"), _js("require(other)", "dynamic_import", "other", "variable", 0.3)]),
    ("require(`./p{k}/${n}`);\nrequire('./d{k}/' + n);\nrequire(a ? './a{k}' : './b');\nrequire(path.join(__dirname, 'plug{k}', n));\nnew Function('x');\n",
     [_js("require(`./p{k}/${n}`)", "dynamic_import", "./p{k}/${n}", "template", 0.4), _js("require('./d{k}/' + ...)", "dynamic_import", "./d{k}/", "concat", 0.2), _js("require(cond ? './a{k}' : './b')", "dynamic_import", "./a{k}|./b", "conditional", 0.3),
      _js("new Function(...)", "eval_import", None, "eval", 0.0), _js("require(path.join(__dirname, 'plug{k}', ...))", "dynamic_import", "plug{k}", "path_join", 0.2), _js("join", "call", None), _js("Function", "call", None)]),
]


extraction("extract_deps_js", "s/f{k}.js", JS_DEPS, lambda f: E.dependencies(f).fillna(-1.0, ["confidence"]), _FULL)


# --- test files and test units -----------------------------------------------------------------------------------

extraction("extract_test_units_py", "t/test_f{k}.py", [
    ("class TestA{k}:\n    def test_x(self):\n        pass\n    def helper(self):\n        pass\n\ndef test_top{k}():\n    pass\n\ndef util():\n    pass\n", [("t/test_f{k}.py:TestA{k}", "TestA{k}", "pytest"), ("t/test_f{k}.py:TestA{k}.test_x", "TestA{k}.test_x", "pytest"), ("t/test_f{k}.py:test_top{k}", "test_top{k}", "pytest")]),
    ("def nothing{k}():\n    pass\n", []),
], lambda f: E.test_units(f), ["id", "name", "framework"])

extraction("extract_test_units_js", "t/f{k}.spec.js", [
    ("describe('s{k}', () => {\n  it('a', () => {});\n});\nfunction util() {\n}\n", [("t/f{k}.spec.js:s{k}", "s{k}", "jest"), ("t/f{k}.spec.js:a", "a", "jest")]),
    ("import { test } from '@playwright/test';\ntest('p{k}', async () => {});\n", [("t/f{k}.spec.js:p{k}", "p{k}", "playwright")]),
], lambda f: E.test_units(f), ["id", "name", "framework"])

extraction("extract_test_units_marked", "t/F{k}Test.java", [
    ("class F{k}Test {\n  @Test\n  public void works{k}() {\n  }\n  void other() {\n  }\n}\n", [("t/F{k}Test.java:works{k}", "works{k}", "junit")]),
    ("class F{k}Test {\n  @ParameterizedTest(name = \"x\")\n  void each{k}() {\n  }\n  void testOld() {\n  }\n}\n", [("t/F{k}Test.java:each{k}", "each{k}", "junit"), ("t/F{k}Test.java:testOld", "testOld", "junit")]),
], lambda f: E.test_units(f), ["id", "name", "framework"])

extraction("extract_test_units_rust", "t/f{k}.rs", [
    ("#[test]\nfn checks{k}() {\n}\nfn helper() {\n}\n", [("t/f{k}.rs:checks{k}", "checks{k}", "rust")]),
    ("#[tokio::test]\nasync fn waits{k}() {\n}\n", [("t/f{k}.rs:waits{k}", "waits{k}", "rust")]),
    ("fn plain{k}() {\n}\n", []),
], lambda f: E.test_units(f), ["id", "name", "framework"])

cases("is_test_file", lambda p, c: X.is_test_file(p, c), [
    (("a/test_f{k}.py", ""), "true"), (("a/f{k}.py", "def test(): pass"), "false"), (("a/f{k}.rs", "#[cfg(test)]"), "true"), (("a/f{k}.rs", "fn main() {}"), "false"),
    (("a/f{k}.cc", "TEST_F(A, b) {}"), "true"), (("a/f{k}.c", "int main;"), "false"), (("a/F{k}Tests.cs", ""), "true"), (("a/f{k}_spec.rb", None), "true"), (("a/f{k}.txt", "TEST("), "false"),
])

cases("test_framework_by_content", lambda p, c: X.test_framework(p, c), [
    (("a/f{k}.spec.ts", "import x from 'playwright'"), "playwright"), (("a/f{k}.spec.ts", "it('x')"), "jest"), (("a/f{k}.rs", "#[rstest]"), "rust"), (("a/f{k}.cpp", "BOOST_AUTO_TEST_CASE(x)"), "gtest"), (("a/f{k}.py", ""), None),
])

cases("is_test_name", lambda n, f: X.is_test_name(n, f), [
    (("A.test_x{k}", "pytest"), "true"), (("x{k}", "pytest"), "false"), (("TestX{k}", "go"), "true"), (("BenchmarkX{k}", "go"), "true"), (("testX{k}", "junit"), "true"), (("x{k}Test", "junit"), "false"), (("any{k}", "gtest"), "true"), (("X{k}Tests", "csharp_test"), "true"), (("it", "jest"), "true"), (("run{k}", "unknown"), "false"),
])


# --- paths and modules -------------------------------------------------------------------------------------------

cases("normal_path", X.normal_path, [(("./a/f{k}.py",), "a/f{k}.py"), (("a/./b/../c{k}.py",), "a/c{k}.py"), (("a\\b\\f{k}.py",), "a/b/f{k}.py"), (("../up{k}.py",), "../up{k}.py"), (("a/b/../../../x{k}",), "../x{k}"), (("a//b{k}/",), "a/b{k}")])
cases("resolve_js", lambda t, m: X.resolve_js(t, m), [(("web/t{k}.test.js", "./m{k}"), "web/m{k}"), (("web/a/t.js", "../m{k}.ts"), "web/m{k}"), (("t{k}.js", "./lib/m.jsx"), "lib/m"), (("web/t{k}.js", "react"), None), (("a/b/t{k}.js", "../../x/./y{k}"), "x/y{k}")])
cases("module_reaches_path", lambda p, m: F.array_contains(X.suffix_keys(p), X.module_key(m)), [(("src/pkg/m{k}.py", "pkg.m{k}"), "true"), (("src/pkg/m{k}.py", "m{k}"), "true"), (("src/pkg/__init__.py", "pkg"), "true"), (("src/pkg{k}/m.py", "kg{k}.m"), "false"), (("src/m{k}.py", "src.other"), "false")])
cases("go_module_name", X.go_module_name, [(("module ex.com/app{k}\n\ngo 1.22\n",), "ex.com/app{k}"), (("// x\n  module m{k}\n",), "m{k}"), (("go 1.22 // {k}\n",), None)])
cases("resolve_go", lambda m, i: X.resolve_go(m, i), [(("ex.com/app{k}", "ex.com/app{k}/pkg/a"), "pkg/a"), (("ex.com/app{k}", "ex.com/app{k}"), ""), (("ex.com/app{k}", "other.com/x"), None), (("ex.com/app{k}", "ex.com/app{k}x/y"), None)])
cases("directoryish", X.directoryish, [(("plugins{k}",), "true"), (("a/b{k}",), "false"), (("x{k}.js",), "false"), (("",), "false")])
cases("has_code_extension", X.has_code_extension, [(("a/f{k}.PY",), "true"), (("a/f{k}.tsx",), "true"), (("a/f{k}.md",), "false"), (("Makefile{k}",), "false"), (("a.py/f{k}",), "false"), (("f{k}.hxx",), "true")])
cases("in_directory", lambda p, d: F.when(d == "src", X.in_directory(p, "src/")).otherwise(X.in_directory(p, "lib")), [(("src/a{k}.py", "src"), "true"), (("srcs/a{k}.py", "src"), "false"), (("lib/x/a{k}.py", "lib"), "true"), (("lib", "lib"), "false")])
cases("eval_count", X.eval_count, [(("new Function('a{k}')",), "1"), (("x = new  Function (a); y = new Function(b)",), "2"), (("function f{k}() {}",), "0"), ((None,), "0")])
cases("plugin_signals", lambda c: F.concat_ws(",", *[X.plugin_signals(c)[n].cast("string") for n in X.PLUGIN_SIGNS]), [
    (("registerPlugin('a{k}')",), "true,false,false,false"), (("new PluginManager({k})",), "false,true,false,false"), (("see plugins/{k}",), "false,false,true,false"), (("require('./lib/plugins')",), "false,false,true,true"), (("x{k}",), "false,false,false,false"),
])
cases("sqrt_confidence", lambda c: F.round(F.sqrt(c.cast("double")), 4), [(("0.25",), "0.5"), (("1.0",), "1.0"), (("0.09",), "0.3"), ((None,), None)])
cases("query_threshold", lambda t, a: X.query_threshold(t.cast("int"), a.cast("int")), [(("5", "1"), "2"), (("5", "2"), "5"), (("1", "0"), "1"), (("8", "1"), "4")])
cases("iso_timestamps", lambda t: F.date_format(F.to_utc_timestamp(X.timestamp(t), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), [(("2026-03-01T12:00:00+05:00",), "2026-03-01 07:00:00"), (("2026-03-01T12:00:00Z",), "2026-03-01 12:00:00"), (("2026-03-01",), "2026-03-01 00:00:00"), (("yesterday {k}",), None)])


# --- diffs, blame and reports ------------------------------------------------------------------------------------

cases("functions_of_diff", lambda d: F.array_join(git.functions_of_diff(d), ","), [
    (("@@ -1,2 +3,4 @@ def load{k}(a):\n-x\n+y\n@@ -9 +9 @@ class K{k}:\n",), "load{k},K{k}"), (("@@ -1 +1 @@ func (t *T) Run{k}() {\n@@ -5 +5 @@ func (t *T) Run{k}() {\n",), ""), (("@@ -1 +1 @@ export function go{k}() {\n",), "go{k}"), (("@@ -1 +1 @@\n+{k}\n",), ""),
])


def _pytest(spark, sf_dir: str) -> DataFrame:
    lines = ["t/test_a.py::test_x{k} PASSED [ 10%]", "t/test_a.py::T::test_y{k} FAILED", "t/test_a.py::test_s{k} SKIPPED (why)", "collected {k} items", "t/test_a.py::test_f{k} XFAIL", "t/test_a.py::test_p{k} XPASS", "t/test_a.py::test_e{k} ERROR"]
    return S.pytest_results(table(spark, sf_dir, "part").select(_chosen(lines).alias("value"))).select("test_id", "passed")


_OUTCOMES = {0: ("t/test_a.py:test_x{k}", "true"), 1: ("t/test_a.py:T:test_y{k}", "false"), 2: ("t/test_a.py:test_s{k}", "false"), 4: ("t/test_a.py:test_f{k}", "true"), 5: ("t/test_a.py:test_p{k}", "false"), 6: ("t/test_a.py:test_e{k}", "false")}
register("pytest_results", _pytest, " UNION ALL ".join(f"SELECT {keyed(t)} AS test_id, {p} AS passed FROM part WHERE p_partkey % 7 = {i}" for i, (t, p) in _OUTCOMES.items()))


def _jest(spark, sf_dir: str) -> DataFrame:
    """A report for every event: written as JSON to the shared folder, then read as reports are."""
    import uuid

    from ripplemark.session import shared_dir

    events = table(spark, sf_dir, "events")
    one = F.struct(F.concat(F.lit("x "), F.col("event_id").cast("string")).alias("fullName"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"), F.col("value").alias("duration"))
    suite = F.struct(F.concat(F.lit("/w/p/u"), F.col("user_id").cast("string"), F.lit(".test.js")).alias("name"), F.array(one).alias("assertionResults"))
    folder = f"{shared_dir(spark)}/jest-{uuid.uuid4().hex}"
    events.select(F.array(suite).alias("testResults")).write.json(folder)
    rows = spark.read.schema(S.JEST).json(folder)
    return S.jest_rows(rows, "/w/p").select("test_id", "passed", "duration_ms")


register("jest_results", _jest, "SELECT concat('u', CAST(user_id AS STRING), '.test.js:t', CAST(event_id AS STRING)) AS test_id, event_type <> 'error' AS passed, CAST(round(value) AS BIGINT) AS duration_ms FROM events")


def _blame(spark, sf_dir: str) -> DataFrame:
    """Lines of a file for each user, the event types as its commits."""
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_path"), line.alias("line"), F.col("event_type").alias("commit_hash"), F.col("event_type").alias("author"), F.concat(F.col("event_type"), F.lit("@x")).alias("author_email"), F.lit("d").alias("date"))
    gone = e.where("line % 11 <> 0")
    return git.blame_blocks(gone).select("file_path", F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"), "commit_hash", "author_email")


register("blame_blocks", _blame, """WITH e AS (SELECT CAST(user_id AS STRING) AS file_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, event_type FROM events),
 g AS (SELECT *, line - row_number() OVER (PARTITION BY file_path, event_type ORDER BY line) AS island FROM e WHERE line % 11 <> 0)
 SELECT file_path, min(line) AS line_start, max(line) AS line_end, event_type AS commit_hash, concat(event_type, '@x') AS author_email FROM g GROUP BY file_path, event_type, island""")  # fmt: skip


def _custom(spark, sf_dir: str) -> DataFrame:
    """A registered extractor takes the place of the built-in one, and leaves when it is taken off."""
    E.register_unit_extractor("ruby", lambda path, content: [(content.strip(), "line", 1, 1)])
    try:
        files = table(spark, sf_dir, "part").select(_chosen(["s/f{k}.rb"]).alias("file_path"), F.col("p_name").alias("content"))
        return E.code_units(files).select("file_path", "name", "unit_type")
    finally:
        E.unregister_unit_extractor("ruby")


register("custom_unit_extractor", _custom, f"SELECT concat('s/f', {KEY}, '.rb') AS file_path, trim(p_name) AS name, 'line' AS unit_type FROM part")


def _custom_deps(spark, sf_dir: str) -> DataFrame:
    E.register_dep_extractor("dart", lambda content: [{"name": content.strip(), "dep_type": "import", "module_path": "m"}])
    try:
        files = table(spark, sf_dir, "part").select(_chosen(["s/f{k}.dart"]).alias("file_path"), F.col("p_name").alias("content"))
        return E.dependencies(files).select("file_path", "name", "module_path")
    finally:
        E.unregister_dep_extractor("dart")


register("custom_dep_extractor", _custom_deps, f"SELECT concat('s/f', {KEY}, '.dart') AS file_path, trim(p_name) AS name, 'm' AS module_path FROM part")
