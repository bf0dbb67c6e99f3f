"""Extraction, edges, git, stores, streams and the project queries."""

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from ripplemark.functions import extract
from ripplemark.operators import control, edges
from ripplemark.operators.store import Store
from ripplemark.plans.project import QUERIES, Project, shard_prefixes
from ripplemark.sources import files as file_source
from ripplemark.sources import git
from ripplemark.streaming import streams


def units(path, text):
    return [u[:2] for u in extract.code_units_of(path, text)]


@pytest.mark.parametrize(
    ("path", "text", "expected"),
    [
        ("a.py", "class A:\n    async def f(self):\n        pass\n\ndef g():\n    def h(): pass\n", [("A", "class"), ("A.f", "async_function"), ("g", "function"), ("h", "function")]),
        ("a.py", "class A:\n  def f(self):\n    x = (\n\ndef g(:\n", [("A", "class"), ("A.f", "function"), ("g", "function")]),
        ("a.js", "export async function f(a) {\n}\nclass B extends C {\n}\nconst g = (x) => x;\ndescribe('s', () => {\n  it('does', () => {});\n});", [("f", "function"), ("B", "class"), ("g", "function"), ("s", "test_suite"), ("does", "test_case")]),
        ("a.go", "type T struct {\n}\nfunc (t *T) M() {\n}\nfunc TestX(t *testing.T) {\n}", [("T", "struct"), ("M", "function"), ("TestX", "function")]),
        ("a.rs", "pub struct S {\n}\nimpl S {\n  pub fn new() -> S {\n  }\n}\nenum E { A }", [("S", "struct"), ("S", "impl"), ("new", "function"), ("E", "enum")]),
        ("A.java", "public class A {\n  @Test\n  public void works() {\n    return;\n  }\n}", [("A", "class"), ("works", "function")]),
        ("A.cs", "public class A\n{\n  [Fact]\n  public void Works()\n  {\n  }\n}", [("A", "class"), ("Works", "function")]),
        ("a.cpp", "namespace n {\nclass C {\n};\nint C::run(int a) {\n  return f(a);\n}\n}", [("n", "namespace"), ("C", "class"), ("C::run", "function")]),
        ("a.kt", "data class D(val x: Int)\nfun f(): Int {\n return 1\n}", [("D", "class"), ("f", "function")]),
        ("a.swift", "final class C {\n  func go() {\n  }\n}\nprotocol P {\n}", [("C", "class"), ("go", "function"), ("P", "protocol")]),
        ("a.php", "<?php\nabstract class C {\n  public static function f() {\n  }\n}", [("C", "class"), ("f", "function")]),
        ("a.rb", "module M\n  class C\n    def self.f?\n    end\n  end\nend", [("M", "module"), ("C", "class"), ("f?", "function")]),
        ("a.dart", "class C {\n  int f(int x) {\n    return x;\n  }\n}", [("C", "class"), ("f", "function")]),
        ("a.txt", "def f(): pass", []),
    ],
)
def test_code_units(path, text, expected):
    assert units(path, text) == expected


def test_block_ends():
    text = 'function f() {\n  const s = "}";\n  /* } \n } */\n  if (x) { y(); } // }\n}\nfunction g() { }'
    assert [u[2:] for u in extract.code_units_of("a.js", text)] == [(1, 6), (7, 7)]
    assert extract.code_units_of("a.rb", "def f\n  if x\n  end\nend\n")[0][2:] == (1, 4)


def test_dependencies():
    deps = {(d["name"], d["dep_type"]): d for d in extract.dependencies_of("a.js", "const P = './x';\nrequire(P); require(q); require(`./p/${n}`); require('./d/' + n); require(a ? './a' : './b');\nrequire(path.join(__dirname, 'plugins', n)); new Function('x');\nimport D, { a as b } from './m/k.js'; const { Z: y } = require('./z'); import('./lazy'); go(1);")}
    assert deps["require(P)", "tainted_import"]["module_path"] == "./x" and deps["require(P)", "tainted_import"]["confidence"] == 1.0
    assert [deps[k, "dynamic_import"]["confidence"] for k in ("require(q)", "require(`./p/${n}`)", "require('./d/' + ...)", "require(cond ? './a' : './b')", "require(path.join(__dirname, 'plugins', ...))")] == [0.3, 0.4, 0.2, 0.3, 0.2]
    assert deps["new Function(...)", "eval_import"]["confidence"] == 0.0 and deps["import(./lazy)", "dynamic_import"]["module_path"] == "./lazy"
    assert all(deps[n, "import"]["module_path"] == m for n, m in (("D", "./m/k.js"), ("a", "./m/k.js"), ("k", "./m/k.js"), ("Z", "./z"))) and ("go", "call") in deps
    python = {(d["name"], d["dep_type"], d["module_path"]) for d in extract.dependencies_of("a.py", "import a.b\nfrom m import x\nx.go(1)")}
    assert python == {("b", "import", "a.b"), ("x", "import", "m"), ("go", "call", None)}
    names = {p: [d["name"] for d in extract.dependencies_of(p, t)] for p, t in {"a.go": 'import (\n "fmt"\n "ex.com/m/util"\n)', "a.rs": "use crate::a::{b, c as d};", "a.cs": "using A.B;", "A.java": "import a.b.C;\nimport a.*;", "a.c": '#include "x/y.h"', "a.swift": "@testable import App", "a.php": "use A\\B;\nrequire 'x/y.php';", "a.rb": "require_relative 'lib/z'", "a.dart": "import 'package:p/q.dart';"}.items()}
    assert names == {"a.go": ["fmt", "util"], "a.rs": ["b", "c"], "a.cs": ["B"], "A.java": ["C"], "a.c": ["y"], "a.swift": ["App"], "a.php": ["B", "y"], "a.rb": ["z"], "a.dart": ["q"]}


def test_marked_names(spark):
    """What an annotation marks: the function that it stands before, past other annotations and modifiers, and nothing else."""
    rows = [
        ("junit", "@Test\n@Tag(\"slow\")\npublic <T> List<Map<K, V>> a(T t) {}\n@Test(timeout = 5) void b() {}\n@TestOnly void c() {}\n@Test\nclass D { void e() {} }\n@Before void f() {}", ["a", "b"]),
        ("junit", "@ParameterizedTest(name = \"x\")\n@MethodSource\nprivate suspend fun each(n: Int) {}\n@RepeatedTest(3)\nfun again() {}", ["each", "again"]),
        ("xctest", "@Test(\"title\") func adds() async {}\n@Test\nstatic func subs() {}\nfunc plain() {}", ["adds", "subs"]),
        ("csharp_test", "[Fact]\npublic async Task<int> A() {}\n[Theory]\n[InlineData(1)]\npublic void B(int x) {}\n[TestMethod(\"n\")] internal int[] C() {}\n[Facts]\nvoid D() {}\n[Test]\nint field = f(2);", ["A", "B", "C"]),
        ("rust", "#[test]\nfn a() {}\n#[tokio::test]\nasync fn b() {}\n#[rstest]\nfn c<T>(x: T) {}\n#[tests]\nfn d() {}", ["a", "b", "c"]),
        ("pytest", "@Test\ndef a(): pass", []),
        ("junit", None, None),
        ("junit", "", []),
    ]
    found = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, framework string, content string").select("i", extract.marked_names(F.col("content"), F.col("framework")).alias("m"))
    assert {r.i: r.m for r in found.collect()} == {i: r[2] for i, r in enumerate(rows)}


def test_registry(spark):
    extract.register_unit_extractor("python", lambda path, text: [("custom", "thing", 1, 1)])
    try:
        rows = extract.code_units(spark.createDataFrame([("a.py", "x"), ("b.py", None)], "file_path string, content string")).collect()
        assert {r.id for r in rows} == {"a.py:custom:thing", "b.py:custom:thing"} and "python" in extract.unit_extractors()
    finally:
        extract.unregister_unit_extractor("python")
    with pytest.raises(KeyError):
        extract.unregister_unit_extractor("python")


DEPS = "file_path string, name string, dep_type string, module_path string, confidence double"


def test_edge_tiers(spark):
    code = spark.createDataFrame([("u1", "pkg/a.py", "f"), ("u2", "pkg/b.py", "f"), ("u3", "src/m.js", "g"), ("u4", "src/m.js", "h"), ("u5", "other.py", "loose")], "id string, file_path string, name string")
    tests = spark.createDataFrame([("t1", "t/test_a.py"), ("t2", "src/m.test.js"), ("t3", "t/test_c.py")], "id string, file_path string")
    deps = spark.createDataFrame([("t/test_a.py", "f", "import", "pkg.a", None), ("t/test_a.py", "f", "call", None, None), ("t/test_a.py", "loose", "call", None, None), ("src/m.test.js", "x", "dynamic_import", "./m", 0.25), ("t/test_c.py", "loose", "call", None, None)], DEPS)
    got = {(r.test_id, r.code_id, r.edge_type): r.weight for r in edges.test_edges(tests, deps, code).collect()}
    assert got == {("t1", "u1", "import"): 0.4, ("t1", "u1", "call"): 0.4, ("t2", "u3", "dynamic_import"): 0.5, ("t2", "u4", "dynamic_import"): 0.5, ("t3", "u5", "call"): 0.4}


def test_import_edges(spark):
    paths = ["a.py", "pkg/b.py", "src/x.js", "src/lib/y.js", "src/lib/index.js", "src/p/one.js", "src/p/two.js", "U.java", "V.java", *[f"src/big/f{i}.js" for i in range(51)]]
    known = spark.createDataFrame([(p,) for p in paths], "file_path string")
    deps = spark.createDataFrame([("a.py", "b", "import", "pkg.b", None), ("src/x.js", "lib", "import", "./lib", None), ("src/x.js", "d", "dynamic_import", "./p/${n}", 0.4), ("src/x.js", "d", "dynamic_import", "./big/", 0.4), ("U.java", "V", "import", "z.V", None), ("src/x.js", "x", "import", "./x", None)], DEPS)
    got = {(r.importer_file, r.imported_file): r.confidence for r in edges.import_edges(deps, known).collect()}
    assert got == {("a.py", "pkg/b.py"): 1.0, ("src/x.js", "src/lib/index.js"): 1.0, ("src/x.js", "src/p/one.js"): 0.4, ("src/x.js", "src/p/two.js"): 0.4, ("U.java", "V.java"): 1.0}


def test_reports(spark, tmp_path):
    lines = spark.createDataFrame([("t.py::test_a PASSED [ 1%]",), ("t.py::test_b SKIPPED",), ("t.py::C::test_c XFAIL",), ("noise",), ("t.py::test_d XPASS",)], "value string")
    assert {r.test_id: r.passed for r in file_source.pytest_results(lines).collect()} == {"t.py:test_a": True, "t.py:test_b": False, "t.py:C:test_c": True, "t.py:test_d": False}
    (tmp_path / "r.json").write_text('{"testResults": [{"name": "/p/a.test.js", "assertionResults": [{"title": "works", "status": "passed", "duration": 12}, {"title": "not", "status": "failed"}]}]}')
    got = [(r.test_id, r.passed, r.duration_ms) for r in file_source.jest_results(spark, str(tmp_path / "r.json"), "/p").collect()]
    assert got == [("a.test.js:works", True, 12), ("a.test.js:not", False, None)]


def test_blame_text():
    head = "a" * 40
    raw = f"{head} 1 1 2\nauthor Al\nauthor-mail <a@b>\nauthor-time 1767225600\nauthor-tz +0200\n\tx\n{head} 2 2\n\ty\n"
    assert git.parse_blame(raw) == [(1, head, "Al", "a@b", "2026-01-01T02:00:00+02:00"), (2, head, "Al", "a@b", "2026-01-01T02:00:00+02:00")]


def test_log_text():
    h, g = "a" * 40, "b" * 64
    raw = f"\0{h}\0A|l\0a@b\0" "2026-01-01T00:00:00Z\0fix | pipe\0\0\n3\t1\ta.py\0-\t-\tb.bin\0" "1\t0\t\0old.py\0d e/new.py\0\0" f"\0{g}\0B\0\0d\0\0"
    assert git.parse_log(raw) == [(h, "A|l", "a@b", "2026-01-01T00:00:00Z", "fix | pipe", [("a.py", 3, 1), ("b.bin", 0, 0), ("d e/new.py", 1, 0)]), (g, "B", "", "d", "", [])]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a.py", "b.py", 0.4)], "importer_file string, imported_file string, confidence double")
    s.upsert("import_edges", rows)
    s.upsert("import_edges", rows.withColumn("confidence", F.lit(0.9)))
    assert [tuple(r) for r in s.read("import_edges").collect()] == [("a.py", "b.py", 0.9)]
    s.delete("import_edges", spark.createDataFrame([("a.py",)], "importer_file string"))
    assert s.read("import_edges").count() == 0 and s.compact()["import_edges"] > 0
    s.set_meta(x=1)
    assert s.get_meta("x") == "1" and s.get_meta("y", "d") == "d"
    with pytest.raises(ValueError):
        Store(spark, ":memory:")


def test_batch_of_lock_requests(spark, tmp_path):
    """Releases, then refreshes, then acquires; expired locks do not count, and a lock that goes on keeps its start and its reason."""
    locks = control.Locks(Store(spark, str(tmp_path)), lambda: 100.0)
    held = [("kept", "a", 50.0, 150.0, "why"), ("given", "a", 50.0, 150.0, "why"), ("gone", "a", 1.0, 99.0, None), ("left", "a", 50.0, 100.0, None), ("other", "b", 50.0, 150.0, "x")]
    locks.store.write("file_locks", spark.createDataFrame(held, "file_path string, agent_id string, acquired_at double, expires_at double, purpose string"))
    asked = [
        ("kept", "a", "acquire", 10, None), ("kept", "a", "refresh", 30, None), ("kept", "b", "acquire", 10, "mine"), ("kept", "b", "release", None, None),
        ("given", "a", "release", None, None), ("given", "a", "refresh", 5, None), ("given", "c", "acquire", 5, "c's"), ("given", "b", "acquire", 7, "b's"), ("given", "b", "acquire", 9, "b's"),
        ("gone", "a", "refresh", 5, None), ("left", "a", "release", 5, None), ("free", "z", "acquire", None, None),
        (None, "a", "acquire", 5, None), ("free", None, "acquire", 5, None), ("free", "a", "steal", 5, None),
    ]
    answers = locks.request(spark.createDataFrame(asked, "file_path string, agent_id string, action string, ttl bigint, purpose string"))
    assert {(r.file_path, r.agent_id, r.action): (r.status, r.owner) for r in answers.collect()} == {
        ("kept", "a", "acquire"): ("acquired", "a"), ("kept", "a", "refresh"): ("refreshed", "a"), ("kept", "b", "acquire"): ("held", "a"), ("kept", "b", "release"): ("not_held", "a"),
        ("given", "a", "release"): ("released", "b"), ("given", "a", "refresh"): ("not_held", "b"), ("given", "c", "acquire"): ("held", "b"), ("given", "b", "acquire"): ("acquired", "b"),
        ("gone", "a", "refresh"): ("not_held", None), ("left", "a", "release"): ("released", None), ("free", "z", "acquire"): ("acquired", "z"),
    }
    assert sorted(map(tuple, locks.store.read("file_locks").collect())) == [("free", "z", 100.0, 100.0, None), ("given", "b", 100.0, 109.0, "b's"), ("kept", "a", 50.0, 130.0, "why"), ("other", "b", 50.0, 150.0, "x")]
    none = spark.createDataFrame([], "file_path string, agent_id string, action string, ttl bigint, purpose string")
    assert locks.request(none).isEmpty() and locks.store.read("file_locks").count() == 4


def test_locks(spark, tmp_path):
    clock = [100.0]
    locks = control.Locks(Store(spark, str(tmp_path)), lambda: clock[0])
    assert locks.acquire("f", "a", 50)["status"] == "acquired" and locks.acquire("f", "b")["status"] == "held"
    assert locks.acquire("f", "a", 90)["expires_at"] == 190 and locks.release("f", "b")["status"] == "not_held"
    clock[0] = 185.0
    assert locks.check("f")["stale"] and locks.refresh("f", "a", 20)["status"] == "refreshed"
    clock[0] = 300.0
    assert not locks.check("f")["locked"] and locks.acquire("f", "b")["status"] == "acquired"
    assert [x["agent_id"] for x in locks.list()] == ["b"] and locks.check_many(["f", "g"])[1] == {"file_path": "g", "locked": False, "held_by": None}


def test_jobs(spark, tmp_path):
    jobs = control.Jobs(Store(spark, str(tmp_path)))
    done = jobs.start("sum", lambda cancelled: {"n": spark.range(10).count()})
    done["thread"].join(60)
    status = jobs.status(done["job_id"])
    assert (status["status"], status["result"]) == ("completed", {"n": 10}) and jobs.status("none")["status"] == "not_found"

    def wait(cancelled):
        while not cancelled():
            time.sleep(0.1)

    slow = jobs.start("wait", wait)
    assert jobs.start("other", wait)["status"] == "busy"
    jobs.cancel(slow["job_id"])
    slow["thread"].join(60)
    assert jobs.status(slow["job_id"])["status"] == "cancelled"


def test_streams(spark, tmp_path):
    schema = "test_id string, passed boolean, duration_ms double, recorded_at timestamp"
    spark.createDataFrame([("a", True, 1.0 + k % 2, None) for k in range(4)] + [("b", False, None, None)], schema).withColumn("recorded_at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("t_rates", streams.failure_rates(source), "complete"), ("t_spread", streams.duration_spread(source), "update")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert {r.test_id: (r.total_runs, r.failures) for r in spark.table("t_rates").collect()} == {"a": (4, 0), "b": (1, 1)}
    assert {r.test_id: (r.duration_cv, r.runs) for r in spark.table("t_spread").collect()} == {"a": (1 / 3, 4), "b": (None, 0)}


def test_shards(tmp_path):
    for d in ("pk/a", "pk/b", "lib"):
        (tmp_path / d).mkdir(parents=True)
    assert shard_prefixes("pk/*, lib/", str(tmp_path)) == ["lib", "pk/a", "pk/b"]


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")

    def run(*args, date="2026-01-15T10:00:00+00:00"):
        subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date})

    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "Al")
    (root / "tests").mkdir()
    (root / "app.py").write_text("def process_data(x):\n    return validate_input(x)\n\n\ndef validate_input(x):\n    return bool(x)\n")
    (root / "util.py").write_text("import app\n\ndef helper():\n    return app.process_data(1)\n")
    (root / "tests/test_app.py").write_text("from app import process_data\n\ndef test_process():\n    assert process_data(1)\n")
    (root / ".gitignore").write_text("ignored.py\n")
    (root / "ignored.py").write_text("def nothing(): pass\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    with open(root / "app.py", "a") as f:
        f.write("\n\ndef format_output(x):\n    return str(x)\n")
    run("commit", "-qam", "two | pipe", date="2026-02-01T10:00:00+00:00")
    p = Project(spark, str(root), str(tmp_path_factory.mktemp("store")))
    assert p.call("risk_map")["result"]["status"] == "no_data"
    assert p.analyze()["code_units"] == 5
    return p


def test_project(project):
    p = project
    assert p.update()["status"] == "no_changes" and len(QUERIES) == 26 + len({"auto_update", "risk_of", "shard_stats"} & set(QUERIES))
    assert [(r["name"], r["source"]) for r in p.impact(["app.py"])] == [("test_process", "direct")]
    assert {r["id"] for r in p.test_gaps()} >= {"app.py:format_output:function", "util.py:helper:function"}
    assert [r["message"] for r in p.history("app.py")] == ["two | pipe", "one"]
    assert p.churn("app.py")[0]["commit_count"] == 2 and p.ownership("app.py")[0]["percentage"] == 100.0
    assert {r["file_path"] for r in p.risk_map()["files"]} == {"app.py", "util.py"}
    assert p.coupling("util.py", 1)["import_breadth"] == 1 and p.stale_tests() == [] and p.stats()["commits"] == 2
    assert p.record_result("tests/test_app.py::test_process", False)["status"] == "recorded"
    assert p.triage(top_n=1)["summary"]["top_risk_files"] == 1 and p.diff_impact()["status"] == "no_changes"
    with open(os.path.join(p.root, "app.py"), "a") as f:
        f.write("# more\n")
    assert p.update()["changed_files"] == 1 and p.diff_impact()


def test_units_shards_and_warnings(project):
    p = project
    assert p.churn("app.py", "format_output")[0]["commit_count"] == 1 and p.churn("app.py", "process_data")[0]["commit_count"] >= 1
    one = p.risk_of("app.py", "format_output")
    assert one["coverage_gap"] == 1.0 and one["unit_name"] == "format_output" and p.risk_of("app.py")["coverage_gap"] < 1.0
    p.shards = ["src", "tests"]
    found = p.shard_stats()
    assert found["with_data"] == ["tests"] and found["totals"]["test_units"] == 1 and p.shard_stats("src")["status"] == "no_data"
    p.shards = []
    assert p.shard_stats()["status"] == "no_data"
    with open(os.path.join(p.root, "evil.js"), "w") as f:
        f.write("new Function('x'); eval('y');\n")
    assert p.eval_warning("evil.js")["eval_count"] == 1 and p.eval_warning("app.py") is None
    os.remove(os.path.join(p.root, "evil.js"))


def test_working_tree(project):
    p = project
    for name, text in {"extra.py": "import app\n\ndef fresh():\n    return 1\n", "tests/test_extra.py": "from extra import fresh\n\ndef test_fresh():\n    assert fresh()\n"}.items():
        with open(os.path.join(p.root, name), "w") as f:
            f.write(text)
    gaps = p.test_gaps(working_tree=True)
    assert gaps[0]["id"] == "extra.py:fresh:function" and gaps[0]["working_tree"] and not any(g["working_tree"] for g in gaps[1:] if g["file_path"] != "extra.py")
    assert all(g["file_path"] != "extra.py" for g in p.test_gaps())
    near = p.suggest_tests("extra.py", working_tree=True)
    assert (near[0]["test_id"], near[0]["source"]) == ("tests/test_extra.py:test_fresh", "static_require")
    assert [r["source"] for r in p.suggest_tests("app.py", working_tree=True) if r["file_path"] == "tests/test_extra.py"] == []
    assert any(r["test_id"] == "tests/test_extra.py:test_fresh" and r["source"] == "working_tree" for r in p.diff_impact(working_tree=True))
    assert [x["neighbor"] for x in p.coupling("extra.py", working_tree=True)["import_partners"]] == ["app"]
    assert "extra.py" in {r["file_path"] for r in p.risk_map(working_tree=True)["files"]} and p.triage(working_tree=True)["top_risk_files"]
    assert p.auto_update() == {"updated": True, "reason": None} and p.auto_update()["reason"] == "no_changes"


def test_names_in_other_names(spark):
    """A name match is by stems, and gives what the product gives at 0.5 and more."""
    from ripplemark.operators import impact

    files = spark.createDataFrame([(x,) for x in ("a.py", "src/data.py", "src/x/load_data.py", "b")], "file_path string")
    tests = spark.createDataFrame([(x, n) for x in ("t/test_data.py", "src/data.py", "x/a.go", "src/d.py") for n in ("n1", "n2")], "file_path string, name string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(impact.name_matches(files, tests)) == key(impact.fallback(files, tests).where("relevance >= 0.5"))


def test_writers_do_not_lose_rows(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = Store(spark, str(tmp_path))
    row = lambda i: spark.createDataFrame([(f"t{i}", True, i)], "test_id string, passed boolean, duration_ms bigint")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: s.append("test_results", row(i)), range(6)))
        list(pool.map(lambda i: s.upsert("meta", spark.createDataFrame([(f"k{i}", str(i))], "key string, value string")), range(4)))
        got = list(pool.map(lambda i: control.Locks(s).acquire("a.py", f"agent{i}")["status"], range(4)))
    assert s.read("test_results").count() == 6 and s.read("meta").count() == 4
    assert sorted(got) == ["acquired", "held", "held", "held"]
    assert s.compact()["test_results"] >= 0 and s.read("test_results").count() == 6


def test_schemas_and_roots(project, tmp_path, monkeypatch):
    from ripplemark.plans.describe import schema, schemas
    from ripplemark.plans.project import shard_config, storage_dir

    assert len(schemas()) == len(QUERIES) and schema("history")["parameters"]["required"] == ["file_path"]
    assert schema("history")["parameters"]["properties"]["limit"]["maximum"] == 1000
    assert git.project_root(os.path.join(project.root, "tests")) == os.path.realpath(project.root) and git.project_root(str(tmp_path)) == str(tmp_path)
    assert storage_dir(str(tmp_path), shard="a") == str(tmp_path / ".ripplemark/shards/a") and storage_dir(None, "/x") == "/x"
    (tmp_path / "ripplemark.toml").write_text('shards = ["a", "b"]\n')
    assert shard_config(str(tmp_path)) == "a,b"
    monkeypatch.setenv("RIPPLEMARK_SHARDS", "z")
    assert shard_config(str(tmp_path)) == "z"


def test_command_line(project, capsys):
    import json

    from ripplemark import cli

    common = ["--project-dir", project.root, "--storage-dir", project.store.folder, "--json"]
    assert cli.main([*common, "history", "app.py", "--limit", "1"], project.spark) == 0
    assert len(json.loads(capsys.readouterr().out)["result"]) == 1
    assert cli.main([*common, "record-result", "tests/test_app.py:test_process", "passed"], project.spark) == 0
    assert json.loads(capsys.readouterr().out)["result"]["passed"] is True
    assert cli.framework_of(["python", "-m", "pytest"]) == "pytest" and cli.augmented(["pytest"], "pytest", "r") == ["pytest", "-v"]
    assert cli.main([*common, "run", "echo", "tests/test_app.py::test_process PASSED"], project.spark) == 0
    assert json.loads(capsys.readouterr().out)["result"]["framework"] is None
