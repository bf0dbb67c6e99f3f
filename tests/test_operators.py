"""The analytics operators on small hand-made tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ripplemark.functions import scalars as X
from ripplemark.operators import coverage, graph, history, impact, results, risk, store

AS_OF = "2026-03-01T12:00:00+00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def seeded(spark):
    units = [("app.py:foo:func", "app.py", "foo", "func", 1, 10), ("app.py:bar:func", "app.py", "bar", "func", 12, 20), ("lib.py:helper:func", "lib.py", "helper", "func", 1, 5)]
    tests = [("test_app.py:test_foo", "test_app.py", "test_foo", "pytest"), ("test_app.py:test_bar", "test_app.py", "test_bar", "pytest"), ("test_lib.py:test_helper", "test_lib.py", "test_helper", "pytest")]
    edges = [("test_app.py:test_foo", "app.py:foo:func", "import", 2.0), ("test_app.py:test_bar", "app.py:bar:func", "call", 1.0), ("test_lib.py:test_helper", "lib.py:helper:func", "import", 1.0)]
    return {
        "units": spark.createDataFrame(units, "id string, file_path string, name string, unit_type string, line_start int, line_end int"),
        "tests": spark.createDataFrame(tests, "id string, file_path string, name string, framework string"),
        "edges": spark.createDataFrame(edges, "test_id string, code_id string, edge_type string, weight double"),
        "pairs": spark.createDataFrame([("app.py", "lib.py", 5, "abc123")], "file_a string, file_b string, co_commit_count bigint, last_co_commit string"),
        "churn": spark.createDataFrame([("app.py", "", 10, 2.5), ("lib.py", "", 2, 0.3)], "file_path string, unit_name string, commit_count bigint, churn_score double"),
        "imports": spark.createDataFrame([], "importer_file string, imported_file string, confidence double"),
        "blame": spark.createDataFrame([("app.py", "Alice", "a@b.com", 1, 15), ("app.py", "Bob", "b@b.com", 16, 20)], "file_path string, author string, author_email string, line_start int, line_end int"),
        "results": spark.createDataFrame([], "test_id string, passed boolean, duration_ms bigint, recorded_at timestamp"),
    }


def commits(spark, rows):
    nested = spark.createDataFrame(rows, "hash string, author string, author_email string, date string, message string, files array<struct<path:string,insertions:bigint,deletions:bigint>>")
    return history.flatten_commits(nested)


def test_churn(spark):
    c, f = commits(spark, [("1", "A", "a@b", "2026-03-01T12:00:00+00:00", "m", [("x.py", 5, 2)]), ("2", "B", "b@b", "2026-02-28T14:00:00+02:00", "m", [("x.py", 5, 0)]), ("3", "A", "a@b", "nonsense", "m", [("x.py", 100, 0)])])
    r = history.churn(c, f, AS_OF).first()
    assert (r.commit_count, r.distinct_authors, r.total_insertions, r.total_deletions, r.churn_score) == (2, 2, 10, 2, 1.5)
    assert r.last_changed == "2026-03-01T12:00:00+00:00"
    empty = history.churn_all_files(spark.createDataFrame([("y.py",)], "file_path string"), history.churn(c, f, AS_OF)).first()
    assert (empty.commit_count, empty.churn_score, empty.last_changed) == (0, 0.0, None)


@pytest.mark.parametrize(("n", "pairs"), [(51, 0), (50, 1225), (1, 0)])
def test_large_commits_make_no_pairs(spark, n, pairs):
    c, f = commits(spark, [("1", "A", "a", "2026-01-01", "m", [(f"f{i:02d}", 1, 0) for i in range(n)])])
    assert history.co_changes(c, f, 1).count() == pairs


def test_threshold(spark):
    assert [one(spark, X.coupling_threshold(F.lit(n))) for n in (0, 1, 4, 10, 50, 200, 1000)] == [2, 2, 2, 2, 3, 4, 5]


def test_ownership(seeded):
    rows = {r.author: (r.line_count, r.percentage) for r in history.ownership(seeded["blame"]).collect()}
    assert rows == {"Alice": (15, 75.0), "Bob": (5, 25.0)}
    assert history.author_concentration(seeded["blame"]).first().author_concentration == 0.625


def test_impact(seeded, spark):
    changed = spark.createDataFrame([("app.py", None)], "file_path string, functions array<string>")
    s = seeded
    got = {r.name: (r.score, r.source) for r in impact.impact(s["units"], s["edges"], s["tests"], s["pairs"], s["imports"], changed).collect()}
    assert got == {"test_foo": (2.0, "direct"), "test_bar": (1.0, "direct"), "test_helper": (0.5, "co_change")}
    for names, expected in ((["foo"], {"test_foo"}), ([], set())):
        only = spark.createDataFrame([("app.py", names)], "file_path string, functions array<string>")
        assert {r.test_name for r in coverage.direct_impact(s["units"], s["edges"], s["tests"], only).collect()} == expected


def test_ties_keep_the_first_source(spark):
    rows = spark.createDataFrame([("t", "f", "n", 0.5, "r", s) for s in ("import_graph", "co_change", "direct")], "test_id string, file_path string, name string, score double, reason string, source string")
    assert impact.best_per_test(rows).first().source == "direct"


def test_hybrid(spark):
    schema = "test_id string, file_path string, name string, score double, reason string, source string"
    a = spark.createDataFrame([("t", "f", "n", 0.5, "db", "direct"), ("u", "f", "m", 0.4, "db", "direct")], schema)
    b = spark.createDataFrame([("t", "f", "n", 0.9, "static", "static_require"), ("v", "g", "o", 0.3, "static", "static_require")], schema)
    got = {r.test_id: (round(r.score, 6), r.source, r.reason) for r in impact.hybrid(a, b).collect()}
    assert got == {"t": (0.752, "hybrid", "db; static"), "u": (0.4, "direct", "db"), "v": (0.3, "static_require", "static")}


def test_risk(seeded):
    s = seeded
    cov = coverage.file_coverage(s["units"], s["edges"])
    row = cov.where("file_path = 'app.py'").first()
    assert (row.coverage, row.covering_tests, row.n_call, row.n_import) == (1.0, 2, 1, 1)
    coupled = risk.coupling(s["churn"], s["pairs"], s["pairs"].limit(0), graph.neighbors(s["imports"]), 3)
    unstable = results.instability(coverage.covering_tests(s["units"], s["edges"]), results.failure_rates(s["results"]), results.duration_cv(s["results"]))
    got = {r.file_path: r for r in risk.components(s["churn"], coupled, cov, history.author_concentration(s["blame"]), unstable, None, s["tests"]).collect()}
    app = got["app.py"]
    assert (app.churn, app.coupling, app.coverage_gap, app.coverage_depth, app.author_concentration, app.edge_type_quality) == (0.5, 0.1, 0.0, 0.4, 0.625, 0.5)
    assert app.risk_score == round(0.35 * 0.5 + 0.25 * 0.1 + 0.1 * 0.4 + 0.1 * 0.625, 4)
    assert got["lib.py"].author_concentration == 1.0


def test_new_files_are_raised(spark, seeded):
    churn = spark.createDataFrame([("new.py", "", 0.0)], "file_path string, unit_name string, churn_score double")
    s = seeded
    none = risk.coupling(churn, s["pairs"].limit(0), s["pairs"].limit(0), graph.neighbors(s["imports"]), 3)
    row = risk.components(churn, none, coverage.file_coverage(s["units"], s["edges"]), history.author_concentration(s["blame"]), results.instability(coverage.covering_tests(s["units"], s["edges"]), results.failure_rates(s["results"]), results.duration_cv(s["results"]))).first()
    assert (row.new_file_boost, row.coverage_gap, row.risk_score) == (0.5, 1.0, 0.75)


def test_reweighting():
    found = {"files": 3} | {f"n_{c}": 3 for c in risk.WEIGHTS} | {f"min_{c}": 0.1 for c in risk.WEIGHTS}
    assert risk.new_weights(found) is None
    weights = risk.new_weights(found | {"n_coupling": 1, "min_coupling": 0.0})
    assert "coupling" not in weights and abs(sum(weights.values()) - 1) < 1e-12
    assert risk.new_weights(found | {"n_coupling": 1}) is None
    assert risk.new_weights(found | {"files": 1, "n_coupling": 1, "min_coupling": 0.0}) is None


def test_instability(spark):
    rows = [("a", True, 100, 1), ("a", False, 100, 2), ("a", True, 100, 3), ("b", True, None, 1)]
    res = spark.createDataFrame([(t, p, d, datetime(2026, 1, k)) for t, p, d, k in rows], "test_id string, passed boolean, duration_ms bigint, recorded_at timestamp")
    cv = results.duration_cv(res)
    assert [tuple(r) for r in cv.collect()] == [("a", 0.0)]
    cover = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "none"), ("h", "b")], "file_path string, test_id string")
    got = {r.file_path: round(r.test_instability, 6) for r in results.instability(cover, results.failure_rates(res), cv).collect()}
    assert got == {"f": round(0.65 * (1 / 3 + 0) / 2, 6), "g": 0.0, "h": 0.0}


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "importer_file string, imported_file string, confidence double")


def test_cycles(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1), ("d", "e", 1), ("e", "d", 1), ("e", "f", 1), ("x", "y", 0.5), ("y", "x", 0.5), ("g", "a", 1)])
    assert [(r.component, r.files) for r in graph.cycles(e).collect()] == [("a", ["a", "b", "c"]), ("d", ["d", "e"])]
    assert graph.components(edges(spark, [("a", "b", 1), ("b", "c", 1)])).count() == 0


def test_hops_and_closure(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 0.3), ("a", "c", 0.3)])
    start = spark.createDataFrame([("a",)], "file_path string")
    assert {r.file_path: r.hops for r in graph.hops(e, start).collect()} == {"a": 0, "b": 1, "c": 2}
    got = {r.file_path: (round(r.decay, 6), r.hops) for r in graph.closure(e, start).collect()}
    assert got == {"b": (0.88, 1), "c": (round(0.88**2, 6), 2), "d": (round(0.88**3 * 0.3, 6), 3)}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 0)], "k string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1), (None, 9, 1)], "k string, v int, seq int")
    assert sorted(map(tuple, store.upserted(old, new, ["k"], ["seq"]).collect()), key=str) == [("a", 1), ("b", 3), ("c", 4), (None, 9)]


def test_change_detection(spark):
    schema = "file_path string, content_hash string, mtime double, size bigint"
    known = spark.createDataFrame([("a", "1", 1.0, 1), ("b", "1", 1.0, 1), ("c", "1", 1.0, 1)], schema)
    now = spark.createDataFrame([("a", "1", 2.0, 1), ("b", "2", 2.0, 1), ("c", "2", 1.0, 1), ("d", "1", 1.0, 1)], schema)
    assert sorted(r.file_path for r in store.changed_files(now, known).collect()) == ["b", "d"]
    assert sorted(r.file_path for r in store.changed_files(now, known, force=True).collect()) == ["b", "c", "d"]


def test_paths(spark):
    assert one(spark, X.normal_path(F.lit("a/./b/../c//d"))) == "a/c/d"
    assert one(spark, X.resolve_js(F.lit("src/t/a.test.js"), F.lit("../lib/b.js"))) == "src/lib/b"
    assert one(spark, X.resolve_js(F.lit("src/t/a.test.js"), F.lit("react"))) is None
    assert one(spark, X.suffix_keys(F.lit("a/b/c.py"))) == ["a/b/c", "b/c", "c"]
    assert one(spark, X.test_stem(F.lit("tests/x/nameService.test.js"))) == "nameService"
    assert one(spark, X.test_stem(F.lit("test_.py"))) is None
    assert one(spark, X.resolve_go(F.lit("ex.com/m"), F.lit("ex.com/m/p/q"))) == "p/q"
    assert one(spark, X.shard_of(F.lit("a/b/c.py"), ["a", "a/b"])) == "a/b"
    weights = [one(spark, X.proximity_weight(F.lit(t), F.lit(c))) for t, c in (("a/t.py", "a/c.py"), ("t.py", "c.py"), ("a/b/t.py", "a/c.py"), ("a/b/c/t.py", "a/x.py"), ("a/t.py", "b/c.py"), ("t.py", "a/c.py"))]
    assert weights == [1.0, 1.0, 0.8, 0.6, 0.4, 0.4]
    dates = ["2026-01-01T05:00:00+05:00", "2026-01-01T00:00:00Z", "2026-01-01", "nonsense"]
    assert [one(spark, F.unix_seconds(X.timestamp(F.lit(d)))) for d in dates] == [1767225600] * 3 + [None]
