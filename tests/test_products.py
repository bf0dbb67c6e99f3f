"""Products under a key are made in even shares and are not shuffled."""

from pyspark.sql import functions as F

from ripplemark.operators import edges, impact, products


def _sizes(df):
    return [len(p) for p in df.rdd.glom().collect()]


def key(df):
    return sorted(map(tuple, df.collect()))


def test_joined(spark):
    """One key with most of the product is dealt over many tasks."""
    left = spark.range(400).select(F.when(F.col("id") < 380, "a").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("f"), F.col("id").alias("x"))
    right = spark.range(150).select(F.when(F.col("id") < 100, "a").otherwise(F.concat(F.lit("k"), F.col("id") % 4)).alias("f"), F.col("id").alias("y"))
    got = products.joined(left, right, "f", per_task=500)
    sizes = _sizes(got)
    assert key(got.select("f", "x", "y")) == key(left.join(right, "f").select("f", "x", "y"))
    assert len(sizes) == 77 and max(sizes) < sum(sizes) / 8


def test_edges_of_tests(spark):
    """no shuffle or sort follows the join that makes the edges, and a test in two files has each edge once."""
    rows = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("b", "u1"), ("c", "u3")], "file_path string, code_id string")
    tests = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t2", "b"), ("t3", "c"), (None, "c"), ("t4", "z")], "id string, file_path string")
    got = edges.of_tests(tests, rows).select("test_id", "code_id")
    expected = tests.select(F.col("id").alias("test_id"), "file_path").join(rows, "file_path").select("test_id", "code_id").distinct()
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(expected)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Generate inline") < plan.index("RepartitionByExpression")


def test_heuristic_edges_in_shares(spark, monkeypatch):
    """many tests of one file and many units of another."""
    units = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("src/app.py").alias("file_path"))
    tests = spark.range(200).select(F.concat(F.lit("t"), "id").alias("id"), F.lit("tests/test_app.py").alias("file_path"))
    none = spark.createDataFrame([], "test_id string")
    monkeypatch.setattr(products, "PER_TASK", 1_000)
    sizes = _sizes(impact.heuristic_edges(units, none, tests))
    assert sum(sizes) == 60_000 and max(sizes) < 12_000


def test_suggestions_in_shares(spark, monkeypatch):
    """the names of one test file come in blocks, dealt over many tasks."""
    monkeypatch.setattr(products, "PER_TASK", 1_000)
    files = spark.range(50).select(F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("file_path"))
    tests = spark.range(400).select(F.lit("src/test_f1.py").alias("file_path"), F.concat(F.lit("n"), "id").alias("name"))
    sizes = _sizes(impact.fallback(files, tests))
    assert sum(sizes) == 20_000 and max(sizes) < 6_000


def test_suggestions_are_streamed(spark, monkeypatch):
    """F2 of round 4: a task makes one pair after another, and tasks of one test file have like shares."""
    monkeypatch.setattr(products, "PER_TASK", 1_000)
    files = spark.range(50).select(F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("file_path"))
    tests = spark.range(400).select(F.lit("src/test_f1.py").alias("file_path"), F.concat(F.lit("n"), "id").alias("name"))
    got = impact.fallback(files, tests)
    sizes = _sizes(got)
    assert got.select("source_file", "test_id").distinct().count() == sum(sizes) == 20_000 and max(sizes) <= 2_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan


_DEPS = "file_path string, name string, dep_type string, module_path string, confidence double"


def test_matches_know_no_ids(spark):
    """F1 of round 4: tests with edges are found by files and names, a name with many ids is one row."""
    deps = spark.createDataFrame([("src/a_test.py", "f", "call", None, 1.0), ("web/a.test.js", "g", "import", "./m", 0.25)], _DEPS)
    units = spark.range(300).selectExpr("cast(id as string) AS id", "if(id % 3 = 0, 'web/m.js', 'src/a.py') AS file_path", "if(id % 3 = 0, 'h', 'f') AS name")
    units = units.union(spark.createDataFrame([("x", None, "f"), ("y", "web/m.js", None)], "id string, file_path string, name string"))
    assert sorted((r["file_path"], str(r["code_file"]), str(r["unit"])) for r in edges._matches(deps, units).collect()) == [("src/a_test.py", "None", "f"), ("src/a_test.py", "src/a.py", "f"), ("web/a.test.js", "web/m.js", "None")]
    got = {(r["file_path"], r["code_id"]): (r["dep_type"], r["weight"]) for r in edges.file_edges(deps, units).collect()}
    assert len(got) == 200 + 1 + 101
    assert got["src/a_test.py", "1"] == ("call", 1.0) and got["src/a_test.py", "x"] == ("call", 0.4) and got["web/a.test.js", "0"] == got["web/a.test.js", "y"] == ("import", 0.5)
    tests = spark.createDataFrame([("t1", "src/a_test.py"), ("t2", "web/a.test.js"), ("t3", "src/b_test.py"), ("t4", None)], "id string, file_path string")
    assert sorted(r["test_id"] for r in edges.tested(tests, deps, units).collect()) == ["t1", "t2"]


def test_units_of_heuristic_edges_are_merged(spark, monkeypatch):
    """F1 of round 4: a small table of units is not broadcast to one task that makes all rows of it."""
    kept, cut = [], impact.cut
    monkeypatch.setattr(impact, "cut", lambda df: kept.append(df) or cut(df))
    units = spark.sql("SELECT * FROM VALUES ('u1', 'src/App.py'), ('u2', 'src/app.spec.js'), ('u3', 'tests/test_app.py'), ('u4', 'lib/app.go'), ('u5', NULL) AS u(id, file_path)")
    tests = spark.createDataFrame([("t1", "tests/test_app.py"), ("t2", "tests/test_app.py"), ("t3", "src/app_test.py"), ("t4", None)], "id string, file_path string")
    got = impact.heuristic_edges(units, spark.createDataFrame([("t3",)], "test_id string"), tests)
    assert key(got.select("test_id", "code_id")) == [("t1", "u1"), ("t1", "u4"), ("t2", "u1"), ("t2", "u4")]
    plan = kept[-1]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [code_file" not in plan


def test_weights_are_rounded_once_a_file(spark):
    """F3 of round 4: nothing is left to do for each row of the product."""
    deps = spark.createDataFrame([("src/a_test.py", "f", "call", None, 0.5)], _DEPS)
    units = spark.createDataFrame([("u", "src/a.py", "f")], "id string, file_path string, name string")
    tests = spark.createDataFrame([("t1", "src/a_test.py"), ("t2", "src/a_test.py")], "id string, file_path string")
    got = edges.test_edges(tests, deps, units, digits=2)
    assert key(got) == [("t1", "u", "call", 0.71), ("t2", "u", "call", 0.71)]
    assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_grid():
    assert products.grid(0, 0) == products.grid(5, 0) == (1, 1)
    assert products.grid(10**6, 10**4, 10**6) == (100, 100) and products.grid(10**6, 2, 1_000) == (1_000, 2)
