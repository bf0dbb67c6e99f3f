"""Which tests a change can affect: direct edges, co-change, import closure, static imports, name fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.scalars import basename, directory, test_stem
from ripplemark.operators import products
from ripplemark.operators.coverage import direct_impact
from ripplemark.operators.edges import of_tests as edges_of_tests
from ripplemark.operators.graph import closure
from ripplemark.operators.history import partners
from ripplemark.session import cut

COCHANGE_WEIGHT, CLOSURE_WEIGHT, STATIC_BLEND, FAILURE_BOOST = 0.5, 0.45, 0.28, 0.5
HEURISTIC_WEIGHT, STEM_WEIGHT, STEM_LEAST = 0.2, 0.4, 0.5
#: Equal scores keep the source that comes first.
RANKS = {"direct": 0, "co_change": 1, "import_graph": 2, "static_require": 3, "hybrid": 4, "fallback": 5, "working_tree": 6}


def _rows(df: DataFrame, source: str, score, reason, causes) -> DataFrame:
    return df.select("test_id", F.col("test_file").alias("file_path"), F.col("test_name").alias("name"), score.alias("score"), reason.alias("reason"), F.lit(source).alias("source"), causes.alias("causes"))


def best_per_test(rows: DataFrame) -> DataFrame:
    """The best row of each test; on equal scores the source of the lower rank, then the reason."""
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[F.col("source")]
    w = Window.partitionBy("test_id").orderBy(F.desc("score"), rank, "reason")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def cochange_impact(units: DataFrame, edges: DataFrame, tests: DataFrame, pairs: DataFrame, changed: DataFrame, min_count: int = 3) -> DataFrame:
    """Tests of files that change together with a changed file, at half their weight."""
    near = partners(pairs, changed, min_count).select(F.col("partner").alias("file_path"), F.col("file_path").alias("cause"), "co_commit_count")
    found = direct_impact(units, edges, tests, near.select("file_path").distinct())
    rows = found.join(near, "file_path")
    return _rows(rows, "co_change", F.col("score") * COCHANGE_WEIGHT, F.concat(F.lit("co-change with "), F.col("cause"), F.lit(" via "), F.col("file_path")), F.array("cause"))


def closure_impact(units: DataFrame, edges: DataFrame, tests: DataFrame, import_edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Tests of files near a changed file in the import graph, weighed by hop decay and confidence."""
    near = closure(import_edges, changed).groupBy("file_path").agg(F.max("decay").alias("decay"), F.collect_set("start").alias("causes"))
    rows = direct_impact(units, edges, tests, near.select("file_path")).join(near, "file_path")
    return _rows(rows, "import_graph", F.col("score") * F.col("decay") * CLOSURE_WEIGHT, F.concat(F.lit("import graph via "), F.col("file_path")), F.col("causes"))


def impact_rows(units: DataFrame, edges: DataFrame, tests: DataFrame, pairs: DataFrame, import_edges: DataFrame, changed: DataFrame, untracked: DataFrame | None = None, min_count: int = 3) -> DataFrame:
    """Every way in which a change can affect a test, each with ``causes``, the changed files that it comes from.

    ``untracked`` files count as changed whole, and their imports are not followed.
    """
    whole = changed if untracked is None else changed.unionByName(untracked.select("file_path"), allowMissingColumns=True)
    direct = direct_impact(units, edges, tests, whole)
    rows = _rows(direct, "direct", F.col("score"), F.concat(F.lit("direct edge ("), F.col("edge_type"), F.lit(") to "), F.col("file_path"), F.lit(":"), F.col("unit_name")), F.array("file_path"))
    rows = rows.unionByName(cochange_impact(units, edges, tests, pairs, whole, min_count))
    return rows.unionByName(closure_impact(units, edges, tests, import_edges, changed))


def impact(*tables: DataFrame, **how) -> DataFrame:
    """All tests that a change can affect, one row each with its best score, source and reason (see :func:`impact_rows`)."""
    return best_per_test(impact_rows(*tables, **how)).drop("causes")


def static_tests(static: DataFrame, files: DataFrame) -> DataFrame:
    """Tests that import one of the files, the best score of each."""
    own = static.join(files.select(F.col("file_path").alias("target_file_path")).distinct(), "target_file_path", "left_semi")
    own = own.groupBy(F.col("test_file_path").alias("file_path"), F.col("test_unit_name").alias("name")).agg(F.max("score").alias("score"))
    return own.select(F.concat_ws(":", "file_path", "name").alias("test_id"), "file_path", "name", "score", F.lit("static import").alias("reason"), F.lit("static_require").alias("source"))


def hybrid(impacted: DataFrame, static: DataFrame) -> DataFrame:
    """Both lists by test; a test on both gets a blended score, the source ``hybrid`` and both reasons."""
    a = impacted.select("test_id", *[F.col(c).alias(f"a_{c}") for c in ("file_path", "name", "score", "reason", "source")])
    b = static.select("test_id", *[F.col(c).alias(f"b_{c}") for c in ("file_path", "name", "score", "reason", "source")])
    both = F.col("a_score").isNotNull() & F.col("b_score").isNotNull()
    score = F.when(both, F.least(F.lit(1.0), F.col("a_score") + STATIC_BLEND * F.col("b_score"))).otherwise(F.coalesce("a_score", "b_score"))
    reason = F.concat_ws("; ", "a_reason", "b_reason")
    return a.join(b, "test_id", "full_outer").select("test_id", F.coalesce("a_file_path", "b_file_path").alias("file_path"), F.coalesce("a_name", "b_name").alias("name"), score.alias("score"), reason.alias("reason"), F.when(both, "hybrid").otherwise(F.coalesce("a_source", "b_source")).alias("source"))


def fallback(files: DataFrame, tests: DataFrame) -> DataFrame:
    """Every test of every file of a (small, given) list, ranked by how the names of the two files compare.

    The answer is the product of the list and the tests; where only good matches count, use :func:`name_matches`.  Test
    names are first gathered by file, in blocks; a task takes a part of the blocks and a part of the list, and paths are
    compared once a block.  ``tests`` may have ``on_disk``: tests of a file with one that lies on disk only come from the
    working tree.
    """
    named = lambda df, path, stem, last: df.withColumns({stem: _stem(path), last: F.when(directory(path) != "", basename(directory(path)))})
    own = named(files.select(F.col("file_path").alias("source_file")).distinct(), "source_file", "a", "x")
    tests = cut(tests.select("file_path", "name", F.concat_ws(":", "file_path", "name").alias("test_id"), _on_disk(tests)).where(F.col("name").isNotNull()))
    n = tests.count()
    parts = products.grid(n, own.count())
    names = products.blocks(tests, "file_path", "names", min(products.BLOCK, max(1, n // (4 * parts[0]))), {"on_disk": F.max("on_disk")})
    rows = products.crossed(named(names, "file_path", "b", "y"), own, parts)
    base = F.when(F.col("a") == F.col("b"), 1.0).when(F.contains("b", "a") | F.contains("a", "b"), 0.5).otherwise(0.1)
    score = F.when(F.col("x") == F.col("y"), F.least(F.lit(1.0), base + 0.3)).otherwise(base)
    scored = rows.select("source_file", "file_path", score.alias("relevance"), _found().alias("source"), "names")
    return scored.select("source_file", "file_path", "relevance", "source", F.inline("names")).select("source_file", "test_id", "file_path", "name", "relevance", "source")


def _on_disk(tests: DataFrame):
    return F.col("on_disk") if "on_disk" in tests.columns else F.lit(False).alias("on_disk")


def _found():
    return F.when(F.col("on_disk"), "working_tree").otherwise("fallback")


def _stem(path):
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def name_matches(files: DataFrame, tests: DataFrame) -> DataFrame:
    """What :func:`fallback` gives at a relevance of 0.5 and more, without its product.

    One of the two stems is then a part of the other, so the parts of every stem meet the whole stems by equality.
    """
    parts = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n)))))
    own = files.select(F.col("file_path").alias("source_file")).distinct().withColumn("a", _stem("source_file"))
    by_file = tests.select("file_path", _on_disk(tests)).groupBy("file_path").agg(F.max("on_disk").alias("on_disk")).withColumn("b", _stem("file_path"))
    inside = own.join(by_file.select("file_path", "on_disk", "b", F.explode(parts(F.col("b"))).alias("a")), "a")
    around = own.select("source_file", "a", F.explode(parts(F.col("a"))).alias("b")).join(by_file, "b")
    rows = inside.select("source_file", "file_path", "on_disk", "a", "b").union(around.select("source_file", "file_path", "on_disk", "a", "b")).distinct()
    near = (directory("source_file") != "") & (directory("file_path") != "") & (basename(directory("source_file")) == basename(directory("file_path")))
    base = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.5)
    rows = rows.select("source_file", "file_path", F.when(near, F.least(F.lit(1.0), base + 0.3)).otherwise(base).alias("relevance"), _found().alias("source"))
    rows = rows.join(tests.select("file_path", "name"), "file_path")
    return rows.select("source_file", F.concat_ws(":", "file_path", "name").alias("test_id"), "file_path", "name", "relevance", "source")


def suggest(impacted: DataFrame, static: DataFrame, rates: DataFrame) -> DataFrame:
    """Impact and static imports merged, and raised for tests that fail often."""
    rows = hybrid(impacted, static).join(rates.select("test_id", "failure_rate"), "test_id", "left")
    relevance = F.col("score") * (1 + FAILURE_BOOST * F.coalesce("failure_rate", F.lit(0.0)))
    return rows.select("test_id", "file_path", "name", relevance.alias("relevance"), "reason", "source")


def heuristic_edges(units: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Weak edges from the tests of files without any edge to the units of files with the stem of the test file."""
    known = tests.join(edges.select(F.col("test_id").alias("id")), "id", "left_semi").select("file_path").distinct()
    own = cut(tests.select("file_path").distinct().join(known, "file_path", "left_anti").withColumn("low", F.lower(test_stem("file_path"))).where(F.col("low").isNotNull()))
    code = units.select(F.col("file_path").alias("code_file")).distinct().where(~basename("code_file").rlike(r"\.(test|spec)\."))
    code = code.withColumn("low", F.lower(F.regexp_replace(basename("code_file"), r"\..*$", "")))
    # Files meet by stem, the tests of one and the units of the other by file, so the product is made once and evenly.
    # Units are merged, not broadcast: their table is small beside the rows made of it, which one task would make.
    near = own.join(code, "low").where(F.col("code_file") != F.col("file_path")).select("file_path", "code_file")
    by_file = units.select(F.col("id").alias("code_id"), F.col("file_path").alias("code_file")).hint("merge").join(near, "code_file").select("file_path", "code_id").distinct()
    rows = edges_of_tests(tests.join(own, "file_path", "left_semi"), cut(by_file))
    return rows.select("test_id", "code_id", F.lit("heuristic").alias("edge_type"), F.lit(HEURISTIC_WEIGHT).alias("weight"))


def annotated_with_locks(risks: DataFrame, locks: DataFrame, now: float) -> DataFrame:
    """``risks`` with the agent that holds each file, if any."""
    active = locks.where(F.col("expires_at") >= now).select("file_path", F.col("agent_id").alias("locked_by"))
    return risks.join(active, "file_path", "left")
