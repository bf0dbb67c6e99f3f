"""the risk plan reads a commit's date once, keeps no pair of files and makes no column that it does not read."""

from pyspark.sql import functions as F

from ripplemark.operators import history
from ripplemark.plans import catalog


def _commits(spark):
    commits = spark.range(40).selectExpr("id AS hash", "CAST(id % 3 AS STRING) AS author", "timestamp '2026-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS date")
    files = commits.selectExpr("hash AS commit_hash", "explode(transform(sequence(0, CAST(hash % 6 AS INT)), i -> concat('f', (i * i + hash) % 9))) AS file_path", "1L AS insertions", "2L AS deletions")
    none = spark.sql("SELECT 1L AS commit_hash, CAST(NULL AS STRING) AS file_path, 1L AS insertions, 2L AS deletions")
    return commits, files.union(files.where("commit_hash < 9")).union(none)


def _expected(pairs):
    ends = history.both_ways(pairs)
    return {(r.file_path, r.c, r.b) for r in ends.groupBy("file_path").agg(F.count_if(F.expr("co_commit_count >= 3")).alias("c"), F.count_if(F.expr("branch_count >= 1")).alias("b")).collect() if r.c or r.b}


def test_breadths_are_those_of_the_pairs(spark, monkeypatch):
    """Repeated and null files, a limit that leaves commits out, and paths whose numbers are equal."""
    commits, files = _commits(spark)
    here = F.col("date") >= F.lit("2026-02-01").cast("timestamp")
    for most in (50, 4):
        want = _expected(history.co_changes_with_branch(commits, files, here, most))
        assert want and {tuple(r) for r in history.breadths(commits, files, here, 3, most).select("file_path", "cochange_breadth", "branch_breadth").collect()} == want
    monkeypatch.setattr(history, "_number", lambda path: F.length(path).cast("long"))
    assert {tuple(r) for r in history.breadths(commits, files, here, 3, 4).select("file_path", "cochange_breadth", "branch_breadth").collect()} == want


def test_pairs_of_a_commit(spark):
    """Against sets of files: over the limit none, repeats once."""
    commits, files = _commits(spark)
    sets = {}
    for r in files.where("file_path IS NOT NULL").collect():
        sets.setdefault(r.commit_hash, set()).add(r.file_path)
    want = sorted((a, b) for s in sets.values() if len(s) <= 4 for a in s for b in s if a < b)
    assert sorted((r.file_a, r.file_b) for r in history._pairs(commits, files, 4).collect()) == want


def test_dates_are_read_once_a_commit(spark):
    commits, files = _commits(spark)
    plan = history.churn(commits, files, catalog.AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "try_to_timestamp" not in plan[: plan.index("Join")] and "unix_micros" not in plan[: plan.index("Join")]
    scores = history.churn_scores(commits, files, catalog.AS_OF)
    assert sorted(map(tuple, scores.collect()), key=str) == sorted(map(tuple, history.churn(commits, files, catalog.AS_OF).select("file_path", "churn_score").collect()), key=str)


def test_kept_views_hold_what_is_read(spark):
    v = catalog.Views(spark, "/root/testdata/sf0.001", catalog.RISK_VIEWS)
    assert v.commit_files.columns == ["commit_hash", "file_path"] and v.test_units.columns == ["file_path"]
    plan = catalog._coupled(v)._jdf.queryExecution().optimizedPlan().toString()
    assert "last_co_commit" not in plan and "unix_micros" not in plan
