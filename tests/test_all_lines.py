"""edges of all lines are those of the view, in tasks that follow the number of lines."""

from pyspark.sql import functions as F

from ripplemark.operators import coverage
from ripplemark.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_edges_of_all_lines_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(catalog, "LINES_PER_TASK", 1_000)
    v = catalog.AllLines(spark, DATA)
    edges, deal = v.dealt_test_edges()
    assert deal == -(-catalog.table(spark, DATA, "lineitem").count() // 1_000) > 4 and edges.rdd.getNumPartitions() == deal
    key = lambda df: sorted((*r[:3], round(r[3], 9)) for r in df.select("test_id", "code_id", "edge_type", "weight").collect())
    assert key(edges) == key(v.test_edges)


def test_pairs_of_files_and_tests_are_dealt(spark):
    """pairs of files and tests, F18: rows of tests."""
    v = catalog.AllLines(spark, DATA)
    pairs = coverage.covering_tests(v.code_units, v.test_edges, 7)
    assert pairs.rdd.getNumPartitions() == 7 and sorted(map(tuple, pairs.collect())) == sorted(map(tuple, coverage.covering_tests(v.code_units, v.test_edges).collect()))
    rows = coverage.direct_impact(v.code_units, v.test_edges, v.test_units, v.files, 7)
    plain = coverage.direct_impact(v.code_units, v.test_edges, v.test_units, v.files)
    assert rows.rdd.getNumPartitions() == 7
    count = lambda df: sorted(map(tuple, df.groupBy("file_path", "test_id").agg(F.count("*")).collect()))
    assert count(rows) == count(plain)
