"""The analytics tables as views over a TPC-H-like star schema, so that every operator can run on any such data.

One SQL text defines a view for Spark and for the SQL counterparts of the queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-12-31 00:00:00"
BRANCH_SINCE = "2001-06-01 00:00:00"
N = "(SELECT count(*) FROM supplier)"


def code_file(key: str) -> str:
    return f"concat('src/d', CAST({key} % 7 AS STRING), '/f', CAST({key} AS STRING), '.py')"


def test_file(key: str) -> str:
    return f"concat('src/d', CAST({key} % 7 AS STRING), '/test_f', CAST({key} AS STRING), '.py')"


#: Each view says which rows of the star schema are rows of the table: a test edge, an import and a static import are lines
#: of a given quantity, discount or return, which leaves files without tests and a sparse import graph.
VIEWS: dict[str, str] = {
    "commits": "SELECT o_orderkey AS hash, o_custkey AS author, o_orderdate AS date, o_orderpriority AS message FROM orders",
    "branch_commits": f"SELECT o_orderkey AS hash, o_custkey AS author, o_orderdate AS date FROM orders WHERE o_orderdate >= TIMESTAMP '{BRANCH_SINCE}'",
    "commit_files": f"SELECT l_orderkey AS commit_hash, {code_file('l_suppkey')} AS file_path, CAST(sum(l_quantity) AS BIGINT) AS insertions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lineitem GROUP BY 1, 2",
    "unit_commits": f"SELECT l_orderkey AS commit_hash, {code_file('l_suppkey')} AS file_path, concat('u', CAST(l_partkey % 3 AS STRING)) AS unit_name, CAST(sum(l_quantity) AS BIGINT) AS insertions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lineitem GROUP BY 1, 2, 3",
    "files": f"SELECT {code_file('s_suppkey')} AS file_path FROM supplier",
    "code_units": f"SELECT CAST(p_partkey AS STRING) AS id, {code_file(f'(p_partkey % {N})')} AS file_path, p_name AS name, p_type AS unit_type, 1 AS line_start, p_size AS line_end FROM part",
    "test_units": f"SELECT CAST(c_custkey AS STRING) AS id, {test_file('c_nationkey')} AS file_path, c_name AS name, c_mktsegment AS framework FROM customer",
    "test_edges": "SELECT CAST(o_custkey AS STRING) AS test_id, CAST(l_partkey AS STRING) AS code_id, CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'import' ELSE 'dynamic_import' END AS edge_type, max(1 - l_discount) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45 GROUP BY 1, 2, 3",
    "test_results": "SELECT CAST(user_id AS STRING) AS test_id, event_type <> 'error' AS passed, value AS duration_ms, ts AS recorded_at, event_id FROM events",
    "blame": f"SELECT {code_file('l_suppkey')} AS file_path, CAST(l_partkey % 20 AS STRING) AS author, concat(CAST(l_partkey % 20 AS STRING), '@x') AS author_email, 1 AS line_start, CAST(l_quantity AS INT) AS line_end FROM lineitem",
    "import_edges": f"SELECT {code_file('l_suppkey')} AS importer_file, {code_file(f'(l_partkey % {N})')} AS imported_file, max(CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 3e-1 END) AS confidence FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R' AND l_suppkey <> l_partkey % {N} GROUP BY 1, 2",
    "static_imports": f"SELECT {test_file('c_nationkey')} AS test_file_path, c_name AS test_unit_name, {code_file(f'(l_partkey % {N})')} AS target_file_path, true AS gap_eligible, max(1 - l_tax) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_discount >= 9e-2 AND l_quantity >= 40 GROUP BY 1, 2, 3, 4",
}

#: The same tables of all lines: every order line is a test edge, an import and a static import.
WHOLE = ("test_edges", "import_edges", "static_imports")
VIEWS |= {
    "all_test_edges": VIEWS["test_edges"].replace(" WHERE l_quantity >= 45", ""),
    "all_import_edges": VIEWS["import_edges"].replace("l_quantity >= 50 AND l_returnflag = 'R' AND ", ""),
    "all_static_imports": VIEWS["static_imports"].replace(" WHERE l_discount >= 9e-2 AND l_quantity >= 40", ""),
}


def of_all_lines(sql: str) -> str:
    """``sql`` over the views of all lines instead."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(WHOLE)})\b", r"\1 all_\2", sql)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def used_tables(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = used_tables(sql)
    braced = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in tables else m[0], sql)
    return spark.sql(braced, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _run(spark, sf_dir, VIEWS[name])


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the views and tables that it names."""
    return _run(spark, sf_dir, with_views(sql))


def with_views(sql: str) -> str:
    """``sql`` with the views that it names as common table expressions (``WITH RECURSIVE`` texts continue the list)."""
    needed = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    m = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if m and head:
        return f"WITH {m[1] or ''}{head}, {sql[m.end() :]}"
    return f"WITH {head} {sql}" if head else sql
