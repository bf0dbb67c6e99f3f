"""The tables of the analytics model as Spark schemas, with the key of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Column names and types, as Spark reads them.
TABLES: dict[str, str] = {
    "code_units": "id string, file_path string, name string, unit_type string, line_start int, line_end int, content_hash string, updated_at timestamp",
    "test_units": "id string, file_path string, name string, framework string, line_start int, line_end int, content_hash string, updated_at timestamp",
    "test_edges": "test_id string, code_id string, edge_type string, weight double",
    "commits": "hash string, author string, author_email string, date string, message string",
    "commit_files": "commit_hash string, file_path string, insertions bigint, deletions bigint",
    "blame_cache": "file_path string, line_start int, line_end int, commit_hash string, author string, author_email string, date string, content_hash string",
    "co_changes": "file_a string, file_b string, co_commit_count bigint, last_co_commit string",
    "branch_co_changes": "file_a string, file_b string, co_commit_count bigint, last_co_commit string",
    "churn_stats": "file_path string, unit_name string, commit_count bigint, distinct_authors bigint, total_insertions bigint, total_deletions bigint, last_changed string, churn_score double",
    "file_hashes": "file_path string, content_hash string, updated_at timestamp, mtime double, size bigint",
    "import_edges": "importer_file string, imported_file string, confidence double",
    "static_test_imports": "test_file_path string, test_unit_name string, target_file_path string, gap_eligible boolean, score double",
    "test_results": "test_id string, passed boolean, duration_ms bigint, recorded_at timestamp",
    "meta": "key string, value string",
    "file_locks": "file_path string, agent_id string, acquired_at double, expires_at double, purpose string",
    "bg_jobs": "id string, kind string, status string, result_json string, error_message string, progress_pct int, created_at string, updated_at string, cancel_requested_at string, started_at string",
    "job_events": "id bigint, job_id string, event_type string, payload_json string, created_at string",
}

KEYS: dict[str, list[str]] = {
    "code_units": ["id"],
    "test_units": ["id"],
    "test_edges": ["test_id", "code_id", "edge_type"],
    "commits": ["hash"],
    "commit_files": ["commit_hash", "file_path"],
    "blame_cache": ["file_path", "line_start"],
    "co_changes": ["file_a", "file_b"],
    "branch_co_changes": ["file_a", "file_b"],
    "churn_stats": ["file_path", "unit_name"],
    "file_hashes": ["file_path"],
    "import_edges": ["importer_file", "imported_file"],
    "static_test_imports": ["test_file_path", "test_unit_name", "target_file_path"],
    "meta": ["key"],
    "file_locks": ["file_path"],
    "bg_jobs": ["id"],
    "job_events": ["id"],
}

EDGE_TYPES = ("call", "import", "dynamic_import", "eval_import", "tainted_import", "heuristic")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
