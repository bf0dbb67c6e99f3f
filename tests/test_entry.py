"""The driver contract holds with and without the text operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from ripplemark.plans import catalog

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_without_the_folders_of_the_text_operators(tmp_path):
    """On a copy from which the folders are deleted, with the pipeline's file and without it."""
    copy = str(tmp_path / "copy")
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; from ripplemark.plans import catalog as c; assert e.queries() == c.QUERIES and e.oracle_sql() == c.ORACLE_SQL"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": copy})
        if os.path.exists(pipeline := f"{copy}/corpus_pipeline.py"):
            os.remove(pipeline)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["file_path", "risk_score"]
