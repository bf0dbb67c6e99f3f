"""F16: a compacted file, and so the task that writes it, is of about the target size and not of up to twice as much."""

import glob
import os

from ripplemark.operators.store import Store


def test_compaction_rounds_up(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write("code_units", spark.range(0, 20_000, 1, 4).selectExpr("sha2(CAST(id AS STRING), 256) AS id", "'f' AS file_path", "'n' AS name"))
    files = lambda: glob.glob(f"{s._current('code_units')}/*.parquet")
    assert 1 << 20 < sum(map(os.path.getsize, files())) < 2 << 20
    s.compact(target_mb=1)
    assert len(files()) == 2 and s.read("code_units").count() == 20_000
