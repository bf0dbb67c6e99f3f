"""What one task or one call of a state takes does not follow the size of the input."""

import pandas as pd

from ripplemark.functions import extract
from ripplemark.streaming.streams import LockRequests


def test_units_of_tests_are_dealt_by_file(spark):
    """one split of many files is dealt out before its units are made; units and marks are not joined."""
    files = spark.createDataFrame([("t/test_a.py", "def test_x():\n    pass\n"), ("t/FTest.java", "class FTest {\n  @Test\n  void works() {\n  }\n}\n"), ("src/b.py", "def test_y():\n    pass\n"), ("t/test_n.py", None)], "file_path string, content string")
    got = extract.test_units(files.coalesce(1))
    assert sorted(r["id"] for r in got.collect()) == ["t/FTest.java:works", "t/test_a.py:test_x"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("RepartitionByExpression")


class _Waiting:
    def __init__(self):
        self.calls, self.rows = 0, []

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def clear(self):
        self.calls, self.rows = self.calls + 1, []


class _Handle:
    def __init__(self):
        self.waiting, self.value, self.timers = _Waiting(), None, []
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove

    def getListState(self, *_):
        return self.waiting

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_batch_of_lock_requests_is_one_call_of_the_state():
    """calls of the state do not follow the number of requests."""
    handle, locks = _Handle(), LockRequests()
    locks.init(handle)
    rows = pd.DataFrame({"at_ms": range(1000), "agent_id": [f"a{i % 3}" for i in range(1000)], "action": "acquire", "ttl_ms": 10})
    assert list(locks.handleInputRows(("f",), iter([rows, rows[:0]]), _Mark(0))) == [] and handle.timers == [-1]
    out = pd.concat(locks.handleExpiredTimer(("f",), _Mark(899), None))
    assert len(out[out.status != "expired"]) == 900 and [r[0] for r in handle.waiting.rows] == list(range(900, 1000))
    assert handle.waiting.calls <= 3


def test_pairs_of_commits_are_dealt(spark, monkeypatch):
    """The number of tasks that make pairs follows the number of commits."""
    from ripplemark.operators import history

    monkeypatch.setattr(history, "COMMITS_PER_TASK", 10)
    commits = spark.range(100).selectExpr("id AS hash", "timestamp '2026-01-01' AS date")
    files = commits.selectExpr("hash AS commit_hash", "explode(array('a', 'b', 'c')) AS file_path")
    assert history._pairs(commits, files, 50).rdd.getNumPartitions() == 10
    assert {(r["file_a"], r["file_b"], r["co_commit_count"]) for r in history.co_changes(commits, files).collect()} == {("a", "b", 100), ("a", "c", 100), ("b", "c", 100)}
