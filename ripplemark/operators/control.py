"""Control tables: advisory file locks with a time to live, and background jobs with events."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators.store import Store
from ripplemark.schemas import TABLES
from ripplemark.session import cut

STALE_SECONDS, STALE_JOB_SECONDS = 60, 1800


def swept(jobs, now: float):
    """``jobs`` with running ones that have no start, or started over half an hour ago, as failed."""
    late = (F.col("status") == "running") & (F.col("started_at").isNull() | (F.col("started_at").cast("double") < now - STALE_JOB_SECONDS))
    return jobs.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def answered(locks: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """What becomes of a batch of requests (``file_path, agent_id, action, ttl, purpose``) that come at one moment.

    Releases count first, then refreshes, then acquires, of which the first agent by name gets a free file.  Requests
    that differ only in time and purpose are one, for the longest time.  Those without a file or an agent, or with
    another action, have no answer.  Requests for one file are never gathered: the lock of each file follows from
    aggregates, and meets the requests by the file.  Columns: those of a request, ``status``, ``owner`` after the batch
    (null: nobody) and ``acquired_at``, ``expires_at`` and ``held_for`` of the lock before it.
    """
    asked = requests.where(F.col("file_path").isNotNull() & F.col("agent_id").isNotNull() & F.col("action").isin("acquire", "refresh", "release"))
    asked = asked.groupBy("file_path", "agent_id", "action").agg(F.coalesce(F.max("ttl"), F.lit(0)).alias("ttl"), F.max("purpose").alias("purpose"))
    held = locks.where(F.col("expires_at") >= now).select("file_path", F.col("agent_id").alias("holder"), "acquired_at", "expires_at", F.col("purpose").alias("held_for"))
    rows = asked.join(held, "file_path", "left")
    own = F.coalesce(F.col("agent_id") == F.col("holder"), F.lit(False))
    freed = rows.groupBy("file_path").agg(F.bool_or((F.col("action") == "release") & own).alias("freed"), F.min(F.when(F.col("action") == "acquire", F.col("agent_id"))).alias("first"))
    rows = rows.join(freed, "file_path").withColumn("owner", F.when(F.col("holder").isNotNull() & ~F.col("freed"), F.col("holder")).otherwise(F.col("first")))
    status = F.when(F.col("action") == "acquire", F.when(F.col("agent_id") == F.col("owner"), "acquired").otherwise("held"))
    status = status.when(F.col("action") == "release", F.when(own, "released").otherwise("not_held")).otherwise(F.when(own & ~F.col("freed"), "refreshed").otherwise("not_held"))
    return rows.select("file_path", "agent_id", "action", "ttl", "purpose", status.alias("status"), "owner", "holder", "freed", "acquired_at", "expires_at", "held_for")


def after(locks: DataFrame, answers: DataFrame, now: float) -> DataFrame:
    """The locks that hold once a batch has been answered; who goes on holding a file keeps since when, and why if no reason is given."""
    granted = answers.where(F.col("status").isin("acquired", "refreshed"))
    kept = F.coalesce((F.col("holder") == F.col("agent_id")) & ~F.col("freed"), F.lit(False))
    granted = granted.groupBy("file_path", "agent_id").agg(F.first(F.when(kept, F.col("acquired_at")).otherwise(F.lit(now))).alias("acquired_at"), (F.max("ttl") + now).alias("expires_at"), F.coalesce(F.max("purpose"), F.first(F.when(kept, F.col("held_for")))).alias("purpose"))
    gone = answers.where(F.col("status").isin("acquired", "refreshed", "released")).select("file_path").distinct()
    return locks.where(F.col("expires_at") >= now).join(gone, "file_path", "left_anti").unionByName(granted.select(*locks.columns))


class _Refused(Exception):
    """A lock is not ours; ``held`` is who has it."""

    def __init__(self, held):
        super().__init__()
        self.held = held


class Locks:
    """Locks of files by agents; expired ones do not count.  ``now`` is a clock, for tests.

    What a change rests on is checked on the version that it replaces, so of two agents one gets the lock.
    """

    def __init__(self, store: Store, now: Callable[[], float] = time.time):
        self.store, self.now = store, now

    def _active(self, rows=None):
        return (self.store.read("file_locks") if rows is None else rows).where(F.col("expires_at") >= self.now())

    def _one(self, path: str, rows=None):
        return self._active(rows).where(F.col("file_path") == path).first()

    def _put(self, path: str, agent: str, ttl: int, purpose: str | None, own_only: bool) -> dict:
        now = self.now()

        def taken(rows):
            held = self._one(path, rows)
            if held.agent_id != agent if held else own_only:
                raise _Refused(held)
            row = [(path, agent, held.acquired_at if held else now, now + ttl, held.purpose if held and purpose is None else purpose)]
            return self._active(rows).where(F.col("file_path") != path).unionByName(self.store.spark.createDataFrame(row, rows.schema))

        self.store.change("file_locks", taken)
        return {"status": "acquired", "file_path": path, "agent_id": agent, "expires_at": now + ttl}

    def acquire(self, path: str, agent: str, ttl: int = 300, purpose: str | None = None) -> dict:
        try:
            return self._put(path, agent, ttl, purpose, False)
        except _Refused as e:
            return {"status": "held", "file_path": path, "held_by": e.held.agent_id, "expires_at": e.held.expires_at}

    def release(self, path: str, agent: str) -> dict:
        def freed(rows):
            held = self._one(path, rows)
            if not held or held.agent_id != agent:
                raise _Refused(held)
            return self._active(rows).where(F.col("file_path") != path)

        try:
            self.store.change("file_locks", freed)
            return {"status": "released", "file_path": path}
        except _Refused:
            return {"status": "not_held", "file_path": path}

    def refresh(self, path: str, agent: str, ttl: int = 300) -> dict:
        try:
            return self._put(path, agent, ttl, None, True) | {"status": "refreshed"}
        except _Refused:
            return {"status": "not_held", "file_path": path}

    def request(self, requests: DataFrame) -> DataFrame:
        """A batch of requests for any number of files in one change of the table; its answers (see :func:`answered`)."""
        now, found = self.now(), []

        def changed(rows):
            found[:] = [cut(answered(rows, requests, now))]
            return after(rows, found[0], now)

        self.store.change("file_locks", changed)
        return found[0]

    def check(self, path: str) -> dict:
        held = self._one(path)
        if not held:
            return {"file_path": path, "locked": False}
        left = held.expires_at - self.now()
        return {"file_path": path, "locked": True, "held_by": held.agent_id, "expires_in": left, "stale": left < STALE_SECONDS, "purpose": held.purpose}

    def check_many(self, paths: list[str]) -> list[dict]:
        held = {r.file_path: r for r in self._active().where(F.col("file_path").isin(*paths)).collect()}
        return [{"file_path": p, "locked": p in held, "held_by": held[p].agent_id if p in held else None} for p in paths]

    def list(self, agent: str | None = None) -> list[dict]:
        rows = self._active() if agent is None else self._active().where(F.col("agent_id") == agent)
        return [r.asDict() for r in rows.orderBy(F.desc("acquired_at")).collect()]


class Cancelled(Exception):
    """A job that was asked to end has ended before the phase that this names."""


class Jobs:
    """Background jobs as threads whose Spark work is one job group each, so that cancelling stops it."""

    def __init__(self, store: Store, now: Callable[[], float] = time.time):
        self.store, self.now, self._lock = store, now, threading.Lock()

    def _put(self, **row) -> None:
        with self._lock:
            table = self.store.read("bg_jobs")
            old = table.where(F.col("id") == row["id"]).first()
            full = {**(old.asDict() if old else dict.fromkeys(table.columns)), **row, "updated_at": str(self.now())}
            self.store.upsert("bg_jobs", self.store.spark.createDataFrame([tuple(full[c] for c in table.columns)], table.schema))

    def event(self, job_id: str, kind: str, payload: dict | None = None) -> None:
        with self._lock:
            row = [(time.time_ns(), job_id, kind, json.dumps(payload or {}), str(self.now()))]
            self.store.append("job_events", self.store.spark.createDataFrame(row, TABLES["job_events"]))

    def step(self, job_id: str, phase: str, percent: int) -> None:
        """Notes that a job has come to a phase; a job that is to be cancelled ends here."""
        if self.cancelled(job_id):
            raise Cancelled(phase)
        self._put(id=job_id, progress_pct=percent)
        self.event(job_id, "phase_start", {"phase": phase})

    def start(self, kind: str, work: Callable[[Callable], dict]) -> dict:
        """Runs ``work(step)``; one job at a time, else ``busy``.

        ``step(phase, percent)`` notes how far the work is and ends it if the job is to be cancelled; ``step()`` only
        says whether it is.
        """
        self.sweep()
        job, other = uuid.uuid4().hex, None
        now = str(self.now())
        new = dict(id=job, kind=kind, status="running", created_at=now, started_at=now, updated_at=now, progress_pct=0)

        def add(old):
            """Checked on the very version that this row is added to: of two starts at a time one is refused."""
            nonlocal other
            running = old.where(F.col("status") == "running").first()
            other = running and running.id
            return old if running else old.unionByName(self.store.spark.createDataFrame([tuple(new.get(c) for c in old.columns)], old.schema))

        with self._lock:
            self.store.change("bg_jobs", add)
        if other:
            return {"status": "busy", "job_id": other}
        self.event(job, "started", {"kind": kind})

        def run() -> None:
            self.store.spark.sparkContext.setJobGroup(job, kind, True)
            try:
                result = work(lambda phase=None, percent=0: self.cancelled(job) if phase is None else self.step(job, phase, percent))
                self._put(id=job, status="cancelled" if self.cancelled(job) else "completed", result_json=json.dumps(result, default=str), progress_pct=100)
                self.event(job, "finished")
            except Exception as e:
                self._put(id=job, status="cancelled" if self.cancelled(job) else "failed", error_message=str(e)[:2000])

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return {"status": "running", "job_id": job, "thread": thread}

    def cancelled(self, job_id: str) -> bool:
        row = self.store.read("bg_jobs").where(F.col("id") == job_id).first()
        return bool(row and row.cancel_requested_at)

    def cancel(self, job_id: str) -> dict:
        row = self.store.read("bg_jobs").where(F.col("id") == job_id).first()
        if not row:
            return {"status": "not_found", "job_id": job_id}
        self._put(id=job_id, cancel_requested_at=str(self.now()))
        self.store.spark.sparkContext.cancelJobGroup(job_id)
        return {"status": "cancel_requested", "job_id": job_id}

    def status(self, job_id: str, limit: int = 20) -> dict:
        row = self.store.read("bg_jobs").where(F.col("id") == job_id).first()
        if not row:
            return {"status": "not_found", "job_id": job_id}
        events = self.store.read("job_events").where(F.col("job_id") == job_id).orderBy(F.desc("id")).limit(limit).collect()
        out = row.asDict()
        out["result"] = json.loads(out.pop("result_json") or "null")
        out["events"] = [r.asDict() | {"payload": json.loads(r.payload_json)} for r in events]
        return out

    def sweep(self) -> None:
        """Running jobs without a start, or that started over half an hour ago, have failed."""
        table = self.store.read("bg_jobs")
        late = swept(table.where("status = 'running'"), self.now()).where("status = 'failed'")
        for r in late.collect():
            self._put(id=r.id, status="failed", error_message="stale")
