"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from ripplemark.operators.store import Store, last_of_each


def failure_rates(results: DataFrame) -> DataFrame:
    """Running failure statistics of an append-only stream of test results (``update`` or ``complete`` mode)."""
    out = results.groupBy("test_id").agg(F.count("*").alias("total_runs"), F.count_if(~F.col("passed")).alias("failures"))
    return out.withColumn("failure_rate", F.col("failures") / F.col("total_runs"))


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = list(zip(*state.get)) if state.exists else []
    for b in batches:
        b = b[b["duration_ms"].notna()]
        rows = sorted(rows + [(int(t.value), float(d)) for t, d in zip(pd.to_datetime(b["recorded_at"]), b["duration_ms"])])[-20:]
    state.update(([t for t, _ in rows], [d for _, d in rows]))
    values = pd.Series([d for _, d in rows], dtype="float64")
    known = len(values) >= 3 and values.mean() > 0
    yield pd.DataFrame({"test_id": [key[0]], "duration_cv": [min(1.0, values.std(ddof=0) / values.mean()) if known else None], "runs": [len(values)]})


def duration_spread(results: DataFrame) -> DataFrame:
    """The spread of the latest 20 durations of each test; its state is those 20, and no more are held beside an Arrow batch."""
    rows = results.select("test_id", "recorded_at", "duration_ms")
    return rows.groupBy("test_id").applyInPandasWithState(_latest, "test_id string, duration_cv double, runs int", "at array<bigint>, duration array<double>", "update", GroupStateTimeout.NoTimeout)


def new_commits(commits: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each commit once, though pages of the log overlap; hashes older than the watermark are forgotten."""
    return commits.withWatermark("committed_at", delay).dropDuplicatesWithinWatermark(["hash"])


def upsert_into(store: Store, table: str, order: list[str] | None = None, stream: str | None = None):
    """For ``foreachBatch``: each batch into a keyed table; empty batches write nothing.

    A batch that is run again after a failure sets the same rows again.  With the name of a ``stream`` its last batch is
    noted in the store, and one that has been written is passed over, so it does not undo what others have set since.
    """
    key = f"stream:{stream}:{table}"

    def run(batch: DataFrame, number: int) -> None:
        done = store.get_meta(key) if stream else None
        if batch.isEmpty() or done is not None and int(done) >= number:
            return
        store.upsert(table, batch, order)
        if stream:
            store.set_meta(**{key: number})

    return run


def activity(events: DataFrame, length: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events by type in tumbling windows, late ones within ``delay`` included.  An extension; see README."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class LockRequests(StatefulProcessor):
    """The requests for one file.  They wait in a list until the watermark has passed them; a batch is one call of the state.

    One timer a file wakes it: for the earliest request that waits, or for the end of the lock that is held.  Then all
    requests that are due are answered in the order of event time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", "agent_id string, until bigint, wake bigint")
        self.waiting = handle.getListState("waiting", "at bigint, agent_id string, action string, ttl bigint")

    def _held(self) -> tuple[str | None, int, int | None]:
        return self.lock.get() if self.lock.exists() else (None, 0, None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            if len(b):
                self.waiting.appendList(list(zip(*(b[c].tolist() for c in ("at_ms", "agent_id", "action", "ttl_ms")))))
                least = int(b["at_ms"].min())
                first = least if first is None else min(first, least)
        agent, until, wake = self._held()
        # A timer fires once the watermark is beyond its time, a request is due once the watermark has reached it.
        if first is not None and (wake is None or first - 1 < wake):
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(first - 1)
            self.lock.update((agent, until, first - 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        path, mark = key[0], timerValues.getCurrentWatermarkInMs()
        agent, until, _ = self._held()
        due, later, out = [], [], []
        for request in self.waiting.get() if self.waiting.exists() else ():
            (due if request[0] <= mark else later).append(tuple(request))

        def expire(now: int) -> None:
            nonlocal agent
            if agent is not None and until < now:
                out.append((path, until + 1, agent, "expired"))
                agent = None

        for at, who, action, ttl in sorted(due, key=lambda r: tuple((x is not None, x) for x in r)):
            expire(at)
            if action == "release":
                out.append((path, at, who, "not_held" if agent is None or agent != who else "released"))
                agent = None if agent == who else agent
            elif agent in (None, who):
                agent, until = who, at + ttl
                out.append((path, at, who, "acquired"))
            else:
                out.append((path, at, who, "held"))
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        expire(mark)
        times = [*([min(r[0] for r in later) - 1] if later else []), *([until] if agent is not None else [])]
        if times:
            self.handle.registerTimer(min(times))
            self.lock.update((agent, until, min(times)))
        else:
            self.lock.clear()
        if out:
            yield pd.DataFrame(out, columns=["file_path", "at_ms", "agent_id", "status"], dtype=object)


def locks(requests: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Lock requests (``file_path, agent_id, action, ttl_ms, at``) to what became of them, once no earlier ones can come.

    Locks expire in event time: a lock that is neither released nor taken again gives a row ``expired`` at the first
    millisecond that it does not cover, once the watermark or a later request is beyond it.  Requests of one time are
    answered in the order of their agents and actions, repeated ones one by one.  Requests without a file, a time or an
    agent are left out; one without a ``ttl_ms`` holds for its own millisecond.  To be started in :func:`timers`.
    """
    rows = requests.where("file_path is not null and at is not null and agent_id is not null")
    rows = rows.withWatermark("at", delay).select("file_path", "agent_id", "action", F.coalesce("ttl_ms", F.lit(0)).cast("bigint").alias("ttl_ms"), "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("file_path").transformWithStateInPandas(LockRequests(), "file_path string, at_ms bigint, agent_id string, status string", "append", "eventTime")


@contextmanager
def timers(spark: SparkSession):
    """Queries started in this block keep their state in RocksDB, which state with timers and maps needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batch_writer(folder: str):
    """For ``foreachBatch``: the rows of each batch in a folder of its own; a batch that is run again replaces its rows."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/stream_batch={number}")

    return run


def batches(spark: SparkSession, folder: str, schema: StructType, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """What :func:`batch_writer` has written: all rows; in ``complete`` mode the last result, in ``update`` mode the last row of each ``key``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("stream_batch", LongType())])).parquet(folder)
    if mode == "complete":
        last = rows.agg(F.max("stream_batch")).first()[0]
        rows = rows.where(F.col("stream_batch") == (-1 if last is None else last))
    elif mode == "update":
        rows = last_of_each(rows, key, ["stream_batch"])
    return rows.select(*[f"`{f.name}`" for f in schema.fields])


def written(rows: DataFrame, folder: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """What a stream has written to ``folder`` once all its input is read; in ``complete`` mode its last result, in ``update`` mode the last row of each ``key``.

    Every batch goes to files of its own from the executors; nothing passes through the driver, and a batch that is run
    again after a failure is there once.
    """
    query = rows.writeStream.foreachBatch(batch_writer(f"{folder}/rows")).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return batches(rows.sparkSession, f"{folder}/rows", rows.schema, mode, key)
