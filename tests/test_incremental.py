"""What is read again and what is not: listings, commits, appended rows, replayed batches, jobs."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from ripplemark.operators import control
from ripplemark.operators.store import Store
from ripplemark.plans.project import Project
from ripplemark.sources import files as file_source
from ripplemark.sources import git, tree
from ripplemark.streaming import streams


def write(root, path, text="x = 1\n"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


class Repo:
    def __init__(self, root):
        self.root, self.day = str(root), 1
        self.run("init", "-q", "-b", "main")
        self.run("config", "user.email", "a@b.c")
        self.run("config", "user.name", "Al")

    def run(self, *args):
        date = f"2026-01-{self.day:02}T10:00:00+00:00"
        return subprocess.run(["git", "-C", self.root, *args], check=True, capture_output=True, text=True, env=os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date}).stdout.strip()

    def commit(self, path, text, *how):
        write(self.root, path, text)
        self.run("add", "-A")
        self.run("commit", "-qm", path, *how)
        self.day += 1
        return self.run("rev-parse", "HEAD")


@pytest.fixture()
def repo(tmp_path):
    (tmp_path / "repo").mkdir()
    r = Repo(tmp_path / "repo")
    for i in range(3):
        r.commit("app.py", f"def f{i}():\n    return {i}\n")
    return r


# --- listing -----------------------------------------------------------------------------------------------------


def test_every_source_file_is_found(spark, tmp_path):
    names = ["a.py", "__init__.py", "_util.py", ".hidden/h.py", "pkg/__init__.py", "pkg/_x/b.py", "__tests__/c.test.js", "pkg/environment/d.py", "odd name é.py"]
    for n in names:
        write(tmp_path, n, f"# {n}\n")
    write(tmp_path, "notes.txt")
    for n in ("node_modules/x.js", "vendor/v.go", "pkg/env/e.py", "pkg/deep/.venv/lib/f.py"):
        write(tmp_path, n)
    with open(tmp_path / "node_modules/huge.js", "wb") as f:
        f.truncate(3 << 30)  # longer than any binary value may be; a hole, so it takes no disk
    rows = file_source.source_files(spark, str(tmp_path)).collect()
    assert {r.file_path: r.content for r in rows} == {n: f"# {n}\n" for n in names}
    assert all(r.size == len(r.content.encode()) and abs(r.mtime - os.stat(tmp_path / r.file_path).st_mtime) < 0.01 for r in rows)
    visible = spark.createDataFrame([("a.py",), ("gone.py",)], "file_path string")
    assert [r.file_path for r in file_source.source_files(spark, f"file://{tmp_path}", visible).collect()] == ["a.py"]
    assert {r.file_path for r in file_source.source_files(spark, str(tmp_path), directory="pkg").collect()} == {"pkg/__init__.py", "pkg/_x/b.py", "pkg/environment/d.py"}
    assert file_source.source_files(spark, str(tmp_path), directory="none").count() == 0
    with pytest.raises(ValueError):
        tree.local_path("hdfs://host/a")


@pytest.mark.parametrize("branches", [1, 2, 1000])
def test_listing_enters_no_skipped_directory(tmp_path, monkeypatch, branches):
    """However the walk is dealt out; nor does it enter what is beside the directory that is asked for."""
    for n in ("a/b/c/x.py", "a/y.py", "d/z.py", "d/target/t.py", "node_modules/m/q.js", "top.py"):
        write(tmp_path, n)
    os.symlink(tmp_path / "a", tmp_path / "d/link")
    entered, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: entered.append(os.path.relpath(p, tmp_path)) or scan(p))

    def found(**options):
        reader = tree.TreeReader({"path": str(tmp_path), "branches": str(branches), **options})
        return sorted(path for part in reader.partitions() for path, _, _ in reader.read(part))

    assert found() == ["a/b/c/x.py", "a/y.py", "d/z.py", "top.py"]
    assert set(entered) == {".", "a", "a/b", "a/b/c", "d"}
    entered.clear()
    assert found(directory="a/b") == ["a/b/c/x.py"] and set(entered) == {"a/b", "a/b/c"}
    entered.clear()
    assert found(directory="../") == [] and found(directory="node_modules/m") == [] and not entered


# --- commits -----------------------------------------------------------------------------------------------------


def test_stream_of_commits(spark, repo, tmp_path):
    """A query goes on from its checkpoint with the new commits alone; a rewritten branch is read as a whole."""
    read = []

    def drain():
        read.clear()
        query = git.commit_stream(spark, repo.root).writeStream.foreachBatch(lambda df, _: read.extend(r.hash for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return list(read)

    every = repo.run("rev-list", "HEAD").split()
    assert sorted(drain()) == sorted(every) and drain() == []
    new = [repo.commit("b.py", "b = 1\n"), repo.commit("c.py", "c = 1\n")]
    assert sorted(drain()) == sorted(new)
    repo.commit("c.py", "c = 2\n", "--amend")
    assert sorted(drain()) == sorted(repo.run("rev-list", "HEAD").split())


def test_log_after_a_commit(spark, repo):
    old = repo.run("rev-parse", "HEAD")
    new = repo.commit("b.py", "b = 1\n")
    hashes = lambda **how: {r.hash for r in git.git_log(spark, repo.root, **how).select("hash").collect()}
    assert hashes(after=old) == {new} and hashes(after=new) == set()
    assert hashes(after="0" * 40) == hashes() and len(hashes()) == 4
    assert git.is_ancestor(repo.root, old, new) and not git.is_ancestor(repo.root, new, old)


def test_update_reads_new_commits_only(spark, repo, tmp_path):
    p = Project(spark, repo.root, str(tmp_path / "store"))
    assert p.analyze()["commits_read"] == 3
    assert p.update() == {"status": "no_changes", "changed_files": 0, "new_commits": 0, "commits_read": 0}
    repo.commit("util.py", "import app\n")
    done = p.update()
    assert (done["commits_read"], done["new_commits"], done["changed_files"], done["commits"]) == (1, 1, 1, 4)
    whole = Project(spark, repo.root, str(tmp_path / "other"))
    whole.analyze()
    for t in ("commits", "commit_files", "co_changes"):
        assert sorted(map(str, p.t(t).collect())) == sorted(map(str, whole.t(t).collect()))
    commits = lambda q: sorted((r.file_path, r.commit_count) for r in q.t("churn_stats").where("unit_name = ''").collect())
    assert commits(p) == commits(whole)
    repo.commit("util.py", "import app, os\n", "--amend")
    assert p.update()["commits_read"] == 4  # rewritten: all of them


def test_only_git_errors_mean_no_history(spark, tmp_path, repo, monkeypatch):
    (tmp_path / "plain").mkdir()
    write(tmp_path / "plain", "a.py")
    done = Project(spark, str(tmp_path / "plain"), str(tmp_path / "s1")).analyze()
    assert done["git_warning"] and done["code_files_scanned"] == 1 and done["commits"] == 0

    def lost(*_, **__):
        raise OSError("no space left on device")

    monkeypatch.setattr(git, "git_log", lost)
    p = Project(spark, repo.root, str(tmp_path / "s2"))
    with pytest.raises(OSError):
        p.analyze()
    assert p.t("code_units").isEmpty()


def test_answers_are_whole(spark, tmp_path):
    (tmp_path / "r").mkdir()
    p = Project(spark, str(tmp_path / "r"), str(tmp_path / "s"))
    rows = spark.range(1500).select(F.lit("t").alias("test_id"), F.concat(F.lit("c"), "id").alias("code_id"), F.lit("call").alias("edge_type"), F.lit(1.0).alias("weight"))
    p.store.write("test_edges", rows)
    p.store.write("test_units", spark.createDataFrame([("t", "t.py", "t")], "id string, file_path string, name string"))
    stale = p.stale_tests()
    assert len(stale) == 1500 and len(p.stale_tests(limit=7)) == 7


# --- store, sinks, jobs ------------------------------------------------------------------------------------------


def test_appended_rows_appear_once(spark, tmp_path, monkeypatch):
    """A change that starts while an append has written its rows, but not claimed its number, does not take them over."""
    s = Store(spark, str(tmp_path))
    row = lambda t: spark.createDataFrame([(t, True, 1)], "test_id string, passed boolean, duration_ms bigint")
    s.write("test_results", row("t0"))
    point, inside = Store._point, []

    def slow(self, table, number, version):
        if not inside:
            inside.append(1)
            assert [r.test_id for r in s.read("test_results").collect()] == ["t0"]  # not to be seen yet
            s.change("test_results", lambda old: old)
        return point(self, table, number, version)

    monkeypatch.setattr(Store, "_point", slow)
    s.append("test_results", row("t1"))
    assert sorted(r.test_id for r in s.read("test_results").collect()) == ["t0", "t1"]
    s.append("test_results", row("t2"))
    s.compact()
    assert sorted(r.test_id for r in s.read("test_results").collect()) == ["t0", "t1", "t2"]
    s.append("test_results", row("t3"))
    assert s.upsert("meta", spark.createDataFrame([("k", "v")], "key string, value string")).count() == 1
    assert s.read("test_results").count() == 4 and s.change("test_results", lambda old: old.where("test_id > 't1'")).count() == 2


def test_replayed_batches(spark, tmp_path):
    put = streams.batch_writer(str(tmp_path / "rows"))
    schema = spark.createDataFrame([], "k string, n int").schema
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    for number, batch in enumerate([rows(("a", 1), ("b", 1)), rows(("a", 2))]):
        put(batch, number)
        put(batch, number)
    read = lambda *how: sorted(map(tuple, streams.batches(spark, str(tmp_path / "rows"), schema, *how).collect()))
    assert read() == [("a", 1), ("a", 2), ("b", 1)]
    assert read("complete") == [("a", 2)] and read("update", ["k"]) == [("a", 2), ("b", 1)]
    assert streams.batches(spark, str(tmp_path / "none"), schema).count() == 0
    s = Store(spark, str(tmp_path / "store"))
    meta = lambda v: spark.createDataFrame([("key", v)], "key string, value string")
    into = streams.upsert_into(s, "meta", stream="keys")
    into(meta("one"), 0)
    into(meta("two"), 1)
    s.set_meta(key="by hand")
    into(meta("two"), 1)
    assert s.get_meta("key") == "by hand"
    into(meta("three"), 2)
    assert s.get_meta("key") == "three"


@pytest.mark.parametrize("files", [1, 10])
def test_latest_durations_in_any_number_of_batches(spark, tmp_path, files):
    data = [(f"t{i % 3}", float((i * 7) % 11 + 1) if i % 13 else None, i) for i in range(300)]
    schema = "test_id string, duration_ms double, recorded_at timestamp"
    rows = spark.createDataFrame([(t, d, None, i) for t, d, i in data], "test_id string, duration_ms double, recorded_at timestamp, i int").withColumn("recorded_at", F.timestamp_seconds(1_700_000_000 + (F.col("i") * 37) % 300))
    rows.repartition(files, "i").drop("i").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.test_id: (round(r.duration_cv, 9), r.runs) for r in streams.written(streams.duration_spread(source), str(tmp_path / "out"), "update", ["test_id"]).collect()}
    for t in ("t0", "t1", "t2"):
        last = [d for _, d in sorted(((i * 37) % 300, d) for u, d, i in data if u == t and d is not None)][-20:]
        mean = sum(last) / 20
        assert got[t] == (round(min(1.0, (sum((d - mean) ** 2 for d in last) / 20) ** 0.5 / mean), 9), 20)


def test_jobs_tell_how_far_they_are(spark, repo, tmp_path):
    p = Project(spark, repo.root, str(tmp_path / "store"))
    started = p.jobs.start("analyze", lambda step: p.analyze(in_job=True, step=step))
    started["thread"].join(240)
    status = p.jobs.status(started["job_id"])
    assert status["status"] == "completed" and status["progress_pct"] == 100
    phases = [e["payload"]["phase"] for e in sorted(status["events"], key=lambda e: e["id"]) if e["payload"].get("phase")]
    assert phases[0] == "scan_files" and "blame" in phases and len(phases) == 7


def test_cancelled_before_the_next_phase(spark, repo, tmp_path):
    """A job that is cancelled while it scans ends before it writes any table."""
    p = Project(spark, repo.root, str(tmp_path / "store"))

    def work(step):
        def cancelling(phase, percent):
            if phase == "read_history":
                p.jobs._put(id=[r.id for r in p.t("bg_jobs").collect()][0], cancel_requested_at="1")
            step(phase, percent)

        return p.analyze(in_job=True, step=cancelling)

    started = p.jobs.start("analyze", work)
    started["thread"].join(240)
    assert p.jobs.status(started["job_id"])["status"] == "cancelled"
    assert all(p.t(t).isEmpty() for t in ("code_units", "commits", "test_edges", "file_hashes"))


def test_two_jobs_do_not_start_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [control.Jobs(Store(spark, str(tmp_path))) for _ in range(3)]  # each with a lock of its own, as in other processes

    def wait(step):
        import time

        while not step():
            time.sleep(0.2)

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda j: j.start("wait", wait), stores))
    running = [g for g in got if g["status"] == "running"]
    assert len(running) == 1 and sorted(g["status"] for g in got) == ["busy", "busy", "running"]
    stores[0].cancel(running[0]["job_id"])
    running[0]["thread"].join(60)


# --- names and long chains -----------------------------------------------------------------------------------------


def test_a_name_that_every_file_defines(spark):
    """A bare call in a test that imports one file means that file's unit, though 10,000 files have one of the name."""
    from ripplemark.operators import edges

    code = spark.range(10_000).select(F.concat(F.lit("src/f"), "id", F.lit(".py:get:function")).alias("id"), F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("file_path"), F.lit("get").alias("name"))
    tests = spark.range(200).select(F.concat(F.lit("tests/test_"), "id", F.lit(".py:t:function")).alias("id"), F.concat(F.lit("tests/test_"), "id", F.lit(".py")).alias("file_path"))
    path = F.concat(F.lit("tests/test_"), "id", F.lit(".py"))
    own = lambda name, kind, module: spark.range(200).select(path.alias("file_path"), name.alias("name"), F.lit(kind).alias("dep_type"), module.cast("string").alias("module_path"), F.lit(1.0).alias("confidence"))
    deps = own(F.concat(F.lit("f"), "id"), "import", F.concat(F.lit("src.f"), "id")).unionByName(own(F.lit("get"), "call", F.lit(None)))
    deps = deps.unionByName(spark.createDataFrame([("tests/free.py", "get", "call", None, 1.0)], deps.schema))
    tests = tests.unionByName(spark.createDataFrame([("tests/free.py:t:function", "tests/free.py")], tests.schema))
    found = edges.test_edges(tests, deps, code)
    calls = found.where("edge_type = 'call'").groupBy(F.col("test_id").startswith("tests/free").alias("free")).count().collect()
    assert {r["free"]: r["count"] for r in calls} == {False: 200, True: 10_000}
    assert found.where("edge_type = 'call' and test_id = 'tests/test_7.py:t:function'").first().code_id == "src/f7.py:get:function"


def test_long_chains(spark):
    """Thirty-two steps along a chain, and one cycle of twelve files: planning does not grow with the steps."""
    from ripplemark.operators import graph

    chain = spark.range(50).select(F.concat(F.lit("f"), "id").alias("importer_file"), F.concat(F.lit("f"), F.col("id") + 1).alias("imported_file"), F.lit(1.0).alias("confidence"))
    rows = graph.closure(chain, spark.createDataFrame([("f0",)], "file_path string"), decay=1.0, least=0.0).collect()
    assert {(r.file_path, r.hops) for r in rows} == {(f"f{i}", i) for i in range(1, 33)}
    ring = spark.range(12).select(F.concat(F.lit("f"), "id").alias("importer_file"), F.concat(F.lit("f"), (F.col("id") + 1) % 12).alias("imported_file"), F.lit(1.0).alias("confidence"))
    assert {(r.component, r["n"]) for r in graph.components(ring).groupBy("component").agg(F.count("*").alias("n")).collect()} == {("f0", 12)}


# --- locks in event time -------------------------------------------------------------------------------------------


def lock_answers(requests, until):
    """What becomes of requests by one pass in order of time, and of locks when the watermark ends at ``until``."""
    out = []
    for path in sorted({r[0] for r in requests}):
        agent = end = None
        for _, who, action, ttl, at in sorted((r for r in requests if r[0] == path and r[4] <= until), key=lambda r: (r[4], r[1], r[2])):
            if agent and end < at:
                out.append((path, end + 1, agent, "expired"))
                agent = None
            if action == "release":
                out.append((path, at, who, "released" if agent == who else "not_held"))
                agent = None if agent == who else agent
            elif agent in (None, who):
                agent, end = who, at + ttl
                out.append((path, at, who, "acquired"))
            else:
                out.append((path, at, who, "held"))
        if agent and end < until:
            out.append((path, end + 1, agent, "expired"))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 6])
def test_locks_expire_by_timers(spark, tmp_path, files):
    """One batch or six, rows out of order within the delay: the answers are those of event time."""
    import random

    rng = random.Random(5)
    rows = [(f"f{rng.randrange(4)}", f"a{rng.randrange(3)}", rng.choice(["acquire", "acquire", "release"]), rng.choice([0, 500, 2000, 9000]), 1_000_000 + 700 * i + rng.randrange(3000)) for i in range(60)]
    rows += [rows[3], rows[40]]  # repeated requests are answered one by one
    edge = max(r[4] for r in rows) + 60_000
    rows += [("edge", "a0", "acquire", 100, edge - 101), ("due", "a0", "acquire", 10**9, edge), ("later", "a0", "acquire", 1, edge + 1), ("on", "a0", "acquire", 100, edge - 100), ("end", "a9", "acquire", 1, edge + 10_000)]
    rows.sort(key=lambda r: r[4] // 5000)
    schema = "file_path string, agent_id string, action string, ttl_ms bigint, at_ms bigint"
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        os.utime(tmp_path / f"in/{i}", (i, i))
    stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    extra = spark.createDataFrame([(None, "a", "acquire", 1, None), ("x", None, "acquire", 1, None)], "file_path string, agent_id string, action string, ttl_ms bigint, at timestamp")
    extra.coalesce(1).write.parquet(str(tmp_path / "in/0/more"))
    with streams.timers(spark):
        written = streams.written(streams.locks(stream), str(tmp_path / "out"))
    found = sorted(tuple(r) for r in written.collect())
    expected = lock_answers(rows, edge)
    assert found == expected
    assert ("edge", edge, "a0", "expired") in found and not any(r[0] == "on" and r[3] == "expired" for r in found) and ("due", edge, "a0", "acquired") in found and not any(r[0] == "later" for r in found)
    assert {r[3] for r in found} == {"acquired", "held", "released", "not_held", "expired"}


# --- the working tree ----------------------------------------------------------------------------------------------


def test_disk_index_is_made_once(spark, repo, tmp_path):
    """Two queries on one state of tables and tree open the sources once; an edit, a new file and an update each make it anew."""
    p = Project(spark, repo.root, str(tmp_path / "store"))
    p.analyze()
    write(repo.root, "tests/test_app.py", "from app import f2\n\ndef test_one():\n    f2()\n")
    tests = lambda q=p: {r["test_id"] for r in q.suggest_tests("app.py", working_tree=True) if r["source"] != "fallback"}
    assert tests() == {"tests/test_app.py:test_one"} and p.disk_index.built == 1
    assert p.test_gaps(working_tree=True) and p.diff_impact(working_tree=True) and tests() and p.disk_index.built == 1
    other = Project(spark, repo.root, str(tmp_path / "store"))
    assert tests(other) == {"tests/test_app.py:test_one"} and other.disk_index.built == 0
    write(repo.root, "tests/test_app.py", "from app import f2\n\ndef test_two():\n    assert f2()\n")
    assert tests() == {"tests/test_app.py:test_two"} and p.disk_index.built == 2
    write(repo.root, "lib/new.py", "def fresh():\n    return 1\n")
    assert "lib/new.py" in {g["file_path"] for g in p.test_gaps(working_tree=True)} and p.disk_index.built == 3
    p.update()
    assert not any(g["working_tree"] for g in p.test_gaps(working_tree=True) if g["file_path"] == "app.py") and p.disk_index.built == 4
    assert p.optimize_storage()["freed_bytes"]["disk_index"] > 0 and p.disk_index._names(p.disk_index.folder) == []


def test_diffs_of_many_files(spark, repo, tmp_path):
    """Git names and compares files in tasks: names with blanks, brackets and other letters are themselves, not patterns."""
    body = "def one():\n    return 1\n\n\n\n\n\ndef two():\n    a = 1\n    b = 2\n    return a + b\n"
    names = ["plain.py", "odd name é.py", "a[1].py", "a1.py", 'q"uote.py']
    for n in names:
        repo.commit(n, body)
    for n in names[:3]:
        write(repo.root, n, body.replace("b = 2", "b = 3"))
    write(repo.root, names[4], "x = 0\n" + body)
    write(repo.root, "new é.py", "x = 1\n")
    changed = git.changed_files(spark, repo.root)
    assert sorted(r.file_path for r in changed.collect()) == sorted([*names[:3], names[4]])
    assert {r.file_path: r.functions for r in git.changed_functions(changed, repo.root).collect()} == {**dict.fromkeys(names[:3], ["two"]), names[4]: None}
    assert [r.file_path for r in git.untracked_files(spark, repo.root).collect()] == ["new é.py"]
    assert git.changed_functions(changed.limit(0), repo.root).count() == 0


# --- own extractors ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("packed", [False, True])
def test_bootstrap_reaches_the_workers(spark, tmp_path, monkeypatch, packed):
    """The module lies where only the driver looks; workers import it all the same, with what lies beside it in a package."""
    import sys

    from ripplemark.functions import bootstrap, extract

    name = "boot_pack" if packed else "boot_file"
    text = "from ripplemark.functions import extract\n{}\ndef units(path, content):\n    return [(word(), 'word', 1, 1)]\n\nextract.register_unit_extractor('ruby', units)\n"
    if packed:
        write(tmp_path, "boot_pack/__init__.py", text.format("from boot_pack.words import word\n"))
        write(tmp_path, "boot_pack/words.py", "def word():\n    return 'inside'\n")
    else:
        write(tmp_path, "boot_file.py", text.format("def word():\n    return 'alone'\n"))
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    monkeypatch.delenv("RIPPLEMARK_BOOTSTRAP", raising=False)
    files = spark.createDataFrame([(f"{i}.rb", "x") for i in range(20)], "file_path string, content string")
    assert not bootstrap.load_bootstrap(spark)
    monkeypatch.setenv("RIPPLEMARK_BOOTSTRAP", name)
    try:
        __import__(name)
        with pytest.raises(Exception, match=f"No module named '{name}'"):
            extract.code_units(files).collect()
        assert bootstrap.load_bootstrap(spark)
        assert {r.name for r in extract.code_units(files).collect()} == {"inside" if packed else "alone"}
    finally:
        extract.unregister_unit_extractor("ruby")
    monkeypatch.setenv("RIPPLEMARK_BOOTSTRAP", "no_such_module")
    with pytest.raises(ModuleNotFoundError):
        bootstrap.load_bootstrap(spark)
