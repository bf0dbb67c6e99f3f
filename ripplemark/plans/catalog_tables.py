"""Registered queries of the lookups, batch joins, keyed tables, edge building, shards and the working tree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import scalars as X
from ripplemark.operators import control, coverage, graph, history, impact, lookups, risk, shards, store, worktree
from ripplemark.plans.catalog import COUPLING, COVERAGE, COVERING, HHI, INSTABILITY, MIN_COUNT, TARGET, UNDIRECTED, Views, _coupled, _instability, _pairs, query, table
from ripplemark.plans.views import AS_OF, BRANCH_SINCE, code_file, test_file
from ripplemark.schemas import KEYS
from ripplemark.session import shared_dir

SET = "src/d3/"
IN_SET = f"LIKE '{SET}%'"


def _some(v: Views) -> DataFrame:
    """The files that batch lookups are asked for."""
    return v.files.where(F.col("file_path").startswith(SET))


def _sf(name: str, sql: str):
    """Registers ``f(views)`` under a name."""

    def keep(f):
        def run(spark, sf_dir):
            return f(Views(spark, sf_dir))

        run.__name__ = name
        return query(sql)(run)

    return keep


# --- point lookups -----------------------------------------------------------------------------------------------

_sf("unit_by_id", "SELECT id, file_path, name FROM code_units WHERE id = '7'")(lambda v: lookups.matching(v.code_units, id="7").select("id", "file_path", "name"))
_sf("units_of_file", f"SELECT id, name, line_end FROM code_units WHERE file_path = '{TARGET}'")(lambda v: lookups.matching(v.code_units, file_path=TARGET).select("id", "name", "line_end"))
_sf("units_by_stem", "SELECT id, file_path FROM code_units WHERE (file_path ILIKE '%/F7.%' OR file_path ILIKE 'F7.%') AND file_path NOT ILIKE '%.test.%' AND file_path NOT ILIKE '%.spec.%'")(lambda v: lookups.units_by_stem(v.code_units, "F7").select("id", "file_path"))
_sf("test_by_id", "SELECT id, file_path, name, framework FROM test_units WHERE id = '7'")(lambda v: lookups.matching(v.test_units, id="7"))
_sf("tests_of_file", f"SELECT id, name FROM test_units WHERE file_path = {test_file('3')}")(lambda v: v.test_units.where(F.col("file_path") == F.expr(test_file("3"))).select("id", "name"))
_sf("edges_of_test", "SELECT code_id, edge_type, weight FROM test_edges WHERE test_id = '7'")(lambda v: lookups.matching(v.test_edges, test_id="7").drop("test_id"))
_sf("edges_of_unit", "SELECT test_id, edge_type, weight FROM test_edges WHERE code_id = '7'")(lambda v: lookups.matching(v.test_edges, code_id="7").drop("code_id"))
_sf("commit_by_hash", "SELECT hash, author, message FROM commits WHERE hash = 7")(lambda v: lookups.matching(v.commits, hash=7).select("hash", "author", "message"))
_sf("branch_partners", f"WITH q AS ({_pairs('branch_commits', 1)}) SELECT file_a AS file_path, file_b AS partner, co_commit_count FROM q WHERE file_a = '{TARGET}' UNION ALL SELECT file_b, file_a, co_commit_count FROM q WHERE file_b = '{TARGET}'")(
    lambda v: history.partners(history.co_changes(v.branch_commits, v.commit_files, 1), v.files.where(F.col("file_path") == TARGET), 1).drop("last_co_commit")
)
_sf("importers", "SELECT DISTINCT imported_file AS file_path, importer_file FROM import_edges WHERE confidence >= 5e-1 AND imported_file IN (SELECT file_path FROM files)")(lambda v: lookups.importers(v.import_edges, v.files, 0.5))
_sf("imported_files", f"SELECT importer_file AS file_path, imported_file, max(confidence) AS confidence FROM import_edges WHERE importer_file = '{TARGET}' GROUP BY 1, 2")(lambda v: lookups.imports(v.import_edges, v.files.where(F.col("file_path") == TARGET), 0.0))
_CHURN_ROWS = "SELECT file_path, unit_name, count(*) AS commit_count, CAST(sum(insertions) AS BIGINT) AS total_insertions FROM unit_commits GROUP BY 1, 2"


def _unit_churn(v: Views) -> DataFrame:
    return history.churn(v.commits, v.unit_commits, AS_OF, ("file_path", "unit_name"))


_sf("unit_churn", f"""SELECT file_path, unit_name, count(*) AS commit_count, count(DISTINCT author) AS distinct_authors, CAST(sum(insertions) AS BIGINT) AS total_insertions, CAST(sum(deletions) AS BIGINT) AS total_deletions,
 round(sum(1e0 / (1e0 + greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(date)) / 8.64e10, 0e0))), 6) AS churn_score FROM unit_commits JOIN commits ON commit_hash = hash GROUP BY 1, 2""")(lambda v: _unit_churn(v).drop("last_changed"))  # fmt: skip
_sf("churn_row", f"SELECT * FROM ({_CHURN_ROWS}) WHERE file_path = '{TARGET}' AND unit_name = 'u1'")(lambda v: lookups.matching(_unit_churn(v), file_path=TARGET, unit_name="u1").select("file_path", "unit_name", "commit_count", "total_insertions"))
_sf("static_rows_of_target", f"SELECT test_file_path, test_unit_name, score FROM static_imports WHERE target_file_path = '{TARGET}'")(lambda v: lookups.matching(v.static_imports, target_file_path=TARGET).select("test_file_path", "test_unit_name", "score"))
_VERSIONS = "SELECT file_path, author, line_start, line_end, concat('h', CAST(line_end % 3 AS STRING)) AS content_hash FROM blame"


def _versions(v: Views) -> DataFrame:
    return v.blame.select("file_path", "author", "line_start", "line_end", F.concat(F.lit("h"), (F.col("line_end") % 3).cast("string")).alias("content_hash"))


_sf("blame_of_version", f"SELECT author, line_end FROM ({_VERSIONS}) WHERE file_path = '{TARGET}' AND content_hash = 'h1'")(lambda v: lookups.matching(_versions(v), file_path=TARGET, content_hash="h1").orderBy("line_start", "line_end").select("author", "line_end"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def hashes_batch(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select("doc_id", X.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return lookups.of_keys(now, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")))


# --- batch joins -------------------------------------------------------------------------------------------------

_BOTH_WAYS = "SELECT file_a AS file_path, file_b AS partner, co_commit_count FROM {0} UNION ALL SELECT file_b, file_a, co_commit_count FROM {0}"
_sf("partners_batch", f"WITH p AS ({_pairs('commits', MIN_COUNT)}) SELECT * FROM ({_BOTH_WAYS.format('p')}) WHERE file_path {IN_SET}")(lambda v: history.partners(history.co_changes(v.commits, v.commit_files, MIN_COUNT).drop("last_co_commit"), _some(v), MIN_COUNT))
_sf("branch_partners_batch", f"WITH q AS ({_pairs('branch_commits', 1)}) SELECT * FROM ({_BOTH_WAYS.format('q')}) WHERE file_path {IN_SET}")(lambda v: history.partners(history.co_changes(v.branch_commits, v.commit_files, 1).drop("last_co_commit"), _some(v), 1))
_sf("co_changes_with_branch", f"SELECT p.file_a, p.file_b, p.co_commit_count, coalesce(q.co_commit_count, 0) AS branch_count FROM ({_pairs('commits', 1)}) p LEFT JOIN ({_pairs('branch_commits', 1)}) q ON p.file_a = q.file_a AND p.file_b = q.file_b")(
    lambda v: history.co_changes_with_branch(v.commits, v.commit_files, F.col("date") >= F.lit(BRANCH_SINCE).cast("timestamp_ntz")).drop("last_co_commit")
)
_sf("imports_batch", f"SELECT importer_file AS file_path, imported_file, max(confidence) AS confidence FROM import_edges WHERE importer_file {IN_SET} AND confidence >= 1 GROUP BY 1, 2")(lambda v: lookups.imports(v.import_edges, _some(v)))
_sf("imports_with_confidence", f"SELECT importer_file AS file_path, imported_file, max(confidence) AS confidence FROM import_edges WHERE importer_file {IN_SET} GROUP BY 1, 2")(lambda v: lookups.imports(v.import_edges, _some(v), 0.0))
_sf("edges_of_units_batch", f"SELECT test_id, code_id, edge_type FROM test_edges WHERE code_id IN (SELECT id FROM code_units WHERE file_path {IN_SET})")(lambda v: lookups.of_keys(v.test_edges, lookups.of_keys(v.code_units, _some(v)).select(F.col("id").alias("code_id"))).drop("weight"))
_sf("units_of_files_batch", f"SELECT id, file_path FROM code_units WHERE file_path {IN_SET}")(lambda v: lookups.of_keys(v.code_units, _some(v)).select("id", "file_path"))
_sf("churn_of_files_batch", f"SELECT * FROM ({_CHURN_ROWS}) WHERE file_path {IN_SET}")(lambda v: lookups.of_keys(_unit_churn(v), _some(v)).select("file_path", "unit_name", "commit_count", "total_insertions"))
_sf("blame_batch", f"SELECT file_path, content_hash, author, line_end FROM ({_VERSIONS}) WHERE file_path {IN_SET} AND content_hash = CASE WHEN length(file_path) % 2 = 0 THEN 'h1' ELSE 'h2' END")(
    lambda v: lookups.of_keys(_versions(v), _some(v).select("file_path", F.when(F.length("file_path") % 2 == 0, "h1").otherwise("h2").alias("content_hash"))).select("file_path", "content_hash", "author", "line_end")
)
_sf("best_neighbors", f"SELECT a AS file_path, b AS neighbor, confidence FROM ({UNDIRECTED}) WHERE a = '{TARGET}'")(lambda v: graph.neighbors(v.import_edges).where(F.col("file_path") == TARGET))
_sf("top_partners", f"""WITH p AS ({_pairs('commits', MIN_COUNT)}), b AS ({_BOTH_WAYS.format('p')}), r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY co_commit_count DESC, partner) AS k FROM b) SELECT file_path, partner, co_commit_count FROM r WHERE k <= 3""")(
    lambda v: history.top_partners(history.co_changes(v.commits, v.commit_files, MIN_COUNT), 3).drop("last_co_commit", "k")
)
_sf("names_by_file", "SELECT file_path, string_agg(name, ',' ORDER BY name) AS names FROM test_units GROUP BY 1")(lambda v: lookups.names_by_file(v.test_units).select("file_path", F.array_join("names", ",").alias("names")))
_sf("missing_files", f"SELECT DISTINCT imported_file AS file_path FROM import_edges WHERE imported_file NOT IN (SELECT file_path FROM files WHERE file_path {IN_SET})")(lambda v: lookups.missing(v.import_edges.select(F.col("imported_file").alias("file_path")), _some(v)))
_sf("changed_or_untracked", f"SELECT file_path FROM files WHERE file_path {IN_SET} UNION SELECT file_path FROM test_units")(lambda v: _some(v).union(v.test_units.select("file_path")).distinct())
_sf("files_in_both", "SELECT file_path FROM commit_files INTERSECT SELECT importer_file FROM import_edges")(lambda v: v.commit_files.select("file_path").intersect(v.import_edges.select("importer_file")))
_sf("last_email_of_author", "SELECT file_path, author, max_by(author_email, line_end) AS author_email FROM blame GROUP BY 1, 2")(lambda v: history.ownership(v.blame).select("file_path", "author", "author_email"))


# --- keyed tables ------------------------------------------------------------------------------------------------

#: For each table the view with its rows, its key there, and a value with what an upsert makes of it.
UPSERTS: dict[str, tuple[str, dict[str, str], str, str]] = {
    "code_units": ("code_units", {"id": "id"}, "name", "concat('new ', name)"),
    "test_units": ("test_units", {"id": "id"}, "name", "concat('new ', name)"),
    "test_edges": ("test_edges", {"test_id": "test_id", "code_id": "code_id", "edge_type": "edge_type"}, "weight", "weight + 1e0"),
    "commits": ("commits", {"hash": "CAST(hash AS STRING)"}, "message", "concat('new ', message)"),
    "commit_files": ("commit_files", {"commit_hash": "CAST(commit_hash AS STRING)", "file_path": "file_path"}, "insertions", "insertions + 1000"),
    "blame_cache": ("(SELECT file_path, line_end AS line_start, min(author) AS author FROM blame GROUP BY 1, 2)", {"file_path": "file_path", "line_start": "line_start"}, "author", "concat('new ', author)"),
    "churn_stats": ("(SELECT file_path, unit_name, count(*) AS n FROM unit_commits GROUP BY 1, 2)", {"file_path": "file_path", "unit_name": "CASE WHEN unit_name = 'u0' THEN '' ELSE unit_name END"}, "n", "n + 1000"),
    "static_test_imports": ("static_imports", {"test_file_path": "test_file_path", "test_unit_name": "test_unit_name", "target_file_path": "target_file_path"}, "score", "score + 1e0"),
    "file_hashes": ("(SELECT CAST(doc_id AS STRING) AS file_path, lang AS content_hash FROM documents)", {"file_path": "file_path"}, "content_hash", "concat('new ', content_hash)"),
}


def _upserts(name: str, view: str, key: dict[str, str], value: str, new: str) -> None:
    names = ", ".join(f"{e} AS {c}" for c, e in key.items())
    base = f"SELECT {names}, {value} AS v, {new} AS n, md5(concat_ws('|', {', '.join(f'CAST({e} AS STRING)' for e in key.values())})) AS m FROM {view}"
    keys = ", ".join(key)

    def run(v: Views) -> DataFrame:
        rows = v.sql(base)
        old, fresh = rows.where("m < '9'").selectExpr(*key, "v"), rows.where("m >= '5' AND m < 'd'").selectExpr(*key, "n AS v")
        if name == "churn_stats":  # file-level rows come without a unit
            fresh = history.file_level(fresh.withColumn("unit_name", F.nullif("unit_name", F.lit(""))))
        return store.upserted(old, fresh, KEYS[name])

    _sf(f"upsert_{name}", f"SELECT {keys}, CASE WHEN m >= '5' THEN n ELSE v END AS v FROM ({base}) WHERE m < 'd'")(run)


for _name, _spec in UPSERTS.items():
    _upserts(_name, *_spec)

for _name, _commits, _least in (("co_changes", "commits", MIN_COUNT), ("branch_co_changes", "branch_commits", 1)):

    def _turned(v: Views, commits: str = _commits, least: int = _least, name: str = _name) -> DataFrame:
        """New rows come with their files in the other order."""
        rows = history.co_changes(getattr(v, commits), v.commit_files, least).select("file_a", "file_b", "co_commit_count")
        new = history.canonical(rows.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), (F.col("co_commit_count") + 1000).alias("co_commit_count")).where("file_a >= 'src/d3'"))
        return store.upserted(rows, new, KEYS[name])

    _sf(f"upsert_{_name}", f"SELECT file_a, file_b, CASE WHEN file_b >= 'src/d3' THEN co_commit_count + 1000 ELSE co_commit_count END AS co_commit_count FROM ({_pairs(_commits, _least)})")(_turned)

_sf("upsert_import_edges", "SELECT importer_file, imported_file, max(confidence) AS confidence FROM (SELECT importer_file, imported_file, confidence FROM import_edges UNION ALL SELECT imported_file, importer_file, 5e-1 FROM import_edges) GROUP BY 1, 2")(
    lambda v: store.upserted_max(v.import_edges, v.import_edges.select(F.col("imported_file").alias("importer_file"), F.col("importer_file").alias("imported_file"), F.lit(0.5).alias("confidence")), KEYS["import_edges"], "confidence")
)

#: Deletions: the table, the column, and SQL for the keys that go.
DELETES = {
    "code_units_by_file": ("code_units", "file_path", f"SELECT file_path FROM files WHERE file_path {IN_SET}", "id, file_path"),
    "test_units_by_file": ("test_units", "file_path", f"SELECT {test_file('n_nationkey')} AS file_path FROM nation WHERE n_regionkey = 1", "id, file_path"),
    "test_edges_by_test": ("test_edges", "test_id", "SELECT CAST(c_custkey AS STRING) AS test_id FROM customer WHERE c_acctbal < 0", "test_id, code_id, edge_type"),
    "import_edges_of_importers": ("import_edges", "importer_file", f"SELECT file_path AS importer_file FROM files WHERE file_path {IN_SET}", "importer_file, imported_file"),
    "blame_of_files": ("blame", "file_path", f"SELECT file_path FROM files WHERE file_path {IN_SET}", "file_path, author, line_end"),
}
for _name, (_view, _column, _keys, _shown) in DELETES.items():
    _sf(f"delete_{_name}", f"SELECT {_shown} FROM {_view} WHERE {_column} NOT IN ({_keys})")(lambda v, view=_view, keys=_keys, shown=_shown: store.deleted(getattr(v, view), v.sql(keys)).select(*shown.split(", ")))


@query("""SELECT 'code_units' AS table_name, (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM part WHERE p_size > 25) AS changed UNION ALL SELECT 'test_results', (SELECT 2 * count(*) FROM events), (SELECT 2 * count(*) FROM events WHERE event_type = 'error')
 UNION ALL SELECT 'import_edges', 0, 0 UNION ALL SELECT 'meta', 2, 7""")  # fmt: skip
def store_lifecycle(spark, sf_dir):
    """Tables in a store: written, upserted, appended to, compacted and emptied; then counted with what has changed."""
    v, s = Views(spark, sf_dir), store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    s.write("code_units", v.code_units)
    s.upsert("code_units", v.code_units.where("line_end > 25").withColumn("unit_type", F.lit("changed")))
    for _ in range(2):
        s.append("test_results", v.test_results)
    s.write("import_edges", v.import_edges)
    s.write("import_edges", v.import_edges.limit(0))
    s.set_meta(co_change_query_min=5, other="x")
    s.set_meta(co_change_query_min=7)
    s.compact()
    units, found, meta = s.read("code_units"), s.read("test_results"), s.read("meta")
    row = lambda name, df, n: df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), n.cast("bigint").alias("changed"))
    out = row("code_units", units, F.count_if(F.col("unit_type") == "changed")).unionByName(row("test_results", found, F.count_if(~F.col("passed"))))
    out = out.unionByName(row("import_edges", s.read("import_edges"), F.lit(0)))
    return out.unionByName(meta.agg(F.lit("meta").alias("table_name"), F.count("*").alias("n")).crossJoin(lookups.meta_number(meta, "co_change_query_min", 3).select(F.col("co_change_query_min").cast("bigint").alias("changed"))))


@query("SELECT l_orderkey AS commit_hash, l_suppkey AS file_path, CAST(l_quantity AS BIGINT) AS insertions, CAST(l_linenumber AS BIGINT) AS deletions FROM lineitem")
def flattened_commits(spark, sf_dir):
    """Commits with an array of files, taken apart again."""
    rows = table(spark, sf_dir, "lineitem")
    one = F.struct(F.col("l_suppkey").alias("path"), F.col("l_quantity").cast("bigint").alias("insertions"), F.col("l_linenumber").cast("bigint").alias("deletions"))
    nested = rows.groupBy(F.col("l_orderkey").alias("hash")).agg(F.collect_list(one).alias("files"))
    return history.flatten_commits(nested)[1]


@query(f"SELECT file_path, agent_id FROM (SELECT CAST(user_id AS STRING) AS file_path, event_type AS agent_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND t + 86400 >= epoch(TIMESTAMP '2024-01-29 12:00:00')")
def active_locks(spark, sf_dir):
    """The latest event of each user as a lock of a day."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = store.last_of_each(rows, ["user_id"], ["ts", "event_id"])
    locks = rows.select(F.col("user_id").cast("string").alias("file_path"), F.col("event_type").alias("agent_id"), F.col("t").alias("acquired_at"), (F.col("t") + 86400).alias("expires_at"))
    return lookups.active_locks(locks, 1706529600.0).select("file_path", "agent_id")


@query(f"SELECT f.file_path, l.agent AS locked_by FROM files f LEFT JOIN (SELECT {code_file('s_suppkey')} AS file_path, concat('agent', CAST(s_nationkey AS STRING)) AS agent FROM supplier WHERE s_acctbal >= 0) l USING (file_path)")
def locks_on_files(spark, sf_dir):
    v = Views(spark, sf_dir)
    locks = table(spark, sf_dir, "supplier").select(F.expr(code_file("s_suppkey")).alias("file_path"), F.concat(F.lit("agent"), F.col("s_nationkey").cast("string")).alias("agent_id"), F.col("s_acctbal").alias("expires_at"))
    return impact.annotated_with_locks(v.files, locks, 0.0).select("file_path", "locked_by")


_LOCK_BATCH = """WITH e AS (SELECT CAST(user_id AS STRING) AS file_path, event_type AS agent_id, event_id, epoch(ts) AS t FROM events), moment AS (SELECT max(t) - 86400 AS now FROM e),
 held AS (SELECT file_path, agent_id AS holder, t AS since, t + 86400 AS until FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY t DESC, event_id DESC) AS k FROM e) WHERE k = 1 AND t + 86400 >= (SELECT now FROM moment)),
 asked AS (SELECT file_path, agent_id, CASE event_id % 3 WHEN 0 THEN 'acquire' WHEN 1 THEN 'refresh' ELSE 'release' END AS action, max(event_id % 100) AS ttl FROM e GROUP BY 1, 2, 3),
 j AS (SELECT * FROM asked LEFT JOIN held USING (file_path)), f AS (SELECT file_path, bool_or(action = 'release' AND coalesce(agent_id = holder, false)) AS freed, min(CASE WHEN action = 'acquire' THEN agent_id END) AS first FROM j GROUP BY 1),
 o AS (SELECT *, CASE WHEN holder IS NOT NULL AND NOT freed THEN holder ELSE first END AS owner FROM j JOIN f USING (file_path)),
 a AS (SELECT *, CASE action WHEN 'acquire' THEN CASE WHEN agent_id = owner THEN 'acquired' ELSE 'held' END WHEN 'release' THEN CASE WHEN agent_id = holder THEN 'released' ELSE 'not_held' END ELSE CASE WHEN agent_id = holder AND NOT freed THEN 'refreshed' ELSE 'not_held' END END AS status FROM o)"""


def _lock_batch(spark, sf_dir):
    """A table of locks, every user's latest event being one of a day, and every event as a request of a day before the last event."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = rows.select(F.col("user_id").cast("string").alias("file_path"), F.col("event_type").alias("agent_id"), "event_id", "t", F.lit(None).cast("string").alias("purpose"))
    now = rows.agg(F.max("t")).first()[0] - 86400
    locks = control.Locks(store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), lambda: now)
    latest = store.last_of_each(rows, ["file_path"], ["t", "event_id"])
    locks.store.write("file_locks", latest.select("file_path", "agent_id", F.col("t").alias("acquired_at"), (F.col("t") + 86400).alias("expires_at"), "purpose"))
    action = F.element_at(F.array(F.lit("acquire"), F.lit("refresh"), F.lit("release")), (F.col("event_id") % 3 + 1).cast("int"))
    return locks, locks.request(rows.select("file_path", "agent_id", action.alias("action"), (F.col("event_id") % 100).alias("ttl"), "purpose"))


@query(f"{_LOCK_BATCH} SELECT file_path, agent_id, action, status, owner FROM a")
def lock_requests(spark, sf_dir):
    return _lock_batch(spark, sf_dir)[1].select("file_path", "agent_id", "action", "status", "owner")


@query(f"""{_LOCK_BATCH}, g AS (SELECT file_path, agent_id, max(CASE WHEN agent_id = holder AND NOT freed THEN since ELSE now END) AS acquired_at, max(ttl) + max(now) AS expires_at FROM a, moment WHERE status IN ('acquired', 'refreshed') GROUP BY 1, 2)
 SELECT file_path, agent_id, round(acquired_at, 3) AS acquired_at, round(expires_at, 3) AS expires_at FROM (SELECT * FROM g UNION ALL SELECT file_path, holder, since, until FROM held WHERE file_path NOT IN (SELECT file_path FROM a WHERE status IN ('acquired', 'refreshed', 'released')))""")
def locks_after_requests(spark, sf_dir):
    rows = _lock_batch(spark, sf_dir)[0].store.read("file_locks")
    return rows.select("file_path", "agent_id", F.round("acquired_at", 3).alias("acquired_at"), F.round("expires_at", 3).alias("expires_at"))


@query("SELECT CAST(event_id AS BIGINT) AS id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 50")
def latest_job_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("job_id"), "event_type")
    return lookups.latest_events(rows, "7").select("id", "event_type")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'running' END AS status FROM customer")
def swept_jobs(spark, sf_dir):
    """A customer's balance is the start of a job in seconds from half an hour ago."""
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("running").alias("status"), (F.col("c_acctbal") + 100000 - control.STALE_JOB_SECONDS).alias("started_at"))
    return control.swept(jobs, 100000.0).select("id", "status")


# --- shards and the working tree ---------------------------------------------------------------------------------

_SHARDS = ["src", "src/d1", "src/d3", "lib"]
_SHARD = "CASE WHEN file_path LIKE 'src/d1/%' THEN 'src/d1' WHEN file_path LIKE 'src/d3/%' THEN 'src/d3' WHEN file_path LIKE 'src/%' THEN 'src' END"
_SHARDED = ("code_units", "test_units", "commit_files", "blame")
_BY_SHARD = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {_SHARD} AS shard, count(*) AS n FROM {t} GROUP BY 2" for t in _SHARDED)


def _shard_counts(v: Views) -> DataFrame:
    return shards.counts({t: getattr(v, t) for t in _SHARDED}, _SHARDS)


_sf("shard_counts", _BY_SHARD)(_shard_counts)
_sf("shard_totals", f"SELECT table_name, CAST(sum(n) AS BIGINT) AS n FROM ({_BY_SHARD}) GROUP BY 1")(lambda v: shards.totals(_shard_counts(v)))
_sf("shards_with_data", f"SELECT DISTINCT shard FROM ({_BY_SHARD}) WHERE shard IS NOT NULL")(lambda v: shards.with_data(_shard_counts(v)))
_sf("units_of_shard", "SELECT id, file_path FROM code_units WHERE file_path LIKE 'src/d3/%'")(lambda v: shards.of_shard(v.code_units, _SHARDS, "src/d3").select("id", "file_path"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'src,src/d1,src/d3' WHEN n_nationkey % 4 = 1 THEN 'src,src/d1' WHEN n_nationkey % 4 = 2 THEN 'lib' ELSE 'src,src/d1,src/d3,lib' END AS shards FROM nation")
def shards_under(spark, sf_dir):
    found = [",".join(shards.under(d, _SHARDS)) for d in ("src/", "src/d1/deep", "lib", "")]
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, found)), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("shards"))


_sf("disk_only_tests", "SELECT file_path, name FROM test_units WHERE file_path NOT IN (SELECT file_path FROM test_units WHERE file_path LIKE '%1.py')")(lambda v: worktree.disk_only_tests(v.test_units.select("file_path", "name"), v.test_units.where("file_path like '%1.py'")))
_sf("gaps_on_disk", f"SELECT id, file_path, name FROM code_units WHERE file_path {IN_SET} AND file_path NOT IN (SELECT file_path FROM code_units WHERE CAST(id AS BIGINT) % 10 = 3)")(
    lambda v: worktree.gaps_on_disk(v.code_units, _some(v), v.code_units.where("cast(id as bigint) % 10 = 3"), "src").select("id", "file_path", "name")
)
_STEM = r"regexp_replace({}, '^.*/|\.[^.]*$', '', 'g')"
_LAST = r"regexp_extract({}, '([^/]*)/[^/]*$', 1)"
_NAMES = f"""SELECT f.file_path AS source_file, t.file_path, t.name, t.framework, {_STEM.format('f.file_path')} AS a, {_STEM.format('t.file_path')} AS b, {_LAST.format('f.file_path')} AS x, {_LAST.format('t.file_path')} AS y FROM files f, test_units t WHERE f.file_path {IN_SET}"""
_sf("suggest_on_disk", f"""WITH n AS ({_NAMES}), r AS (SELECT *, CASE WHEN a = b THEN 1e0 WHEN contains(a, b) OR contains(b, a) THEN 5e-1 ELSE 1e-1 END AS base FROM n), d AS (SELECT DISTINCT file_path FROM test_units EXCEPT SELECT file_path FROM test_units WHERE file_path LIKE '%1.py')
 SELECT source_file, concat(file_path, ':', name) AS test_id, CASE WHEN x = y THEN least(1e0, base + 3e-1) ELSE base END AS relevance, CASE WHEN file_path IN (SELECT file_path FROM d) THEN 'working_tree' ELSE 'fallback' END AS source FROM r""")(
    lambda v: worktree.suggest_by_name(_some(v), lookups.of_keys(v.test_units, v.test_units.where("file_path like '%1.py'").select("file_path")), worktree.disk_only_tests(v.test_units, v.test_units.where("file_path like '%1.py'"))).select("source_file", "test_id", "relevance", "source")
)
_sf("name_matches", f"WITH n AS ({_NAMES.replace(f' WHERE f.file_path {IN_SET}', '')}) SELECT source_file, concat(file_path, ':', name) AS test_id, CASE WHEN x = y THEN least(1e0, CASE WHEN a = b THEN 1e0 ELSE 5e-1 END + 3e-1) ELSE CASE WHEN a = b THEN 1e0 ELSE 5e-1 END END AS relevance FROM n WHERE contains(a, b) OR contains(b, a)")(
    lambda v: impact.name_matches(v.files, v.test_units).select("source_file", "test_id", "relevance")
)


@query("""WITH d AS (SELECT user_id AS file_path, CASE WHEN event_type = 'view' THEN 'call' ELSE 'import' END AS dep_type, concat('m', CAST(CAST(floor(value) AS BIGINT) % 40 AS STRING)) AS module_path, event_id AS place FROM events),
 f AS (SELECT file_path, module_path, min(place) AS place FROM d WHERE dep_type = 'import' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY place) AS k FROM f)
 SELECT file_path, string_agg(module_path, ',' ORDER BY place) AS modules FROM r WHERE k <= 20 GROUP BY 1""")  # fmt: skip
def disk_neighbors(spark, sf_dir):
    deps = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_path"), F.when(F.col("event_type") == "view", "call").otherwise("import").alias("dep_type"), F.concat(F.lit("m"), (F.floor("value") % 40).cast("string")).alias("module_path"), F.col("event_id").alias("place"))
    return worktree.disk_neighbors(deps).select("file_path", F.array_join("modules", ",").alias("modules"))


# --- one file's risk ---------------------------------------------------------------------------------------------

_sf("risk_of_file", f"""{COUPLING}, cov AS (SELECT c.*, tested_units / CAST(units AS DOUBLE) AS coverage, coalesce(n, 0) AS covering_tests FROM ({COVERAGE}) c LEFT JOIN (SELECT file_path, count(*) AS n FROM ({COVERING}) GROUP BY 1) USING (file_path)),
 ch AS (SELECT file_path, sum(1e0 / (1e0 + greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(date)) / 8.64e10, 0e0))) AS s FROM commit_files JOIN commits ON commit_hash = hash GROUP BY 1),
 raw AS (SELECT ch.file_path, least(round(s, 6) / 5e0, 1e0) AS churn, coalesce(coupling, 0e0) AS coupling, coalesce(coverage, 0e0) AS cv, coalesce(covering_tests, 0) AS ct, coalesce(n_dynamic_import, 0) AS dyn, coalesce(author_concentration, 1e0) AS ac, coalesce(test_instability, 0e0) AS ti
  FROM ch LEFT JOIN coupled USING (file_path) LEFT JOIN cov USING (file_path) LEFT JOIN ({HHI}) USING (file_path) LEFT JOIN ({INSTABILITY}) USING (file_path) WHERE ch.file_path = '{TARGET}'),
 g AS (SELECT *, least(1e0, round_even((1 - cv) * 20, 0) / 20) AS gap, round(least(ct / 5e0, 1e0), 4) AS depth, least(dyn / 20e0, 1e0) * 15e-2 AS hidden FROM raw)
 SELECT file_path, gap AS coverage_gap, round(35e-2 * churn + 25e-2 * coupling + 15e-2 * gap + 1e-1 * depth + 1e-1 * ac + 5e-2 * ti + hidden + CASE WHEN churn = 0 AND cv = 0 THEN 5e-1 ELSE 0e0 END, 4) AS risk_score FROM g""")(
    lambda v: risk.components(history.churn(v.commits, v.commit_files, AS_OF), _coupled(v), coverage.file_coverage(v.code_units, v.test_edges, "unit"), history.author_concentration(v.blame), _instability(v)).where(F.col("file_path") == TARGET).select("file_path", "coverage_gap", "risk_score")
)
