"""The registered queries of the analytics operators and the SQL each can be held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions import scalars as X
from ripplemark.operators import coverage as C
from ripplemark.operators import graph as G
from ripplemark.operators import history as H
from ripplemark.operators import impact as I
from ripplemark.operators import results as R
from ripplemark.operators import risk as K
from ripplemark.operators import store as S
from ripplemark.operators.products import tasks
from ripplemark.plans.views import AS_OF, BRANCH_SINCE, WHOLE, code_file, of_all_lines, spark_sql, view, with_views
from ripplemark.session import cut, shared_dir
from ripplemark.streaming import streams as T

FLAGSHIP = "risk_map"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

MIN_COUNT = 3
TARGET = "src/d0/f7.py"
_AS_OF = f"TIMESTAMP '{AS_OF}'"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return keep


class Views:
    """The views of one folder as attributes.  ``kept`` ones are written once, with the named columns, and read from there by every part of a plan."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: dict[str, tuple[str, ...]] | None = None):
        self._of, self._kept = lambda name: view(spark, sf_dir, name), kept or {}
        self._spark, self._folder = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        """A query over the views and tables that its text names."""
        return spark_sql(self._spark, self._folder, text)

    def __getattr__(self, name: str) -> DataFrame:
        made = cut(self._of(name).select(*self._kept[name])) if name in self._kept else self._of(name)
        setattr(self, name, made)
        return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- churn, co-change, ownership ---------------------------------------------------------------------------------

CHURN = f"""SELECT file_path, count(*) AS commit_count, count(DISTINCT author) AS distinct_authors, CAST(sum(insertions) AS BIGINT) AS total_insertions,
 CAST(sum(deletions) AS BIGINT) AS total_deletions, round(sum(1e0 / (1e0 + greatest((epoch_us({_AS_OF}) - epoch_us(date)) / 8.64e10, 0e0))), 6) AS churn_score
 FROM commit_files JOIN commits ON commit_hash = hash GROUP BY file_path"""


def _churn(v: Views) -> DataFrame:
    return H.churn(v.commits, v.commit_files, AS_OF).drop("last_changed")


@query(CHURN)
def churn_file(spark, sf_dir):
    return _churn(Views(spark, sf_dir))


@query("SELECT file_path, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last_changed FROM commit_files JOIN commits ON commit_hash = hash GROUP BY file_path")
def churn_last_changed(spark, sf_dir):
    v = Views(spark, sf_dir)
    return H.churn(v.commits, v.commit_files, AS_OF).select("file_path", "last_changed")


@query(f"WITH c AS ({CHURN}), f AS (SELECT file_path FROM files UNION SELECT {code_file('(1000000 + r_regionkey)')} FROM region) SELECT f.file_path, coalesce(commit_count, 0) AS commit_count, coalesce(distinct_authors, 0) AS distinct_authors, coalesce(total_insertions, 0) AS total_insertions, coalesce(total_deletions, 0) AS total_deletions, coalesce(churn_score, 0e0) AS churn_score FROM f LEFT JOIN c USING (file_path)")
def churn_all_files_left(spark, sf_dir):
    v = Views(spark, sf_dir)
    more = table(spark, sf_dir, "region").select(F.expr(code_file("(1000000 + r_regionkey)")).alias("file_path"))
    return H.churn_all_files(v.files.union(more), _churn(v))


@query("SELECT file_path, author, CAST(sum(line_end - line_start + 1) AS BIGINT) AS line_count, round(100 * sum(line_end - line_start + 1) / sum(sum(line_end - line_start + 1)) OVER (PARTITION BY file_path), 2) AS percentage, concat(author, '@x') AS author_email FROM blame GROUP BY file_path, author")
def ownership(spark, sf_dir):
    return H.ownership(Views(spark, sf_dir).blame)


HHI = "SELECT file_path, round(sum(n * n) / (sum(n) * CAST(sum(n) AS DOUBLE)), 4) AS author_concentration FROM (SELECT file_path, author, CAST(sum(line_end - line_start + 1) AS BIGINT) AS n FROM blame GROUP BY 1, 2) GROUP BY 1"


@query(HHI)
def author_hhi(spark, sf_dir):
    return H.author_concentration(Views(spark, sf_dir).blame)


def _pairs(commits: str, least: int) -> str:
    return f"""SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS co_commit_count, max(a.date) AS last_ts
 FROM (SELECT commit_hash, file_path, date, count(*) OVER (PARTITION BY commit_hash) AS n FROM commit_files JOIN {commits} ON commit_hash = hash) a
 JOIN (SELECT commit_hash, file_path FROM commit_files) b ON a.commit_hash = b.commit_hash AND a.file_path < b.file_path WHERE n BETWEEN 2 AND 50 GROUP BY 1, 2 HAVING count(*) >= {least}"""


@query(f"SELECT file_a, file_b, co_commit_count, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_co_commit FROM ({_pairs('commits', MIN_COUNT)})")
def cochange_pairs(spark, sf_dir):
    v = Views(spark, sf_dir)
    return H.co_changes(v.commits, v.commit_files, MIN_COUNT)


@query(f"WITH p AS ({_pairs('commits', MIN_COUNT)}) SELECT file_a AS file_path, file_b AS partner, co_commit_count FROM p WHERE file_a = '{TARGET}' UNION ALL SELECT file_b, file_a, co_commit_count FROM p WHERE file_b = '{TARGET}'")
def cochange_partners(spark, sf_dir):
    v = Views(spark, sf_dir)
    target = v.files.where(F.col("file_path") == TARGET)
    return H.partners(H.co_changes(v.commits, v.commit_files, MIN_COUNT).drop("last_co_commit"), target, MIN_COUNT)


@query("SELECT CAST(o_orderkey AS BIGINT) AS n, CASE WHEN o_orderkey <= 0 THEN 2 ELSE greatest(2, CAST(floor(log2(o_orderkey) / 2) AS INT) + 1) END AS threshold FROM orders")
def coupling_threshold(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    return n.select("n", X.coupling_threshold(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("threshold"))


BOTH = "SELECT {a} AS file_path, {b} AS other FROM {t} UNION ALL SELECT {b}, {a} FROM {t}"
COUPLING = f"""WITH p AS ({_pairs('commits', MIN_COUNT)}), q AS ({_pairs('branch_commits', 1)}),
 cc AS (SELECT file_path, count(*) AS n FROM ({BOTH.format(a='file_a', b='file_b', t='p')}) GROUP BY 1), br AS (SELECT file_path, count(*) AS n FROM ({BOTH.format(a='file_a', b='file_b', t='q')}) GROUP BY 1),
 im AS (SELECT file_path, count(DISTINCT other) AS n FROM ({BOTH.format(a='importer_file', b='imported_file', t='import_edges')}) GROUP BY 1),
 u AS (SELECT f.file_path, coalesce(cc.n, 0) AS cochange_breadth, coalesce(br.n, 0) AS branch_breadth, coalesce(im.n, 0) AS import_breadth FROM files f LEFT JOIN cc USING (file_path) LEFT JOIN br USING (file_path) LEFT JOIN im USING (file_path)),
 w AS (SELECT *, least(greatest(cochange_breadth, branch_breadth) / 10e0, 1e0) AS cochange_norm, least(import_breadth / 8e0, 1e0) AS import_norm FROM u),
 coupled AS (SELECT *, greatest(cochange_norm, import_norm, 5e-1 * cochange_norm + 5e-1 * import_norm) AS coupling FROM w)"""


def _coupled(v: Views) -> DataFrame:
    counted = H.breadths(v.commits, v.commit_files, F.col("date") >= F.lit(BRANCH_SINCE).cast("timestamp_ntz"), MIN_COUNT)
    return K.coupling_of(v.files, counted, G.neighbors(v.import_edges))


@query(COUPLING + " SELECT * FROM coupled")
def coupling_score(spark, sf_dir):
    return _coupled(Views(spark, sf_dir, {"commit_files": RISK_VIEWS["commit_files"]}))


@query(f"""WITH r AS (SELECT file_path, author, count(*) AS recent_commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions,
 sum(1e0 / (1e0 + greatest((epoch_us({_AS_OF}) - epoch_us(date)) / 8.64e10, 0e0))) AS raw, max(date) AS last_ts FROM commit_files JOIN commits ON commit_hash = hash WHERE file_path = '{TARGET}' GROUP BY 1, 2)
 SELECT file_path, author, recent_commits, insertions, deletions, round(raw, 4) AS score, CAST(round((epoch_us({_AS_OF}) - epoch_us(last_ts)) / 8.64e10) AS BIGINT) AS days_since, round(100 * raw / sum(raw) OVER (PARTITION BY file_path), 2) AS percentage FROM r""")
def reviewers(spark, sf_dir):
    v = Views(spark, sf_dir)
    return H.reviewers(v.commits, v.commit_files.where(F.col("file_path") == TARGET), AS_OF)


@query(f"SELECT hash AS commit_hash, file_path, insertions, deletions, author, message, date FROM commit_files JOIN commits ON commit_hash = hash WHERE file_path = '{TARGET}'")
def history(spark, sf_dir):
    v = Views(spark, sf_dir)
    return H.history(v.commits, v.commit_files, v.files.where(F.col("file_path") == TARGET)).select("commit_hash", "file_path", "insertions", "deletions", "author", "message", "date")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM events)
 SELECT user_id, event_type, min(k) AS first_place, max(k) AS last_place, count(*) AS length FROM e GROUP BY user_id, event_type, k - j""")
def line_merge_islands(spark, sf_dir):
    return H.line_blocks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


# --- test results ------------------------------------------------------------------------------------------------

RATES = "SELECT test_id, count(*) AS total_runs, count(*) FILTER (WHERE NOT passed) AS failures, count(*) FILTER (WHERE NOT passed) / CAST(count(*) AS DOUBLE) AS failure_rate FROM test_results GROUP BY 1"
CV = """SELECT test_id, least(stddev_pop(duration_ms) / avg(duration_ms), 1e0) AS duration_cv FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY recorded_at DESC, event_id DESC) AS k FROM test_results WHERE duration_ms IS NOT NULL)
 WHERE k <= 20 GROUP BY 1 HAVING count(*) >= 3 AND avg(duration_ms) > 0"""


@query(RATES)
def failure_rates(spark, sf_dir):
    return R.failure_rates(Views(spark, sf_dir).test_results)


@query(f"SELECT test_id, round(duration_cv, 6) AS duration_cv FROM ({CV})")
def duration_cv(spark, sf_dir):
    return R.duration_cv(Views(spark, sf_dir).test_results, tie=["event_id"]).withColumn("duration_cv", F.round("duration_cv", 6))


COVERING = "SELECT DISTINCT file_path, test_id FROM code_units JOIN test_edges ON id = code_id"
INSTABILITY = f"""SELECT file_path, CASE WHEN f IS NOT NULL AND c IS NOT NULL THEN least(1e0, 65e-2 * f + 35e-2 * c) WHEN f IS NOT NULL THEN f WHEN c IS NOT NULL THEN least(c, 1e0) ELSE 0e0 END AS test_instability
 FROM (SELECT file_path, avg(failure_rate) AS f, avg(duration_cv) AS c FROM ({COVERING}) LEFT JOIN ({RATES}) USING (test_id) LEFT JOIN ({CV}) USING (test_id) GROUP BY 1)"""


def _instability(v: Views) -> DataFrame:
    return R.instability(C.covering_tests(v.code_units, v.test_edges), R.failure_rates(v.test_results), R.duration_cv(v.test_results, tie=["event_id"]))


@query(f"SELECT file_path, round(test_instability, 6) AS test_instability FROM ({INSTABILITY})")
def instability(spark, sf_dir):
    return _instability(Views(spark, sf_dir)).withColumn("test_instability", F.round("test_instability", 6))


@query("SELECT event_id, test_id FROM test_results WHERE test_id IN (SELECT id FROM test_units WHERE framework <> 'BUILDING')")
def orphan_results_cleanup(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.without_orphans(v.test_results, v.test_units.where("framework <> 'BUILDING'"))[0].select("event_id", "test_id")


# --- coverage, gaps, stale ---------------------------------------------------------------------------------------


@query("SELECT edge_type, count(*) AS n FROM test_edges GROUP BY 1")
def edge_type_counts(spark, sf_dir):
    return C.edge_type_counts(Views(spark, sf_dir).test_edges)


_COUNTED = ("code_units", "test_units", "test_edges", "commits", "commit_files", "blame", "import_edges", "test_results", "static_imports")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_stats(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.table_counts({t: getattr(v, t) for t in _COUNTED})


@query("SELECT count(*) AS total_edges, count(*) FILTER (WHERE edge_type = 'call') AS call_edges, count(*) FILTER (WHERE edge_type = 'import') AS import_edges, count(*) FILTER (WHERE edge_type = 'dynamic_import') AS dynamic_import_edges, CAST(0 AS BIGINT) AS eval_import_edges, CAST(0 AS BIGINT) AS tainted_import_edges, round(count(*) FILTER (WHERE edge_type = 'dynamic_import') / CAST(count(*) AS DOUBLE), 4) AS unknown_shadow_ratio FROM test_edges")
def shadow_graph(spark, sf_dir):
    return C.shadow_graph(Views(spark, sf_dir).test_edges)


@query(f"SELECT t.id AS test_id, u.name AS unit_name, edge_type, weight AS score FROM code_units u JOIN test_edges ON u.id = code_id JOIN test_units t ON t.id = test_id WHERE u.file_path = '{TARGET}'")
def impacted_direct(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.direct_impact(v.code_units, v.test_edges, v.test_units, v.files.where(F.col("file_path") == TARGET)).select("test_id", "unit_name", "edge_type", "score")


GAPS = """SELECT id, u.file_path, u.name, unit_type, line_start, line_end, coalesce(c.churn_score, 0e0) AS churn_score, coalesce(c.commit_count, 0) AS commit_count FROM code_units u
 LEFT JOIN (SELECT CAST(l_partkey AS STRING) AS part, count(*) AS commit_count, round(sum(l_tax), 6) AS churn_score FROM lineitem GROUP BY 1) c ON c.part = u.id
 WHERE NOT EXISTS (SELECT 1 FROM test_edges e WHERE e.code_id = u.id) AND NOT EXISTS (SELECT 1 FROM test_units t WHERE t.file_path = u.file_path)"""


def _untested(spark, sf_dir, v: Views | None = None) -> DataFrame:
    v = v or Views(spark, sf_dir)
    units = v.code_units.withColumn("name", F.concat_ws("#", "name", "id"))
    ids = v.code_units.select("id", "file_path", F.col("name").alias("unit_name"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.count("*").alias("commit_count"), F.round(F.sum("l_tax"), 6).alias("churn_score"))
    churned = rows.join(ids, "id").select("file_path", F.concat_ws("#", "unit_name", "id").alias("unit_name"), "commit_count", "churn_score")
    return C.untested_units(units, v.test_edges, v.test_units, churned).withColumn("name", F.substring_index("name", "#", 1))


@query(GAPS)
def test_gaps(spark, sf_dir):
    return _untested(spark, sf_dir)


@query(f"SELECT * FROM ({GAPS}) ORDER BY churn_score DESC, id LIMIT 25")
def test_gaps_limited(spark, sf_dir):
    return _untested(spark, sf_dir).orderBy(F.desc("churn_score"), "id").limit(25)


@query(f"WITH g AS ({GAPS}), t AS (SELECT target_file_path AS file_path FROM static_imports EXCEPT SELECT file_path FROM code_units JOIN test_edges ON id = code_id), k AS (SELECT * FROM g WHERE file_path NOT IN (SELECT file_path FROM t)) SELECT id, file_path FROM k UNION ALL SELECT id, file_path FROM g WHERE NOT EXISTS (SELECT 1 FROM k)")
def test_gaps_static(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.test_gaps(_untested(spark, sf_dir), v.static_imports, C.files_with_edges(v.code_units, v.test_edges)).select("id", "file_path")


@query("SELECT DISTINCT file_path FROM code_units JOIN test_edges ON id = code_id")
def files_with_edges(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.files_with_edges(v.code_units, v.test_edges)


@query("SELECT test_id, code_id, edge_type FROM test_edges JOIN test_units t ON t.id = test_id WHERE code_id NOT IN (SELECT id FROM code_units WHERE CAST(id AS BIGINT) % 10 <> 3)")
def stale_tests(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.stale_edges(v.code_units.where("cast(id as bigint) % 10 <> 3"), v.test_edges, v.test_units).select("test_id", "code_id", "edge_type")


COVERAGE = """SELECT u.file_path, count(*) AS units, count(*) FILTER (WHERE e.code_id IS NOT NULL) AS tested_units, CAST(sum(lines) AS BIGINT) AS lines, CAST(coalesce(sum(lines) FILTER (WHERE e.code_id IS NOT NULL), 0) AS BIGINT) AS tested_lines,
 CAST(coalesce(sum(e.edges), 0) AS BIGINT) AS edges, CAST(coalesce(sum(n_call), 0) AS BIGINT) AS n_call, CAST(coalesce(sum(n_dyn), 0) AS BIGINT) AS n_dynamic_import
 FROM (SELECT *, line_end - line_start + 1 AS lines FROM code_units) u LEFT JOIN (SELECT code_id, count(*) AS edges, count(*) FILTER (WHERE edge_type = 'call') AS n_call, count(*) FILTER (WHERE edge_type = 'dynamic_import') AS n_dyn FROM test_edges GROUP BY 1) e ON e.code_id = u.id GROUP BY 1"""


@query(f"SELECT c.*, tested_lines / CAST(lines AS DOUBLE) AS coverage, coalesce(n, 0) AS covering_tests FROM ({COVERAGE}) c LEFT JOIN (SELECT file_path, count(*) AS n FROM ({COVERING}) GROUP BY 1) USING (file_path)")
def file_coverage(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.file_coverage(v.code_units, v.test_edges).select("file_path", "units", "tested_units", "lines", "tested_lines", "edges", "n_call", "n_dynamic_import", "coverage", "covering_tests")


@query("SELECT file_path FROM code_units UNION SELECT file_path FROM commit_files")
def resolvable_paths(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.resolvable_paths(v.code_units, v.commit_files)


# --- import graph ------------------------------------------------------------------------------------------------

UNDIRECTED = "SELECT a, b, max(confidence) AS confidence FROM (SELECT importer_file AS a, imported_file AS b, confidence FROM import_edges UNION ALL SELECT imported_file, importer_file, confidence FROM import_edges) GROUP BY 1, 2"


@query(f"SELECT a AS file_path, b AS neighbor, confidence FROM ({UNDIRECTED})")
def import_neighbors(spark, sf_dir):
    return G.neighbors(Views(spark, sf_dir).import_edges)


@query("SELECT importer_file, imported_file, max(confidence) AS confidence FROM import_edges WHERE importer_file <> imported_file GROUP BY 1, 2")
def import_edges_max_conf(spark, sf_dir):
    return G.merged_edges(Views(spark, sf_dir).import_edges)


SOURCES = "SELECT file_path FROM files WHERE file_path LIKE 'src/d3/%'"
#: Recursion by key keeps the best row of each file, so it ends without a bound on the depth.
HOPS = f"""near AS (SELECT a, b FROM ({UNDIRECTED}) WHERE confidence >= 1), {{name}}(file_path, hops) USING KEY (file_path) AS (SELECT DISTINCT file_path, 0 FROM ({{sources}}) UNION
 SELECT near.b, min({{name}}.hops + 1) FROM {{name}} JOIN near ON near.a = {{name}}.file_path LEFT JOIN recurring.{{name}} AS known ON known.file_path = near.b WHERE known.file_path IS NULL GROUP BY near.b)"""
CLOSURE = f"""und AS ({UNDIRECTED}), c(file_path, decay, step) USING KEY (file_path) AS (SELECT '{TARGET}', 1e0, 0 UNION SELECT und.b, max(c.decay * 88e-2 * und.confidence), any_value(c.step) + 1 FROM c JOIN und ON und.a = c.file_path
 LEFT JOIN recurring.c AS known ON known.file_path = und.b WHERE c.step < 32 AND c.decay >= 1e-2 AND (known.decay IS NULL OR c.decay * 88e-2 * und.confidence > known.decay) GROUP BY und.b),
 best AS (SELECT file_path, decay FROM c WHERE file_path <> '{TARGET}')"""


@query(f"WITH RECURSIVE {HOPS.format(name='h', sources=SOURCES)} SELECT * FROM h")
def bfs_hops(spark, sf_dir):
    v = Views(spark, sf_dir)
    return G.hops(v.import_edges, v.files.where("file_path like 'src/d3/%'"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT file_path, round(decay, 9) AS decay FROM best")
def import_closure(spark, sf_dir):
    v = Views(spark, sf_dir)
    return G.closure(v.import_edges, v.files.where(F.col("file_path") == TARGET)).select("file_path", F.round("decay", 9).alias("decay"))


@query("WITH RECURSIVE e AS (SELECT importer_file AS a, imported_file AS b FROM import_edges WHERE confidence >= 1), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT x.a AS file_path, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT file_path, min(other) AS component FROM m GROUP BY 1")
def import_cycles(spark, sf_dir):
    return G.components(Views(spark, sf_dir).import_edges)


# --- impact ------------------------------------------------------------------------------------------------------

DIRECT = "SELECT t.id AS test_id, u.file_path, weight AS score FROM code_units u JOIN test_edges ON u.id = code_id JOIN test_units t ON t.id = test_id"
NEAR = f"SELECT file_b AS f FROM p WHERE file_a = '{TARGET}' UNION SELECT file_a FROM p WHERE file_b = '{TARGET}'"


@query(f"WITH p AS ({_pairs('commits', 5)}), near AS ({NEAR}) SELECT test_id, max(score) * 5e-1 AS score FROM ({DIRECT}) d JOIN near ON near.f = d.file_path GROUP BY 1")
def impacted_cochange(spark, sf_dir):
    v = Views(spark, sf_dir)
    pairs = H.co_changes(v.commits, v.commit_files, 5)
    rows = I.cochange_impact(v.code_units, v.test_edges, v.test_units, pairs, v.files.where(F.col("file_path") == TARGET), 5)
    return rows.groupBy("test_id").agg(F.max("score").alias("score"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT test_id, round(max(score * decay * 45e-2), 6) AS score FROM ({DIRECT}) d JOIN best USING (file_path) GROUP BY 1")
def impacted_closure(spark, sf_dir):
    v = Views(spark, sf_dir)
    near = G.closure(v.import_edges, v.files.where(F.col("file_path") == TARGET))
    near = near.groupBy("file_path").agg(F.max("decay").alias("decay"))
    rows = C.direct_impact(v.code_units, v.test_edges, v.test_units, near.select("file_path")).join(near, "file_path")
    return rows.groupBy("test_id").agg(F.round(F.max(F.col("score") * F.col("decay") * I.CLOSURE_WEIGHT), 6).alias("score"))


STATIC = f"SELECT concat(test_file_path, ':', test_unit_name) AS test_id, max(score) AS score FROM static_imports WHERE target_file_path = '{TARGET}' GROUP BY 1"
NAMED = f"SELECT concat(t.file_path, ':', t.name) AS test_id, max(weight) AS score FROM code_units u JOIN test_edges ON u.id = code_id JOIN test_units t ON t.id = test_id WHERE u.file_path = '{TARGET}' GROUP BY 1"


def _named_direct(v: Views) -> DataFrame:
    rows = C.direct_impact(v.code_units, v.test_edges, v.test_units, v.files.where(F.col("file_path") == TARGET))
    rows = rows.select(F.concat_ws(":", "test_file", "test_name").alias("test_id"), F.col("test_file").alias("file_path"), F.col("test_name").alias("name"), "score", F.concat(F.lit("direct "), F.col("unit_name"), F.col("edge_type")).alias("reason"), F.lit("direct").alias("source"))
    return I.best_per_test(rows)


@query(f"SELECT test_id, score FROM ({STATIC})")
def static_tests(spark, sf_dir):
    v = Views(spark, sf_dir)
    return I.static_tests(v.static_imports, v.files.where(F.col("file_path") == TARGET)).select("test_id", "score")


HYBRID = f"SELECT coalesce(a.test_id, b.test_id) AS test_id, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN least(1e0, a.score + 28e-2 * b.score) ELSE coalesce(a.score, b.score) END AS score, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN 'hybrid' WHEN a.score IS NOT NULL THEN 'direct' ELSE 'static_require' END AS source FROM ({NAMED}) a FULL JOIN ({STATIC}) b ON a.test_id = b.test_id"


@query(f"SELECT test_id, round(score, 6) AS score, source FROM ({HYBRID})")
def hybrid_merge(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = I.hybrid(_named_direct(v), I.static_tests(v.static_imports, v.files.where(F.col("file_path") == TARGET)))
    return rows.select("test_id", F.round("score", 6).alias("score"), "source")


@query(f"WITH r AS (SELECT concat(t.file_path, ':', t.name) AS test_id, failure_rate FROM ({RATES}) x JOIN test_units t ON t.id = x.test_id) SELECT h.test_id, round(score * (1 + 5e-1 * coalesce(failure_rate, 0)), 6) AS relevance, source FROM ({HYBRID}) h LEFT JOIN r USING (test_id)")
def suggest_tests(spark, sf_dir):
    v = Views(spark, sf_dir)
    names = v.test_units.select(F.col("id").alias("test_id"), F.concat_ws(":", "file_path", "name").alias("named"))
    rates = R.failure_rates(v.test_results).join(names, "test_id").select(F.col("named").alias("test_id"), "failure_rate")
    rows = I.suggest(_named_direct(v), I.static_tests(v.static_imports, v.files.where(F.col("file_path") == TARGET)), rates)
    return rows.select("test_id", F.round("relevance", 6).alias("relevance"), "source")


_STEM = r"regexp_replace({}, '^.*/|\.[^.]*$', '', 'g')"
_LAST = r"regexp_extract({}, '([^/]*)/[^/]*$', 1)"


@query(f"""WITH s AS (SELECT file_path AS source_file FROM files WHERE file_path IN ('{TARGET}', 'src/d1/f1.py')), m AS (SELECT source_file, t.file_path, t.name, {_STEM.format('source_file')} AS a, {_STEM.format('t.file_path')} AS b, {_LAST.format('source_file')} AS x, {_LAST.format('t.file_path')} AS y FROM s, test_units t),
 n AS (SELECT *, CASE WHEN a = b THEN 1e0 WHEN contains(a, b) OR contains(b, a) THEN 5e-1 ELSE 1e-1 END AS base FROM m) SELECT source_file, concat(file_path, ':', name) AS test_id, CASE WHEN x = y THEN least(1e0, base + 3e-1) ELSE base END AS relevance FROM n""")
def fallback_suggest(spark, sf_dir):
    v = Views(spark, sf_dir)
    return I.fallback(v.files.where(F.col("file_path").isin(TARGET, "src/d1/f1.py")), v.test_units).select("source_file", "test_id", "relevance")


@query(f"""WITH RECURSIVE p AS ({_pairs('commits', 5)}), near AS ({NEAR}), {CLOSURE}, r AS (SELECT test_id, score, 'direct' AS source, 0 AS rank FROM ({DIRECT}) WHERE file_path = '{TARGET}'
 UNION ALL SELECT test_id, score * 5e-1, 'co_change', 1 FROM ({DIRECT}) d JOIN near ON near.f = d.file_path UNION ALL SELECT test_id, score * decay * 45e-2, 'import_graph', 2 FROM ({DIRECT}) d JOIN best USING (file_path))
 SELECT test_id, round(score, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, rank) AS k FROM r) WHERE k = 1""")
def impacted_all(spark, sf_dir):
    v = Views(spark, sf_dir)
    pairs = H.co_changes(v.commits, v.commit_files, 5)
    rows = I.impact(v.code_units, v.test_edges, v.test_units, pairs, v.import_edges, v.files.where(F.col("file_path") == TARGET), min_count=5)
    return rows.select("test_id", F.round("score", 6).alias("score"), "source")


# --- risk --------------------------------------------------------------------------------------------------------

TESTED = f"SELECT file_path FROM ({COVERAGE}) WHERE tested_units > 0"
RISK = f"""{COUPLING.replace('WITH p', 'WITH RECURSIVE p')}, churned AS ({CHURN}), cov AS (SELECT c.*, tested_lines / CAST(lines AS DOUBLE) AS coverage, coalesce(n, 0) AS covering_tests FROM ({COVERAGE}) c LEFT JOIN (SELECT file_path, count(*) AS n FROM ({COVERING}) GROUP BY 1) USING (file_path)),
 {HOPS.format(name='hp', sources=TESTED)},
 raw AS (SELECT ch.file_path, least(ch.churn_score / 5e0, 1e0) AS churn, coalesce(cp.coupling, 0e0) AS coupling, coalesce(cov.coverage, 0e0) AS coverage, coalesce(covering_tests, 0) AS covering_tests, coalesce(edges, 0) AS edges, coalesce(n_call, 0) AS n_call, coalesce(n_dynamic_import, 0) AS n_dyn, coalesce(hh.author_concentration, 1e0) AS author_concentration, coalesce(ins.test_instability, 0e0) AS ti, coalesce(hp.hops, 0) AS hops
  FROM churned ch LEFT JOIN coupled cp USING (file_path) LEFT JOIN cov USING (file_path) LEFT JOIN ({HHI}) hh USING (file_path) LEFT JOIN ({INSTABILITY}) ins USING (file_path) LEFT JOIN hp USING (file_path)
  WHERE ch.file_path NOT IN (SELECT file_path FROM test_units)),
 gap AS (SELECT *, least(1e0, round_even((1 - coverage) * 20, 0) / 20) AS g FROM raw),
 comp AS (SELECT file_path, churn, coupling, CASE WHEN hops > 0 AND g > 0 THEN g * greatest(0e0, 1e0 - 15e-2 * (greatest(0e0, 5e0 - hops) / 5)) ELSE g END AS coverage_gap, round(least(covering_tests / 5e0, 1e0), 4) AS coverage_depth, author_concentration, ti AS test_instability, round(coverage, 4) AS coverage_fraction,
  CASE WHEN edges > 0 THEN round(n_call / CAST(edges AS DOUBLE), 4) ELSE 0e0 END AS edge_type_quality, CAST(edges - n_call AS BIGINT) AS shadow_edge_count, CAST(n_dyn AS BIGINT) AS dynamic_edge_count, least(n_dyn / 20e0, 1e0) * 15e-2 AS hidden_risk, CASE WHEN churn = 0 AND coverage = 0 THEN 5e-1 ELSE 0e0 END AS new_file_boost FROM gap),
 risk AS (SELECT *, round(35e-2 * churn + 25e-2 * coupling + 15e-2 * coverage_gap + 1e-1 * coverage_depth + 1e-1 * author_concentration + 5e-2 * test_instability + hidden_risk + new_file_boost, 4) AS risk_score FROM comp),
 risks AS (SELECT file_path, risk_score, round(churn, 4) AS churn, round(coupling, 4) AS coupling, round(coverage_gap, 4) AS coverage_gap, coverage_depth, round(author_concentration, 4) AS author_concentration, round(test_instability, 4) AS test_instability, coverage_fraction, edge_type_quality, shadow_edge_count, dynamic_edge_count, round(hidden_risk, 4) AS hidden_risk, new_file_boost FROM risk)"""


#: What more than one part of the risk plan and of triage reads; columns that none reads are not made.
RISK_VIEWS = {"commit_files": ("commit_hash", "file_path"), "test_edges": ("test_id", "code_id", "edge_type"), "import_edges": ("*",), "code_units": ("*",), "test_units": ("file_path",)}


def _risks(v: Views) -> DataFrame:
    """A score changes up to the fourth hop only, so hops are looked for no further; the SQL looks for all, with equal results."""
    tested = C.files_with_edges(v.code_units, v.test_edges)
    return K.components(H.churn_scores(v.commits, v.commit_files, AS_OF), _coupled(v), C.file_coverage(v.code_units, v.test_edges), H.author_concentration(v.blame), _instability(v), G.hops(v.import_edges, tested, most=K.NEAR_HOPS), v.test_units)


@query(RISK + " SELECT * FROM risks")
def risk_components(spark, sf_dir):
    return _risks(Views(spark, sf_dir, RISK_VIEWS))


_SHARES = ", ".join(f"count(DISTINCT {c}) AS n_{c}, min({c}) AS min_{c}" for c in K.WEIGHTS)
_UNIFORM = {c: f"(CASE WHEN n_{c} <= 1 THEN 1 ELSE 0 END)" for c in K.WEIGHTS}
_DEAD = " + ".join(f"{u} * {K.WEIGHTS[c]}e0" for c, u in _UNIFORM.items())
_COUNT = " + ".join(_UNIFORM.values())
_ZERO = " + ".join(f"(CASE WHEN n_{c} <= 1 AND min_{c} = 0 THEN 1 ELSE 0 END)" for c in K.WEIGHTS)
_NEW = " + ".join(f"(1 - {u}) * ({K.WEIGHTS[c]}e0 + ({_DEAD}) * {K.WEIGHTS[c]}e0 / (1e0 - ({_DEAD}))) * {c}" for c, u in _UNIFORM.items())


@query(RISK + f", s AS (SELECT count(*) AS files, {_SHARES} FROM risks) SELECT file_path, CASE WHEN files > 1 AND {_COUNT} < 6 AND ({_COUNT} >= 2 OR {_ZERO} > 0) THEN round({_NEW}, 4) ELSE risk_score END AS risk_score FROM risks, s")
def risk_map_reweighted(spark, sf_dir):
    return K.reweighted(_risks(Views(spark, sf_dir, RISK_VIEWS))).select("file_path", "risk_score")


@query(RISK + " SELECT file_path, risk_score, churn, coupling, coverage_gap, author_concentration FROM risks ORDER BY risk_score DESC, file_path")
def risk_map(spark, sf_dir):
    return _risks(Views(spark, sf_dir, RISK_VIEWS)).select("file_path", "risk_score", "churn", "coupling", "coverage_gap", "author_concentration").orderBy(F.desc("risk_score"), "file_path")


@query(RISK + " SELECT round(risk_score, 4) AS risk_score, count(*) AS n FROM risks GROUP BY 1 HAVING count(*) >= 3")
def risk_meta_groups(spark, sf_dir):
    return K.equal_groups(_risks(Views(spark, sf_dir, RISK_VIEWS)))


@query(RISK + f", top AS (SELECT file_path, risk_score FROM risks ORDER BY risk_score DESC, file_path LIMIT 10), g AS (SELECT file_path, count(*) AS gaps FROM ({GAPS}) GROUP BY 1) SELECT file_path, risk_score, coalesce(gaps, 0) AS gaps FROM top LEFT JOIN g USING (file_path)")
def triage(spark, sf_dir):
    v = Views(spark, sf_dir, RISK_VIEWS)
    top = cut(_risks(v).select("file_path", "risk_score").orderBy(F.desc("risk_score"), "file_path").limit(10))
    gaps = _untested(spark, sf_dir, v).join(top.select("file_path"), "file_path", "left_semi").groupBy("file_path").agg(F.count("*").alias("gaps"))
    return top.join(gaps, "file_path", "left").fillna(0, ["gaps"])


# --- scalar and table functions ----------------------------------------------------------------------------------

_EXTENSIONS = ("py", "js", "ts", "go", "rs", "java", "tsx", "txt", "rb")
_PATHS = "concat('src/d', CAST(p_partkey % 7 AS STRING), '/', CASE WHEN p_partkey % 4 = 0 THEN 'test_' ELSE '' END, 'f', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '_test' WHEN p_partkey % 5 = 1 THEN '.test' WHEN p_partkey % 5 = 2 THEN '.spec' ELSE '' END, '.', {ext})"
_PICK = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTENSIONS)) + " END"
PATHS = f"SELECT p_partkey, {_PATHS.format(ext=_PICK)} AS path FROM part"


def _paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATHS.format(ext=_PICK)).alias("path"))


@query(f"SELECT path, CASE regexp_extract(path, '\\.([^.]*)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' END AS language FROM ({PATHS})")
def detect_language(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", X.detect_language("path").alias("language"))


_WHENS = " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{'jest' if f == 'playwright' else f}'" for p, f in X.FRAMEWORKS)


@query(f"SELECT path, CASE {_WHENS} END AS framework FROM (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM ({PATHS}))")
def detect_framework(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", X.detect_framework("path").alias("framework"))


@query(f"""WITH p AS ({PATHS}), q AS (SELECT path, concat(CASE p_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'src/d1' WHEN 2 THEN 'lib/d2' ELSE 'src/d3/deep/er' END, '/t.py') AS test FROM p),
 d AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS a, regexp_replace(test, '/[^/]*$', '') AS b FROM q), s AS (SELECT *, string_split(a, '/') AS x, string_split(b, '/') AS y FROM d),
 n AS (SELECT *, CASE WHEN x[1] <> y[1] THEN 0 WHEN len(x) < 2 OR len(y) < 2 OR x[2] <> y[2] THEN 1 ELSE 2 END AS common, greatest(len(x), len(y)) AS deep FROM s)
 SELECT path, test, CASE WHEN a = b THEN 1e0 WHEN common / deep >= 5e-1 THEN 8e-1 WHEN common >= 1 THEN 6e-1 ELSE 4e-1 END AS weight FROM n""")
def proximity_weight(spark, sf_dir):
    test = F.expr("concat(CASE p_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'src/d1' WHEN 2 THEN 'lib/d2' ELSE 'src/d3/deep/er' END, '/t.py')")
    return _paths(spark, sf_dir).select("path", test.alias("test")).select("path", "test", X.proximity_weight("test", "path").alias("weight"))


@query(f"SELECT path, regexp_replace(path, '\\.(js|jsx|ts|tsx|mjs|cjs)$', '') AS bare FROM ({PATHS})")
def strip_js_ext(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", X.strip_js_extension("path").alias("bare"))


@query(f"SELECT path, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\..*$', ''), '(_test|Test|_spec|Spec)$', ''), '^(test_|Test)', ''), '') AS stem FROM ({PATHS})")
def test_stem(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", X.test_stem("path").alias("stem"))


@query("SELECT a / n AS gap, least(1e0, round_even(a / n * 20, 0) / 20) AS quantized FROM (SELECT CAST(p_partkey AS DOUBLE) AS a, CAST(max(p_partkey) OVER () AS DOUBLE) AS n FROM part)")
def quantize_gap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    gap = F.col("p_partkey").cast("double") / F.col("n")
    return part.crossJoin(part.agg(F.max("p_partkey").cast("double").alias("n"))).select(gap.alias("gap"), X.quantized(gap).alias("quantized"))


_SHARDS = ["src", "src/d1", "src/d3", "lib"]


@query(f"SELECT path, CASE WHEN path LIKE 'src/d1/%' THEN 'src/d1' WHEN path LIKE 'src/d3/%' THEN 'src/d3' ELSE 'src' END AS shard FROM ({PATHS})")
def longest_prefix_shard(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", X.shard_of("path", _SHARDS).alias("shard"))


@query("SELECT name, dep_type, module_path FROM (SELECT event_type AS name, CAST(user_id AS STRING) AS dep_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS module_path, row_number() OVER (PARTITION BY event_type, user_id ORDER BY (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), ts, event_id) AS k FROM events) WHERE k = 1")
def deps_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("dep_type"), F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("module_path"), "ts", "event_id")
    none = F.col("module_path").isNull().cast("int")
    return S.last_of_each(rows, ["name", "dep_type"], [none.asc(), F.col("ts").asc(), F.col("event_id").asc()]).select("name", "dep_type", "module_path")


# --- stores ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0")
def cdc_changed_files(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), X.sha256("text").alias("content_hash"))
    before = now.where("cast(file_path as bigint) % 10 <> 0").withColumn("content_hash", F.when(F.expr("cast(file_path as bigint) % 7 = 0"), "other").otherwise(F.col("content_hash")))
    return S.changed_files(now, before).select(F.col("file_path").cast("bigint").alias("doc_id"))


@query("SELECT user_id, coalesce(n.event_id, -1) AS event_id, coalesce(n.event_type, 'none') AS event_type FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value > 50) WHERE k = 1) n USING (user_id)")
def upsert_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.select("user_id").distinct().select("user_id", F.lit(-1).cast("bigint").alias("event_id"), F.lit("none").alias("event_type"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return S.upserted(old, events.where("value > 50").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT file_path, max(n) AS n FROM (SELECT l_suppkey AS file_path, max(l_quantity) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT l_suppkey, max(l_quantity) FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) GROUP BY 1")
def upsert_max(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_path"), F.col("l_quantity").alias("n"), "l_returnflag")
    return S.upserted_max(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["file_path"], "n")


# --- all lines ---------------------------------------------------------------------------------------------------

#: Lines of one task, about.
LINES_PER_TASK = 250_000


class AllLines(Views):
    """The views with every order line as a test edge, an import and a static import."""

    def __getattr__(self, name: str) -> DataFrame:
        return super().__getattr__(f"all_{name}" if name in WHOLE else name)

    def dealt_test_edges(self) -> tuple[DataFrame, int]:
        """The rows of ``test_edges``, and the tasks over which lines and edges are dealt: they follow the number of lines.

        Lines are dealt by order for the join and by unit for all that follows, so tables of sorts and groups in a task
        keep their size however many lines there are.
        """
        lines, orders = table(self._spark, self._folder, "lineitem"), table(self._spark, self._folder, "orders")
        deal = tasks(lines.count(), LINES_PER_TASK)
        rows = lines.repartition(deal, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        kind = F.when(F.col("l_returnflag") == "R", "call").when(F.col("l_returnflag") == "A", "import").otherwise("dynamic_import")
        rows = rows.select(F.col("o_custkey").cast("string").alias("test_id"), F.col("l_partkey").cast("string").alias("code_id"), kind.alias("edge_type"), (1 - F.col("l_discount")).alias("weight"))
        return rows.repartition(deal, "code_id").groupBy("test_id", "code_id", "edge_type").agg(F.max("weight").alias("weight")), deal


@query(of_all_lines(f"SELECT c.*, tested_lines / CAST(lines AS DOUBLE) AS coverage, coalesce(n, 0) AS covering_tests FROM ({COVERAGE}) c LEFT JOIN (SELECT file_path, count(*) AS n FROM ({COVERING}) GROUP BY 1) USING (file_path)"))
def file_coverage_all_lines(spark, sf_dir):
    v = AllLines(spark, sf_dir)
    edges, deal = v.dealt_test_edges()
    return C.file_coverage(v.code_units, edges, deal=deal).select("file_path", "units", "tested_units", "lines", "tested_lines", "edges", "n_call", "n_dynamic_import", "coverage", "covering_tests")


@query("SELECT u.file_path, t.id AS test_id, count(*) AS edges, round(max(weight), 6) AS score FROM code_units u JOIN all_test_edges ON u.id = code_id JOIN test_units t ON t.id = test_id GROUP BY 1, 2")
def impacted_all_lines(spark, sf_dir):
    """The tests of every file, were it changed."""
    v = AllLines(spark, sf_dir)
    edges, deal = v.dealt_test_edges()
    return C.direct_impact(v.code_units, edges, v.test_units, v.files, deal).groupBy("file_path", "test_id").agg(F.count("*").alias("edges"), F.round(F.max("score"), 6).alias("score"))


@query(of_all_lines(f"WITH RECURSIVE {HOPS.format(name='h', sources=SOURCES)} SELECT * FROM h"))
def bfs_hops_all_lines(spark, sf_dir):
    v = AllLines(spark, sf_dir)
    return G.hops(v.import_edges, v.files.where("file_path like 'src/d3/%'"))


@query(of_all_lines(f"WITH RECURSIVE {CLOSURE} SELECT file_path, round(decay, 9) AS decay FROM best"))
def import_closure_all_lines(spark, sf_dir):
    v = AllLines(spark, sf_dir)
    return G.closure(v.import_edges, v.files.where(F.col("file_path") == TARGET)).select("file_path", F.round("decay", 9).alias("decay"))


# --- streams -----------------------------------------------------------------------------------------------------


def _stream(spark, df: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """What a stream has written to the shared folder once all its input is read."""
    return T.written(df, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", mode, key)


def _event_stream(spark, sf_dir) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _result_stream(spark, sf_dir) -> DataFrame:
    return _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("test_id"), (F.col("event_type") != "error").alias("passed"), F.col("value").alias("duration_ms"), F.col("ts").alias("recorded_at"), "event_id")


@query(RATES)
def stream_failure_rates(spark, sf_dir):
    return _stream(spark, T.failure_rates(_result_stream(spark, sf_dir)), "complete")


@query(f"SELECT test_id, round(duration_cv, 6) AS duration_cv FROM ({CV})")
def stream_duration_spread(spark, sf_dir):
    """The latest 20 durations of each test, kept in the state; the last row of each test counts."""
    rows = _stream(spark, T.duration_spread(_result_stream(spark, sf_dir)), "update", ["test_id"])
    return rows.where("duration_cv is not null").select("test_id", F.round("duration_cv", 6).alias("duration_cv"))


@query("""WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
 SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_activity(spark, sf_dir):
    rows = _stream(spark, T.activity(_event_stream(spark, sf_dir)))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT l_orderkey AS hash FROM lineitem")
def stream_new_commits(spark, sf_dir):
    """Lines as pages of a log that name a commit again and again."""
    lines = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    rows = lines.select(F.col("l_orderkey").alias("hash"), F.col("l_shipdate").cast("timestamp").alias("committed_at"))
    return _stream(spark, T.new_commits(rows, "10000 days")).select("hash")


@query(f"""WITH RECURSIVE r AS (SELECT {code_file('user_id')} AS file_path, concat('a', CAST(event_id % 3 AS STRING)) AS who, CASE WHEN event_type = 'view' THEN 'release' ELSE 'acquire' END AS action, epoch_us(ts) // 1000 AS t FROM events),
 q AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY t, who, action) AS k FROM r WHERE t <= (SELECT max(t) FROM r) - 10000),
 s AS (SELECT DISTINCT file_path, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS agent, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS t, '' AS who, '' AS status FROM q UNION ALL
  SELECT file_path, k, CASE WHEN action = 'release' THEN CASE WHEN held = who THEN NULL ELSE held END WHEN held IS NULL OR held = who THEN who ELSE held END, CASE WHEN action = 'acquire' AND (held IS NULL OR held = who) THEN t + 86400000 ELSE until END, t, who,
   CASE WHEN action = 'release' THEN CASE WHEN held = who THEN 'released' ELSE 'not_held' END WHEN held IS NULL OR held = who THEN 'acquired' ELSE 'held' END
  FROM (SELECT q.*, s.until, CASE WHEN s.until < q.t THEN NULL ELSE s.agent END AS held FROM s JOIN q ON q.file_path = s.file_path AND q.k = s.k + 1))
 SELECT file_path, t AS at_ms, who AS agent_id, status FROM s WHERE k > 0 UNION ALL
 SELECT file_path, until + 1, agent, 'expired' FROM (SELECT *, coalesce(lead(t) OVER (PARTITION BY file_path ORDER BY k), (SELECT max(t) FROM r) - 10000) AS next FROM s WHERE k > 0) WHERE agent IS NOT NULL AND until < next""")
def lock_ttl(spark, sf_dir):
    """Every user's file, for which three agents ask; a lock lasts a day and then expires."""
    events = _event_stream(spark, sf_dir)
    requests = events.select(F.expr(code_file("user_id")).alias("file_path"), F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("agent_id"), F.when(F.col("event_type") == "view", "release").otherwise("acquire").alias("action"), F.lit(86_400_000).cast("bigint").alias("ttl_ms"), F.col("ts").alias("at"))
    with T.timers(spark):
        return _stream(spark, T.locks(requests))


from ripplemark.plans import catalog_edges, catalog_tables, catalog_text  # noqa: E402, F401 - they register their queries here
