"""A source repository as analytics tables: build, incremental update and the queries over them.

Every query is a plan over the stored tables; only its final, bounded answer comes to the driver.
"""

from __future__ import annotations

import os
import re
import tomllib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions import extract
from ripplemark.functions import scalars as X
from ripplemark.functions.bootstrap import load_bootstrap
from ripplemark.operators import control, coverage, edges, graph, history, impact, lookups, results, risk, shards, worktree
from ripplemark.operators.disk_index import DiskIndex
from ripplemark.operators.store import Store, changed_files
from ripplemark.session import cut
from ripplemark.sources import files as file_source
from ripplemark.sources import git, tree

JOB_FILES, INLINE_FILES, WORKING_TREE_MOST = 300, 50, 30


def shard_config(root: str) -> str:
    """The comma-separated shards of a project: an environment variable, else ``shards`` in ``ripplemark.toml``."""
    if own := os.environ.get("RIPPLEMARK_SHARDS"):
        return own
    path = os.path.join(root, "ripplemark.toml")
    if not os.path.exists(path):
        return ""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("shards", [])
    return found if isinstance(found, str) else ",".join(found)


def storage_dir(root: str | None = None, explicit: str | None = None, shard: str | None = None) -> str:
    """Where a project's tables lie: what is given, else an environment variable, else in the project, else at home."""
    own = explicit or os.environ.get("RIPPLEMARK_STORAGE") or os.path.join(git.project_root(root) if root else os.path.expanduser("~"), ".ripplemark")
    if own == ":memory:" or own.startswith("file:memory"):
        raise ValueError("a store is a folder")
    return os.path.join(own, "shards", shard) if shard else own


def shard_prefixes(config: str, root: str) -> list[str]:
    """Directory prefixes from a comma-separated list; ``dir/*`` stands for each directory in it."""
    out = set()
    for part in (p.strip().strip("/") for p in config.split(",")):
        if part.endswith("/*"):
            base = os.path.join(root, part[:-2])
            out.update(f"{part[:-2]}/{d}" for d in (os.listdir(base) if os.path.isdir(base) else []) if os.path.isdir(os.path.join(base, d)) and not d.startswith("."))
        elif part:
            out.add(part)
    return sorted(out)


class Project:
    """One repository and its store.  ``shards`` are directory prefixes by which results can be split."""

    def __init__(self, spark: SparkSession, root: str, folder: str, shards: str | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        load_bootstrap(spark)
        self.store = Store(spark, folder)
        self.disk_index = DiskIndex(self.store)
        self.locks, self.jobs = control.Locks(self.store), control.Jobs(self.store)
        self.shards = shard_prefixes(shard_config(self.root) if shards is None else shards, self.root)

    # --- build ---------------------------------------------------------------------------------------------------

    def analyze(self, directory: str | None = None, force: bool = False, shard: str | None = None, in_job: bool = False, step=None) -> dict:
        """Everything from the sources and the whole history; unchanged files are not parsed again unless forced.

        A forced run over more than ``JOB_FILES`` files becomes a background job.  A shard is its directory.
        """
        directory = directory or shard
        if force and not in_job:
            n = file_source.source_files(self.spark, self.root, git.visible_files(self.spark, self.root), directory).count()
            if n > JOB_FILES:
                return self.start_job("analyze", directory=directory, force=True, in_job=True) | {"status": "auto_queued", "code_files": n}
        return self._build(directory, force, step=step)

    def _changes(self) -> DataFrame:
        """The files on disk that differ from what the tables know."""
        return changed_files(file_source.source_files(self.spark, self.root, git.visible_files(self.spark, self.root)), self.t("file_hashes"))

    def auto_update(self) -> dict:
        """An update before a query, if at most ``INLINE_FILES`` files have changed and no job is running."""
        if not self.t("bg_jobs").where("status = 'running'").isEmpty():
            return {"updated": False, "reason": "background_job_running"}
        n = self._changes().count()
        if not n or n > INLINE_FILES:
            return {"updated": False, "reason": "too_many_changed_files" if n else "no_changes"}
        self.update()
        return {"updated": True, "reason": None}

    def update(self, step=None) -> dict:
        """As :meth:`analyze` for changed files; nothing is rebuilt if neither files nor commits are new.

        Only the commits after the one read last are read, or all if the branch no longer goes back to it.
        Churn and co-change come from the whole stored history, not from the new commits alone.
        """
        return self._build(None, False, incremental=True, step=step)

    def _build(self, directory: str | None, force: bool, incremental: bool = False, step=None) -> dict:
        """``step(phase, percent)`` is called as the work goes on; it may raise to end it there."""
        store, step = self.store, step or (lambda phase, percent: None)
        step("scan_files", 0)
        visible = git.visible_files(self.spark, self.root)
        current = cut(file_source.source_files(self.spark, self.root, visible, directory))
        changed = cut(changed_files(current, store.read("file_hashes"), force))
        n_changed = changed.count()
        warning, last_head = None, None
        try:
            last_head = git.head(self.root)
        except git.GitError as e:  # no repository, or one without commits
            warning = str(e).split("\n")[0]
        step("read_history", 15)
        if last_head:
            nested = cut(git.git_log(self.spark, self.root, last_head, after=store.get_meta("last_head") if incremental else None))
            commits, commit_files = history.flatten_commits(nested)
            n_read = nested.count()
        else:
            commits, commit_files, n_read = store.read("commits"), store.read("commit_files"), 0
        known = store.read("commits").select("hash")
        n_new = commits.join(known, "hash", "left_anti").count()
        if incremental and not n_changed and not n_new:
            store.set_meta(last_head=last_head)
            return {"status": "no_changes", "changed_files": 0, "new_commits": 0, "commits_read": n_read}
        step("parse_units", 30)
        paths = changed.select("file_path")
        kept = store.read("code_units").join(paths, "file_path", "left_anti")
        units = extract.code_units(changed).join(changed.select("file_path", "content_hash"), "file_path").dropDuplicates(["id"]).withColumn("updated_at", F.current_timestamp())
        units = store.write("code_units", kept.unionByName(units, allowMissingColumns=True))
        store.upsert("commits", commits)
        store.upsert("commit_files", commit_files.select("commit_hash", "file_path", "insertions", "deletions"))
        step("churn_and_coupling", 40)
        all_commits, all_files = store.read("commits"), store.read("commit_files")
        n_commits = all_commits.count()
        authors = all_commits.select("author").distinct().count()
        threshold = self._threshold(n_commits)
        least = self.spark.range(1).select(X.query_threshold(F.lit(threshold), F.lit(authors))).first()[0]
        as_of = F.lit(datetime.now(timezone.utc).isoformat()).cast("timestamp")
        churn = history.churn_all_files(current, history.churn(all_commits, all_files, as_of)).withColumn("unit_name", F.lit(""))
        store.write("churn_stats", churn.unionByName(self._unit_churn(units, paths, as_of), allowMissingColumns=True))
        store.write("co_changes", history.co_changes(all_commits, all_files, least))
        store.write("branch_co_changes", self._branch_pairs())
        step("blame", 55)
        blamed = git.blame(paths, self.root).join(changed.select("file_path", "content_hash"), "file_path")
        store.write("blame_cache", store.read("blame_cache").join(paths, "file_path", "left_anti").unionByName(blamed, allowMissingColumns=True))
        step("discover_and_build_edges", 65)
        tested = file_source.test_files(current)
        tests = store.write("test_units", extract.test_units(tested).join(current.select("file_path", "content_hash"), "file_path"))
        deps = cut(extract.dependencies(current))
        go = self._go_module()
        code = units.join(tests.select("file_path"), "file_path", "left_anti")
        own = cut(edges.test_edges(tests, deps, code, go))
        store.write("test_edges", own.unionByName(impact.heuristic_edges(code, own, tests)))
        store.write("import_edges", edges.import_edges(deps, current, tests))
        store.write("static_test_imports", edges.static_test_imports(tests, deps, current))
        step("clean_results", 90)
        alive, gone = results.without_orphans(store.read("test_results"), tests)
        orphans = gone.count()
        if orphans:
            store.write("test_results", alive)
        hashes = changed.select("file_path", "content_hash", F.current_timestamp().alias("updated_at"), "mtime", "size")
        store.upsert("file_hashes", hashes)
        last = all_commits.agg(F.max_by("date", X.timestamp("date"))).first()[0]
        store.set_meta(last_head=last_head, last_commit_date=last, co_change_query_min=least, distinct_authors=authors, project_fingerprint=self.root)
        out = {"status": "ok", "code_files_scanned": current.count(), "changed_files": n_changed, "new_commits": n_new, "commits_read": n_read, "code_units": units.count(), "test_units": tests.count(), "test_edges": store.read("test_edges").count(), "commits": n_commits, "orphaned_results_cleaned": orphans}
        return out | ({"git_warning": warning} if warning else {})

    def _unit_churn(self, units: DataFrame, changed: DataFrame, as_of) -> DataFrame:
        """Churn of each function: from the log of those in changed files, and as it was for the others that still exist."""
        own = cut(git.unit_commits(units.join(changed, "file_path", "left_semi"), self.root))
        commits = own.select(F.col("commit_hash").alias("hash"), "author", "date").dropDuplicates(["hash"])
        touched = own.select("commit_hash", "file_path", "unit_name", F.lit(0).cast("bigint").alias("insertions"), F.lit(0).cast("bigint").alias("deletions"))
        new = history.churn(commits, touched, as_of, ("file_path", "unit_name"))
        kept = self.t("churn_stats").where(F.col("unit_name") != "").join(changed, "file_path", "left_anti")
        kept = kept.join(units.select("file_path", F.col("name").alias("unit_name")), ["file_path", "unit_name"], "left_semi")
        return cut(kept.unionByName(new, allowMissingColumns=True))

    @staticmethod
    def _threshold(n: int) -> int:
        return 2 if n <= 0 else max(2, (n.bit_length() - 1) // 2 + 1)

    def _branch_pairs(self) -> DataFrame:
        try:
            base = git.diff_base(self.root)
            if base == "HEAD":
                return self.store.read("branch_co_changes").limit(0)
            nested = git.git_log(self.spark, self.root, f"{git.merge_base(self.root, base)}..HEAD")
            return history.co_changes(*history.flatten_commits(nested), 1)
        except RuntimeError:
            return self.store.read("branch_co_changes").limit(0)

    def _go_module(self) -> str | None:
        path = os.path.join(self.root, "go.mod")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8", errors="replace") as f:
            return self.spark.createDataFrame([(f.read(),)], "t string").select(X.go_module_name("t")).first()[0]

    # --- queries -------------------------------------------------------------------------------------------------

    def t(self, table: str) -> DataFrame:
        return self.store.read(table)

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "file_path string")

    def has_data(self) -> bool:
        return not self.t("code_units").isEmpty() or not self.t("commits").isEmpty()

    def _least(self) -> int:
        return lookups.meta_number(self.t("meta"), "co_change_query_min", 3).first()[0]

    def _disk(self) -> dict[str, DataFrame]:
        """What is on disk only: untracked code files and their units, tests of files without stored tests, and the static imports with theirs.

        Made once for a version of the tables and a state of the tree; while neither changes no source file is opened.
        """
        visible = git.visible_files(self.spark, self.root)
        visible = visible if visible is None else cut(visible)
        fresh = cut(git.untracked_files(self.spark, self.root).where(X.has_code_extension("file_path")))
        listing = tree.listing(self.spark, self.root).where(X.has_code_extension("file_path"))
        listing = listing if visible is None else listing.join(visible, "file_path", "left_semi")

        def build() -> dict[str, DataFrame]:
            found = file_source.source_files(self.spark, self.root, visible)
            tests = extract.test_units(file_source.test_files(found.join(self.t("test_units").select("file_path"), "file_path", "left_anti")))
            tests = cut(worktree.disk_only_tests(tests, self.t("test_units")))
            deps = cut(extract.dependencies(found.join(tests.select("file_path"), "file_path", "left_semi")))
            paths = self.t("file_hashes").select("file_path").union(fresh)
            static = worktree.static_overlay(self.t("static_test_imports"), tests, deps, paths)
            return {"files": fresh, "units": extract.code_units(found.join(fresh, "file_path", "left_semi")), "tests": tests, "static": static}

        return self.disk_index.get(listing, fresh, build)

    @staticmethod
    def _rows(df: DataFrame, limit: int | None = None) -> list[dict]:
        return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).collect()]

    def impact(self, files: list[str], functions: list[str] | None = None, limit: int | None = None) -> list[dict]:
        changed = self.spark.createDataFrame([(f, functions) for f in files], "file_path string, functions array<string>")
        rows = impact.impact(self.t("code_units"), self.t("test_edges"), self.t("test_units"), self.t("co_changes"), self.t("import_edges"), changed, min_count=self._least())
        return self._rows(rows.orderBy(F.desc("score"), "test_id"), limit)

    def diff_impact(self, ref: str | None = None, limit: int | None = None, working_tree: bool = False, auto_update: bool = False) -> dict | list[dict]:
        """Tests for what differs from ``ref`` (default: the main branch) and for untracked code files.

        ``working_tree``: also tests on disk that the tables do not know, and static imports of changed files.
        """
        try:
            ref = ref or git.diff_base(self.root)
            changed = git.changed_files(self.spark, self.root, ref).where(X.has_code_extension("file_path"))
            fresh = git.untracked_files(self.spark, self.root).where(X.has_code_extension("file_path"))
        except RuntimeError as e:
            return {"status": "git_error", "error": str(e), "cwd": self.root}
        if changed.isEmpty() and fresh.isEmpty():
            return {"status": "no_changes", "ref": ref}
        if not lookups.missing(changed, self.t("file_hashes")).isEmpty() and auto_update:
            self.auto_update()
        missing = lookups.missing(changed, self.t("file_hashes"))
        if not missing.isEmpty():
            return {"status": "stale_db", "missing_files": [r.file_path for r in missing.limit(20).collect()], "hint": "run update"}
        edits = cut(git.changed_functions(changed, self.root, ref))
        rows = cut(impact.impact_rows(self.t("code_units"), self.t("test_edges"), self.t("test_units"), self.t("co_changes"), self.t("import_edges"), edits, fresh, self._least()))
        hit = rows.select(F.explode("causes").alias("file_path")).distinct()
        rows = impact.best_per_test(rows).drop("causes")
        every = fresh.unionByName(changed).distinct()
        if working_tree:
            disk = self._disk()
            rows = worktree.more_tests(rows, hit, every, fresh, disk["static"], self.t("test_units"), disk["tests"])
        else:
            near = impact.name_matches(every.join(hit, "file_path", "left_anti"), self.t("test_units"))
            near = near.select("test_id", "file_path", "name", (F.col("relevance") * impact.STEM_WEIGHT).alias("score"), F.concat(F.lit("name like "), F.col("source_file")).alias("reason"), F.lit("fallback").alias("source"))
            rows = impact.best_per_test(rows.unionByName(near))
        return self._rows(rows.orderBy(F.desc("score"), "test_id"), limit)

    def suggest_tests(self, file_path: str | None = None, directory: str | None = None, fallback_to_all: bool = False, limit: int | None = None, working_tree: bool = False, auto_update: bool = False) -> list[dict]:
        """Tests for a file or a directory, the most relevant first; at most ``WORKING_TREE_MOST`` where names alone decide."""
        if auto_update:
            self.auto_update()
        own = self._files([file_path]) if file_path else self.t("file_hashes").where(X.in_directory("file_path", directory or "")).select("file_path")
        found = impact.impact(self.t("code_units"), self.t("test_edges"), self.t("test_units"), self.t("co_changes"), self.t("import_edges"), own, min_count=self._least())
        disk = self._disk() if working_tree else None
        static = disk["static"] if disk else self.t("static_test_imports")
        rows = impact.suggest(found, impact.static_tests(static, own), results.failure_rates(self.t("test_results")))
        out = self._rows(rows.orderBy(F.desc("relevance"), "test_id"), limit)
        if not out and (fallback_to_all or file_path or working_tree):
            own = own.unionByName(disk["files"].where(X.in_directory("file_path", directory))).distinct() if disk and directory else own
            near = worktree.suggest_by_name(own, self.t("test_units"), disk and disk["tests"])
            out = self._rows(near.orderBy(F.desc("relevance"), "test_id"), WORKING_TREE_MOST if limit is None else min(limit, WORKING_TREE_MOST))
        return out

    def eval_warning(self, file_path: str) -> dict | None:
        """What to know of a script that makes code at run time: what it loads so is seen by no analysis."""
        if X_SCRIPT.search(file_path) is None:
            return None
        found = file_source.source_files(self.spark, self.root, self._files([file_path])).select(X.eval_count("content").alias("n"), F.col("content").rlike(r"\beval\s*\(").alias("e"), X.plugin_signals("content").alias("s")).first()
        if found is None or not (found.n or found.e):
            return None
        return {"query": "warn_eval_used", "reason": f"{file_path} makes code at run time; tests of what it loads are not in this list", "eval_count": found.n, "signals": [k for k, v in found.s.asDict().items() if v]}

    def risk_of(self, file_path: str, unit_name: str | None = None, new_file_boost: bool = True) -> dict:
        """The risk of one file or one unit of it: units count alike, and nearness of tested code does not."""
        units = lookups.matching(self.t("code_units"), file_path=file_path)
        units = lookups.matching(units, name=unit_name) if unit_name else units
        churn = lookups.matching(self.t("churn_stats"), file_path=file_path, unit_name=unit_name or "").select("file_path", "churn_score")
        own = self._files([file_path])
        churn = own.join(churn, "file_path", "left").fillna(0.0, ["churn_score"])
        pairs, branch = (self.t(t).where((F.col("file_a") == file_path) | (F.col("file_b") == file_path)) for t in ("co_changes", "branch_co_changes"))
        coupled = risk.coupling(own, pairs, branch, graph.neighbors(self.t("import_edges")), self._least())
        spread, rates = results.duration_cv(self.t("test_results")), results.failure_rates(self.t("test_results"))
        unstable = results.instability(coverage.covering_tests(units, self.t("test_edges")), rates, spread)
        blame = history.author_concentration(self._blame().where(F.col("file_path") == file_path))
        row = risk.components(churn, coupled, coverage.file_coverage(units, self.t("test_edges"), "unit"), blame, unstable, new_file_boost=new_file_boost)
        return row.withColumn("unit_name", F.lit(unit_name)).first().asDict()

    def churn(self, file_path: str, unit_name: str = "") -> list[dict]:
        return self._rows(self.t("churn_stats").where((F.col("file_path") == file_path) & (F.col("unit_name") == unit_name)))

    def _blame(self) -> DataFrame:
        """Blame of the current content of each file."""
        return self.t("blame_cache").join(self.t("file_hashes").select("file_path", "content_hash"), ["file_path", "content_hash"])

    def ownership(self, file_path: str) -> list[dict]:
        rows = history.ownership(self._blame().where(F.col("file_path") == file_path)).withColumn("role", F.lit("original_author"))
        return self._rows(rows.orderBy(F.desc("line_count")))

    def who_reviews(self, file_path: str) -> list[dict]:
        rows = history.reviewers(self.t("commits"), self.t("commit_files").where(F.col("file_path") == file_path), datetime.now(timezone.utc).isoformat())
        return self._rows(rows.withColumn("role", F.lit("suggested_reviewer")).orderBy(F.desc("percentage")))

    def coupling(self, file_path: str, min_count: int = 3, working_tree: bool = False) -> dict:
        own, least = self._files([file_path]), max(min_count, self._least())
        row = risk.coupling(own, self.t("co_changes"), self.t("branch_co_changes"), graph.neighbors(self.t("import_edges")), least).first().asDict()
        pairs = history.partners(self.t("co_changes"), own, least).orderBy(F.desc("co_commit_count"), "partner")
        near = graph.neighbors(self.t("import_edges")).where(F.col("file_path") == file_path).orderBy("neighbor")
        partners = self._rows(near)
        if working_tree and not partners:
            source = file_source.source_files(self.spark, self.root, own)
            deps = extract.dependencies(source).withColumn("place", F.monotonically_increasing_id())
            found = worktree.disk_neighbors(deps).first()
            partners = [{"file_path": file_path, "neighbor": m, "confidence": 1.0} for m in (found.modules if found else [])]
            row["import_breadth"] = len(partners)
            row["import_norm"] = min(len(partners) / risk.IMPORT_CAP, 1.0)
            row["coupling"] = max(row["cochange_norm"], row["import_norm"], 0.5 * row["cochange_norm"] + 0.5 * row["import_norm"])
        return row | {"co_change_partners": self._rows(pairs), "import_partners": partners, "min_count": least}

    def _risks(self, directory: str | None = None, exclude_tests: bool = True, proximity: bool = True, mode: str = "line", new_file_boost: bool = True, extra: DataFrame | None = None) -> DataFrame:
        units, own = self.t("code_units"), self.t("test_edges")
        churn = self.t("churn_stats").where(F.col("unit_name") == "")
        coupled = risk.coupling(churn, self.t("co_changes"), self.t("branch_co_changes"), graph.neighbors(self.t("import_edges")), self._least())
        hops = graph.hops(self.t("import_edges"), coverage.files_with_edges(units, own), most=risk.NEAR_HOPS) if proximity else None
        spread = results.duration_cv(self.t("test_results"))
        unstable = results.instability(coverage.covering_tests(units, own), results.failure_rates(self.t("test_results")), spread)
        return risk.components(churn, coupled, coverage.file_coverage(units, own, mode), history.author_concentration(self._blame()), unstable, hops, self.t("test_units") if exclude_tests else None, directory, extra, new_file_boost)

    def risk_map(self, directory: str | None = None, limit: int | None = None, working_tree: bool = False, auto_update: bool = False, shard: str | None = None, **how) -> dict:
        """All files by risk, with what carries the scores; ``working_tree`` adds untracked files, a shard is its directory."""
        if auto_update:
            self.auto_update()
        scored = cut(self._risks(directory or shard, extra=self._disk()["files"] if working_tree else None, **how))
        tables = ("test_edges", "import_edges", "co_changes", "test_results", "commits")
        meta = risk.risk_meta(scored, {r.table_name: r.n for r in coverage.table_counts({t: self.t(t) for t in tables}).collect()})
        locks = lookups.active_locks(self.t("file_locks"), self.locks.now())
        rows = cut(impact.annotated_with_locks(risk.reweighted(scored), self.t("file_locks"), self.locks.now()))
        meta |= {"cycles": self._rows(graph.cycles(self.t("import_edges"))), "active_locks": locks.count(), "lock_claims": rows.where("locked_by is not null").count()}
        return {"files": self._rows(rows.orderBy(F.desc("risk_score"), "file_path"), limit), "_meta": meta}

    def _gaps(self, file_path: str | None = None, directory: str | None = None, exclude_tests: bool = True, static: DataFrame | None = None) -> DataFrame:
        gaps = coverage.untested_units(self.t("code_units"), self.t("test_edges"), self.t("test_units"), self.t("churn_stats"), file_path, directory, exclude_tests)
        return coverage.test_gaps(gaps, self.t("static_test_imports") if static is None else static, coverage.files_with_edges(self.t("code_units"), self.t("test_edges")))

    def test_gaps(self, file_path: str | None = None, directory: str | None = None, exclude_tests: bool = True, limit: int | None = None, working_tree: bool = False, auto_update: bool = False) -> list[dict]:
        if auto_update:
            self.auto_update()
        if not working_tree:
            return self._rows(self._gaps(file_path, directory, exclude_tests).orderBy(F.desc("churn_score"), "id"), limit)
        disk = self._disk()
        gaps = self._gaps(file_path, directory, exclude_tests, disk["static"])
        return self._rows(worktree.with_gaps_on_disk(gaps, worktree.gaps_on_disk(disk["units"], disk["files"], self.t("code_units"), directory, exclude_tests)), limit)

    def stale_tests(self, limit: int | None = None) -> dict | list[dict]:
        if self.t("test_edges").isEmpty():
            return {"status": "no_edges"}
        return self._rows(coverage.stale_edges(self.t("code_units"), self.t("test_edges"), self.t("test_units")).orderBy("test_id", "code_id"), limit)

    def history(self, file_path: str, limit: int | None = None) -> list[dict]:
        return self._rows(history.history(self.t("commits"), self.t("commit_files"), self._files([file_path])).orderBy(F.desc("date"), "commit_hash"), limit)

    def record_result(self, test_id: str, passed: bool, duration_ms: int | None = None) -> dict:
        row = self.spark.createDataFrame([(test_id.replace("::", ":"), passed, duration_ms)], "test_id string, passed boolean, duration_ms bigint").withColumn("recorded_at", F.current_timestamp())
        self.store.append("test_results", row)
        new = impact.heuristic_edges(self.t("code_units"), self.t("test_edges"), self.t("test_units"))
        if not new.isEmpty():
            self.store.upsert("test_edges", new)
        return {"status": "recorded", "test_id": test_id, "passed": passed}

    def shard_stats(self, directory: str | None = None) -> dict:
        """Rows of the tables by shard, the shards of a directory only if one is given, and their sums."""
        wanted = shards.under(directory or "", self.shards)
        tables = {t: self.t(t) for t in ("code_units", "test_units", "churn_stats", "file_hashes", "blame_cache")}
        found = cut(shards.counts(tables, self.shards).where(F.col("shard").isin(*wanted)))
        if found.isEmpty():
            return {"status": "no_data", "hint": "run analyze first"}
        return {"shards": self._rows(found.orderBy("shard", "table_name")), "totals": {r.table_name: r.n for r in shards.totals(found).collect()}, "with_data": [r.shard for r in shards.with_data(found).orderBy("shard").collect()]}

    def stats(self) -> dict:
        names = ("code_units", "test_units", "test_edges", "commits", "commit_files", "blame_cache", "co_changes", "branch_co_changes", "churn_stats", "file_hashes", "import_edges", "test_results")
        out = {r.table_name: r.n for r in coverage.table_counts({n: self.t(n) for n in names}).collect()}
        if not any(out.values()):
            return out | {"hint": "all tables are empty; run analyze"}
        out |= {"coupling_threshold": self._threshold(out["commits"]), "co_change_query_min": self._least()}
        out["shadow_graph"] = coverage.shadow_graph(self.t("test_edges")).first().asDict()
        kept = self.store.get_meta("project_fingerprint")
        return out | ({"warning": f"this store was built from {kept}"} if kept and kept != self.root else {})

    def triage(self, directory: str | None = None, top_n: int = 10, exclude_tests: bool = True, working_tree: bool = False, auto_update: bool = False, new_file_boost: bool = True) -> dict:
        if auto_update:
            self.auto_update()
        disk = self._disk() if working_tree else None
        top = cut(self._risks(directory, exclude_tests, new_file_boost=new_file_boost, extra=disk and disk["files"]).orderBy(F.desc("risk_score"), "file_path").limit(top_n))
        gaps = self._gaps(None, directory, exclude_tests)
        gaps = gaps.unionByName(worktree.gaps_on_disk(disk["units"], disk["files"], self.t("code_units"), directory, exclude_tests)) if disk else gaps
        gaps = gaps.join(top.select("file_path"), "file_path", "left_semi")
        stale = self.stale_tests()
        out = {"top_risk_files": self._rows(top.orderBy(F.desc("risk_score"), "file_path")), "test_gaps": self._rows(gaps.orderBy(F.desc("churn_score"), "id")), "stale_tests": stale if isinstance(stale, list) else []}
        return out | {"summary": {k: len(v) for k, v in out.items()}}

    def optimize_storage(self) -> dict:
        return {"status": "ok", "freed_bytes": self.store.compact() | {"disk_index": self.disk_index.drop()}}

    def start_job(self, kind: str, **how) -> dict:
        how = {"in_job": True, **how} if kind == "analyze" else how
        work = {"analyze": self.analyze, "update": self.update}.get(kind)
        if work is None:
            return {"status": "error", "error": f"no such job: {kind}"}
        started = self.jobs.start(kind, lambda step: work(**how, step=step))
        started.pop("thread", None)
        return started

    def call(self, name: str, **how):
        """A query by name, as the front ends do: ``{"result": ..., "next_steps": ...}``."""
        from ripplemark.plans.hints import next_steps

        if name not in QUERIES:
            raise KeyError(name)
        target = {"acquire_file_lock": self.locks.acquire, "release_file_lock": self.locks.release, "refresh_file_lock": self.locks.refresh, "check_file_lock": self.locks.check, "check_locks": self.locks.check_many, "list_file_locks": self.locks.list, "job_status": self.jobs.status, "cancel_job": self.jobs.cancel}.get(name) or getattr(self, name)
        if name in NEED_DATA and not self.has_data():
            result = {"status": "no_data", "hint": "run analyze first"}
        else:
            result = target(**how)
        steps = next_steps(name, result)
        warning = self.eval_warning(how["file_path"]) if name == "suggest_tests" and how.get("file_path") else None
        return {"result": result, "next_steps": [*steps, warning] if warning else steps}


X_SCRIPT = re.compile(r"\.(js|jsx|ts|tsx|mjs|cjs)$")
NEED_DATA = frozenset("impact diff_impact suggest_tests churn ownership who_reviews coupling risk_map risk_of test_gaps stale_tests history triage".split())
QUERIES = sorted(NEED_DATA | set("analyze update auto_update record_result stats shard_stats optimize_storage start_job job_status cancel_job acquire_file_lock release_file_lock refresh_file_lock check_file_lock check_locks list_file_locks".split()))
