"""Operators over commits and blame: churn, co-change, ownership, reviewers, file history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.scalars import days_since, recency, timestamp
from ripplemark.operators.products import tasks
from ripplemark.session import cut

MAX_FILES_PER_COMMIT = 50
#: Commits whose pairs one task makes and counts, about.
COMMITS_PER_TASK = 50_000


def flatten_commits(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits with an array of files as the two tables ``commits`` and ``commit_files``."""
    files = nested.select(F.col("hash").alias("commit_hash"), F.inline("files").alias("file_path", "insertions", "deletions"))
    return nested.drop("files"), files


def churn(commits: DataFrame, commit_files: DataFrame, as_of: Column | str, by: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Per file: commits, distinct authors, lines in and out, date of the latest commit, recency-weighted score.

    Rows whose date cannot be read do not count.  One shuffle by commit for the join (none if commits are small enough
    to be broadcast by Spark), one by file with partial sums before it.
    """
    rows = commit_files.join(_weighed(commits, as_of), "commit_hash")
    return rows.groupBy(*by).agg(
        F.count("*").alias("commit_count"),
        F.count_distinct("author").alias("distinct_authors"),
        F.sum("insertions").cast("bigint").alias("total_insertions"),
        F.sum("deletions").cast("bigint").alias("total_deletions"),
        F.max_by(F.col("date").cast("string"), F.struct("ts", "commit_hash")).alias("last_changed"),
        F.round(F.sum("weight"), 6).alias("churn_score"),
    )


def churn_scores(commits: DataFrame, commit_files: DataFrame, as_of: Column | str) -> DataFrame:
    """Per file the score alone that :func:`churn` gives; ``commit_files`` needs no counts of lines."""
    rows = commit_files.select("commit_hash", "file_path").join(_weighed(commits, as_of).select("commit_hash", "weight"), "commit_hash")
    return rows.groupBy("file_path").agg(F.round(F.sum("weight"), 6).alias("churn_score"))


def _weighed(commits: DataFrame, as_of: Column | str) -> DataFrame:
    """Commits whose date can be read, with their weight in a score: dates are read once a commit and not once a file of it."""
    dated = commits.select(F.col("hash").alias("commit_hash"), "author", "date", timestamp("date").alias("ts"), recency("date", as_of).alias("weight"))
    return dated.where(F.col("ts").isNotNull())


def churn_all_files(files: DataFrame, churned: DataFrame) -> DataFrame:
    """A churn row for every file, zeros for files without commits."""
    zero = {"commit_count": 0, "distinct_authors": 0, "total_insertions": 0, "total_deletions": 0, "churn_score": 0.0}
    return files.select("file_path").distinct().join(churned, "file_path", "left").fillna(zero)


def co_changes(commits: DataFrame, commit_files: DataFrame, min_count: int = 3, max_files: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    """Pairs of files (``file_a`` < ``file_b``) that share at least ``min_count`` commits, and the date of the latest.

    Commits of more than ``max_files`` files say nothing about coupling and are left out before any pair is made, so a
    commit yields at most ``max_files ** 2 / 2`` pairs.  Pairs are made inside the grouped row, without a self-join:
    one shuffle by commit, one by pair with partial counts before it.
    """
    found = _pairs(commits, commit_files, max_files).groupBy("file_a", "file_b").agg(F.count("*").alias("co_commit_count"), F.max("us").alias("us"))
    return _dated(found.where(F.col("co_commit_count") >= min_count), commits, "last_co_commit")


def co_changes_with_branch(commits: DataFrame, commit_files: DataFrame, on_branch: Column, max_files: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    """Pairs as :func:`co_changes` finds them, of all commits, with ``branch_count``: the commits for which ``on_branch`` holds."""
    rows = _pairs(commits, commit_files, max_files, on_branch).groupBy("file_a", "file_b")
    return _dated(rows.agg(F.count("*").alias("co_commit_count"), F.sum("branch").alias("branch_count"), F.max("us").alias("us")), commits, "last_co_commit")


def breadths(commits: DataFrame, commit_files: DataFrame, on_branch: Column, min_count: int = 3, max_files: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    """Per file the partners that share ``min_count`` commits with it, and those of any commit for which ``on_branch`` holds.

    What :func:`co_changes_with_branch` finds, counted by file in the task that has counted the pairs: no pair is kept,
    dated or shuffled again.  Files go by a number, which pairs are counted by in less time and room than by two texts.
    """
    files, named = _numbered(commit_files.where(F.col("file_path").isNotNull()))
    pairs = _pairs(commits, files, max_files, on_branch).groupBy("file_a", "file_b").agg((F.count("*") >= min_count).alias("often"), (F.sum("branch") >= 1).alias("here"))
    ends = pairs.where(F.col("often") | F.col("here")).select(F.explode(F.array("file_a", "file_b")).alias("file"), "often", "here")
    return ends.groupBy("file").agg(F.count_if("often").alias("cochange_breadth"), F.count_if("here").alias("branch_breadth")).join(named, "file").drop("file")


def _number(path: str) -> Column:
    return F.xxhash64(path)


def _numbered(commit_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commit_files`` with a number as ``file_path``, and ``file, file_path`` of every number; paths stay if two of them had one number."""
    named = cut(commit_files.select("file_path").distinct().withColumn("file", _number("file_path")))
    number = _number("file_path") if named.groupBy("file").count().where("count > 1").isEmpty() else F.col("file_path")
    return commit_files.select("commit_hash", number.alias("file_path")), named.select("file_path", number.alias("file"))


def _micros(date: Column | str) -> Column:
    """A date as a number that grows with time; dates that cannot be read come before all others."""
    return F.coalesce(F.unix_micros(timestamp(date)), F.lit(-(1 << 62)))


def _dated(rows: DataFrame, commits: DataFrame, name: str) -> DataFrame:
    """``rows`` with the date of their ``us`` as it was written (of several writings of one moment the greatest).

    Numbers are aggregated in the hash tables of whole-stage code, which texts are not; so texts are joined afterwards.
    """
    written = commits.groupBy(_micros("date").alias("us")).agg(F.max(F.col("date").cast("string")).alias(name))
    return rows.join(written, "us", "left").drop("us")


def _pairs(commits: DataFrame, commit_files: DataFrame, max_files: int, on_branch: Column | None = None) -> DataFrame:
    """``file_a, file_b, us, branch``: a row for each pair of files of each commit of at most ``max_files``.

    No row ever holds the files of a larger commit: of each only the first ``max_files + 1`` are sent to be gathered.
    """
    own = commits.select(F.col("hash").alias("commit_hash"), _micros("date").alias("us"), (F.lit(False) if on_branch is None else on_branch).cast("long").alias("branch"))
    by_path = Window.partitionBy("commit_hash").orderBy("file_path")
    few = commit_files.where(F.col("file_path").isNotNull()).select("commit_hash", "file_path", F.dense_rank().over(by_path).alias("_k")).where(F.col("_k") <= max_files + 1)
    # Rows lie sorted, so a commit's list is a frame from its first row; repeats of a file go before.
    few = few.withColumn("_before", F.lag("_k").over(by_path)).where(F.col("_before").isNull() | (F.col("_before") < F.col("_k")))
    sets = few.select("commit_hash", "_k", F.collect_list("file_path").over(by_path.rowsBetween(0, max_files)).alias("files")).where(F.col("_k") == 1)
    sets = sets.where(F.size("files").between(2, max_files)).select("commit_hash", "files").join(own, "commit_hash")
    sets = sets.repartition(tasks(commits.count(), COMMITS_PER_TASK), "commit_hash")  # counted pairs of a task follow its commits
    firsts = sets.select("us", "branch", "files", F.posexplode("files").alias("i", "file_a"))
    return firsts.select("us", "branch", "file_a", F.explode(F.slice("files", F.col("i") + 2, F.lit(max_files))).alias("file_b"))


def file_level(churn: DataFrame) -> DataFrame:
    """Churn rows with the unit name of a whole file: empty, never null, so that it can be a key."""
    return churn.fillna("", ["unit_name"])


def canonical(pairs: DataFrame) -> DataFrame:
    """``file_a`` and ``file_b`` in order."""
    return pairs.withColumns({"file_a": F.least("file_a", "file_b"), "file_b": F.greatest("file_a", "file_b")})


def both_ways(pairs: DataFrame, a: str = "file_a", b: str = "file_b", other: str = "partner", to: str = "file_path") -> DataFrame:
    """Every undirected pair as a row for each of its ends."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    forth = pairs.select(F.col(a).alias(to), F.col(b).alias(other), *rest)
    return forth.unionByName(pairs.select(F.col(b).alias(to), F.col(a).alias(other), *rest))


def partners(pairs: DataFrame, files: DataFrame | None = None, min_count: int = 3) -> DataFrame:
    """Co-change partners of every file (or of ``files``) with at least ``min_count`` shared commits."""
    rows = both_ways(pairs.where(F.col("co_commit_count") >= min_count))
    return rows if files is None else rows.join(files.select("file_path").distinct(), "file_path", "left_semi")


def top_partners(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` strongest partners of every file, with their place ``k``."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("co_commit_count"), "partner"))
    return both_ways(pairs).withColumn("k", place).where(F.col("k") <= most)


def ownership(blame: DataFrame) -> DataFrame:
    """Lines and share of each author of each file, with the e-mail of the author's last block."""
    n = F.col("line_end") - F.col("line_start") + 1
    own = blame.groupBy("file_path", "author").agg(F.max_by("author_email", F.struct("line_start", "line_end", "author_email")).alias("author_email"), F.sum(n).cast("bigint").alias("line_count"))
    total = F.sum("line_count").over(Window.partitionBy("file_path"))
    return own.withColumn("percentage", F.round(100 * F.col("line_count") / total, 2))


def author_concentration(blame: DataFrame) -> DataFrame:
    """Sum of squared shares of the authors of each file, to 4 places; files without lines count as 1."""
    n = F.col("line_end") - F.col("line_start") + 1
    own = blame.groupBy("file_path", "author").agg(F.sum(n).alias("n"))
    out = own.groupBy("file_path").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("n"))
    share = F.when(F.col("n") > 0, F.round(F.col("squares") / (F.col("n") * F.col("n").cast("double")), 4)).otherwise(1.0)
    return out.select("file_path", share.alias("author_concentration"))


def reviewers(commits: DataFrame, commit_files: DataFrame, as_of: Column | str) -> DataFrame:
    """Per file and author: commits, lines, recency score, last activity, whole days since, share of the score.

    A commit whose date cannot be read adds 0.01 to the score.
    """
    as_of = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    rows = commit_files.join(commits.select(F.col("hash").alias("commit_hash"), "author", "date", timestamp("date").alias("ts")), "commit_hash")
    own = rows.groupBy("file_path", "author").agg(
        F.count("*").alias("recent_commits"),
        F.sum("insertions").cast("bigint").alias("insertions"),
        F.sum("deletions").cast("bigint").alias("deletions"),
        F.sum(F.coalesce(recency("ts", as_of), F.lit(0.01))).alias("raw"),
        F.max("ts").alias("last_ts"),
    )
    total = F.sum("raw").over(Window.partitionBy("file_path"))
    days = F.round(days_since("last_ts", as_of)).cast("bigint")
    return own.select("file_path", "author", "recent_commits", "insertions", "deletions", F.round("raw", 4).alias("score"), days.alias("days_since"), F.round(100 * F.col("raw") / total, 2).alias("percentage"))


def history(commits: DataFrame, commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """The commits of the given files."""
    own = commit_files.join(files.select("file_path").distinct(), "file_path", "left_semi")
    return own.join(commits.withColumnRenamed("hash", "commit_hash"), "commit_hash")


def line_blocks(lines: DataFrame, by: str, order: list[str], value: str, step: str | None = None) -> DataFrame:
    """Maximal runs of neighbouring rows with one ``value``: first and last place and length of each.

    ``step``: a numeric column that must also rise by one inside a run.
    """
    w = Window.partitionBy(by).orderBy(*order)
    new = ~F.lag(value).over(w).eqNullSafe(F.col(value))
    if step:
        new = new | (F.lag(step).over(w) + 1 != F.col(step))
    rows = lines.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_place", F.row_number().over(w))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(by, "_run").agg(F.first(value).alias(value), F.min("_place").alias("first_place"), F.max("_place").alias("last_place"), F.count("*").alias("length")).drop("_run")
