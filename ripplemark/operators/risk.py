"""The composite risk of files: components, score, reweighting, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.scalars import hidden_risk, in_directory, proximity_adjusted, quantized
from ripplemark.session import cut

# The weight of each component.
#: The last number of hops from tested files that changes a score.
NEAR_HOPS = 4
WEIGHTS = {"churn": 0.35, "coupling": 0.25, "coverage_gap": 0.15, "coverage_depth": 0.10, "author_concentration": 0.10, "test_instability": 0.05}
NEW_FILE_BOOST = 0.5
CHURN_CAP, COCHANGE_CAP, IMPORT_CAP, DEPTH_CAP = 5.0, 10.0, 8.0, 5.0


def coupling(files: DataFrame, pairs: DataFrame, branch_pairs: DataFrame, neighbors: DataFrame, min_count: int) -> DataFrame:
    """Breadth of co-change (whole history and branch) and of imports per file, and the norm they make."""
    from ripplemark.operators.history import both_ways

    own = files.select("file_path").distinct()
    own = own.join(_breadth(both_ways(pairs.where(F.col("co_commit_count") >= min_count)), "cochange_breadth"), "file_path", "left")
    return _coupled(own.join(_breadth(both_ways(branch_pairs), "branch_breadth"), "file_path", "left"), neighbors)


def coupling_of(files: DataFrame, breadths: DataFrame, neighbors: DataFrame) -> DataFrame:
    """:func:`coupling` from partners that are counted by file already (``file_path, cochange_breadth, branch_breadth``)."""
    return _coupled(files.select("file_path").distinct().join(breadths, "file_path", "left"), neighbors)


def _breadth(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("file_path").agg(F.count("*").alias(name))


def _coupled(own: DataFrame, neighbors: DataFrame) -> DataFrame:
    own = own.join(_breadth(neighbors.select("file_path", "neighbor").distinct(), "import_breadth"), "file_path", "left").fillna(0)
    cc = F.least(F.greatest("cochange_breadth", "branch_breadth") / COCHANGE_CAP, F.lit(1.0))
    imports = F.least(F.col("import_breadth") / IMPORT_CAP, F.lit(1.0))
    return own.select("*", cc.alias("cochange_norm"), imports.alias("import_norm"), F.greatest(cc, imports, 0.5 * cc + 0.5 * imports).alias("coupling"))


def score(weights: dict[str, float] = WEIGHTS) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * F.col(name)
    return out


def components(churn: DataFrame, coupled: DataFrame, coverage: DataFrame, concentration: DataFrame, instability: DataFrame, hops: DataFrame | None = None, tests: DataFrame | None = None, directory: str | None = None, extra: DataFrame | None = None, new_file_boost: bool = True) -> DataFrame:
    """One row per file with all components and ``risk_score``.

    Files: those with file-level churn rows, and ``extra`` ones, without the files of ``tests``.  All parts are keyed
    by file and joined one after another on that key, so files are shuffled once.
    """
    own = churn.where(F.coalesce("unit_name", F.lit("")) == "") if "unit_name" in churn.columns else churn
    own = own.select("file_path", F.least(F.col("churn_score") / CHURN_CAP, F.lit(1.0)).alias("churn"))
    if extra is not None:
        own = own.unionByName(extra.select("file_path").distinct().join(own, "file_path", "left_anti").withColumn("churn", F.lit(0.0)))
    if directory:
        own = own.where(in_directory("file_path", directory))
    if tests is not None:
        own = own.join(tests.select("file_path").distinct(), "file_path", "left_anti")
    own = own.join(coupled.select("file_path", "coupling"), "file_path", "left")
    own = own.join(coverage, "file_path", "left").join(concentration, "file_path", "left").join(instability, "file_path", "left")
    own = own.join(hops, "file_path", "left") if hops is not None else own.withColumn("hops", F.lit(None).cast("int"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    coverage_share = F.coalesce("coverage", F.lit(0.0))
    dynamic = zero("n_dynamic_import") + zero("n_eval_import")
    own = own.select(
        "file_path",
        "churn",
        F.coalesce("coupling", F.lit(0.0)).alias("coupling"),
        proximity_adjusted(quantized(1 - coverage_share), F.coalesce("hops", F.lit(0))).alias("coverage_gap"),
        F.round(F.least(zero("covering_tests") / DEPTH_CAP, F.lit(1.0)), 4).alias("coverage_depth"),
        F.coalesce("author_concentration", F.lit(1.0)).alias("author_concentration"),
        F.coalesce("test_instability", F.lit(0.0)).alias("test_instability"),
        F.round(coverage_share, 4).alias("coverage_fraction"),
        F.when(zero("edges") > 0, F.round(zero("n_call") / zero("edges"), 4)).otherwise(0.0).alias("edge_type_quality"),
        (zero("edges") - zero("n_call")).cast("bigint").alias("shadow_edge_count"),
        dynamic.cast("bigint").alias("dynamic_edge_count"),
        hidden_risk(dynamic).alias("hidden_risk"),
        F.when(F.lit(new_file_boost) & (F.col("churn") == 0) & (coverage_share == 0), NEW_FILE_BOOST).otherwise(0.0).alias("new_file_boost"),
    )
    own = own.withColumn("risk_score", F.round(score() + F.col("hidden_risk") + F.col("new_file_boost"), 4))
    return own.withColumns({c: F.round(c, 4) for c in (*WEIGHTS, "hidden_risk")})


def uniformity(risks: DataFrame) -> dict:
    """The number of files, and of every component the number of different values and the least: one small row."""
    return risks.agg(F.count("*").alias("files"), *[F.count_distinct(c).alias(f"n_{c}") for c in WEIGHTS], *[F.min(c).alias(f"min_{c}") for c in WEIGHTS]).first().asDict()


def new_weights(found: dict) -> dict[str, float] | None:
    """Weights with those of uniform components spread over the others; None if the scores stay as they are.

    Needs two uniform components, or one that is 0 everywhere, and at least one that varies among two files or more.
    """
    uniform = [c for c in WEIGHTS if found[f"n_{c}"] <= 1]
    zeros = [c for c in uniform if found[f"min_{c}"] == 0]
    varying = [c for c in WEIGHTS if c not in uniform]
    if found["files"] <= 1 or (len(uniform) < 2 and not zeros) or not varying:
        return None
    live = sum(WEIGHTS[c] for c in varying)
    dead = sum(WEIGHTS[c] for c in uniform)
    return {c: WEIGHTS[c] + dead * WEIGHTS[c] / live for c in varying}


def reweighted(risks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``risks`` with scores from the weights of varying components; boosts do not count then."""
    if weights is None:
        risks = cut(risks)  # read twice: for what varies, and for the scores
        weights = new_weights(uniformity(risks))
    return risks if weights is None else risks.withColumn("risk_score", F.round(score(weights), 4))


def equal_groups(risks: DataFrame, least: int = 3) -> DataFrame:
    """Scores that ``least`` files or more share."""
    return risks.groupBy(F.round("risk_score", 4).alias("risk_score")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def why_uniform(component: str, value: float | None, stats: dict[str, int]) -> str:
    """Why all files have one ``value`` of a component, from the sizes of the tables it comes from."""
    n = lambda table: stats.get(table, 0)
    if component == "coupling" and not value:
        lacks = [what for table, what in (("import_edges", "no import edges"), ("co_changes", f"no pairs of files in enough of {n('commits')} commits")) if not n(table)]
        return " and ".join(lacks) or f"{n('import_edges')} import edges and {n('co_changes')} pairs touch none of the files"
    if component == "coverage_gap" and value == 1:
        return f"none of {n('test_edges')} test edges leads to a unit of these files" if n("test_edges") else "no test edges"
    if component == "coverage_depth" and not value:
        return f"none of {n('test_edges')} test edges covers these files"
    if component == "test_instability" and not value:
        return f"all {n('test_results')} results are stable" if n("test_results") else "no test results"
    if component == "author_concentration" and value == 1:
        return "one author a file, or no blame"
    if component == "churn" and not value:
        return f"none of {n('commits')} commits touches these files" if n("commits") else "no commits"
    return f"all files have {value}"


def risk_meta(risks: DataFrame, stats: dict | None = None) -> dict:
    """Which components carry the scores, why the others do not, and groups of equal scores (warned of from 5 files)."""
    found = uniformity(risks)
    uniform = [c for c in WEIGHTS if found[f"n_{c}"] <= 1]
    weights = new_weights(found)
    groups = [r.asDict() for r in equal_groups(risks).orderBy(F.desc("n"), "risk_score").limit(10).collect()]
    return {
        "total_files": found["files"],
        "effective_components": [c for c in WEIGHTS if c not in uniform],
        "uniform_components": {c: {"value": found[f"min_{c}"], "reason": why_uniform(c, found[f"min_{c}"], stats or {})} for c in uniform},
        "reweighted": weights is not None,
        "effective_weights": {c: round(w, 4) for c, w in (weights or {}).items()},
        "uniform_risk_groups": groups,
        "warning": "many files share one score" if any(g["n"] >= 5 for g in groups) else None,
    }
