"""From dependencies to edges: tests to code units in four tiers, files to files by import.

Every match is an equality join on a key that both sides are normalised to: module names reach a path by any of its
suffixes, relative modules by the folded path, Go packages by directory, names by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions import scalars as X
from ripplemark.operators import products
from ripplemark.session import cut

FANOUT_CAP = 50
HARD, SOFT = ("import", "tainted_import"), ("dynamic_import",)


def _paths(files: DataFrame) -> DataFrame:
    return files.select("file_path").distinct()


def _module_matches(deps: DataFrame, files: DataFrame) -> DataFrame:
    """``deps`` with a ``code_file`` that a module names: equal to the path, or to a suffix of it in whole parts."""
    keys = _paths(files).select(F.col("file_path").alias("code_file"), F.explode(X.suffix_keys("file_path")).alias("key"))
    return deps.where(F.col("module_path").isNotNull()).withColumn("key", X.module_key("module_path")).join(keys, "key").drop("key")


def _relative_matches(deps: DataFrame, files: DataFrame) -> DataFrame:
    """``deps`` with the file, or the index file of the directory, that a relative module leads to."""
    bare = X.strip_js_extension("file_path")
    keys = _paths(files).select(F.col("file_path").alias("code_file"), F.explode(F.array_distinct(F.array(bare, F.regexp_replace(bare, "/index$", "")))).alias("key"))
    return deps.withColumn("key", X.resolve_js("file_path", "module_path")).where(F.col("key").isNotNull()).join(keys, "key").drop("key")


def _package_matches(deps: DataFrame, files: DataFrame, go_module: str | None) -> DataFrame:
    """``deps`` of Go files with every file at or under the directory of the package."""
    if not go_module:
        return deps.withColumn("code_file", F.lit(None).cast("string")).limit(0)
    parts = F.split(X.directory("file_path"), "/")
    keys = _paths(files).select(F.col("file_path").alias("code_file"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("key"))
    own = deps.where((X.detect_language("file_path") == "go") & F.col("module_path").isNotNull())
    return own.withColumn("key", X.resolve_go(F.lit(go_module), "module_path")).where(F.col("key").isNotNull()).join(keys, "key").drop("key")


def scope(deps: DataFrame, units: DataFrame, go_module: str | None = None) -> DataFrame:
    """``file_path, code_file``: the code files that the modules of each file lead to."""
    parts = _module_matches(deps, units), _relative_matches(deps, units), _package_matches(deps, units, go_module)
    rows = None
    for p in parts:
        p = p.select("file_path", "code_file")
        rows = p if rows is None else rows.unionByName(p)
    return rows.distinct()


def rebuilt_import_edges(stored: DataFrame, deps: DataFrame, files: DataFrame, changed: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """``stored`` with the edges of ``changed`` importers made anew from their dependencies."""
    own = changed.select("file_path").distinct()
    kept = stored.join(own.withColumnRenamed("file_path", "importer_file"), "importer_file", "left_anti")
    return kept.unionByName(import_edges(deps.join(own, "file_path", "left_semi"), files, tests))


def test_edges(tests: DataFrame, deps: DataFrame, units: DataFrame, go_module: str | None = None, digits: int | None = None) -> DataFrame:
    """Edges from tests to the code units that their file depends on: :func:`file_edges` for each test of the file.

    ``digits`` rounds the weights, once a file and not once a test.
    """
    by_file = file_edges(deps, units, go_module).withColumnRenamed("dep_type", "edge_type")
    if digits is not None:
        by_file = by_file.withColumn("weight", F.round("weight", digits))
    return of_tests(tests, cut(by_file)).select("test_id", "code_id", "edge_type", "weight")


def tested(tests: DataFrame, deps: DataFrame, units: DataFrame, go_module: str | None = None) -> DataFrame:
    """``test_id`` of the tests that have edges; the edges are not listed."""
    files = cut(_matches(deps, units, go_module).select("file_path").distinct())
    return tests.join(files, "file_path", "left_semi").select(F.col("id").alias("test_id"))


def of_tests(tests: DataFrame, by_file: DataFrame) -> DataFrame:
    """The distinct rows of ``by_file`` (distinct rows with ``file_path``) for each test of the file, with its ``test_id``.

    They are distinct as they are made, without a shuffle of them, but for tests whose id is in several files.
    """
    places = tests.select(F.col("id").alias("test_id"), "file_path").distinct()
    files = cut(places.groupBy("test_id").agg(F.min("file_path").alias("file_path"), F.count("*").alias("n")))
    once = products.joined(by_file, files.where("n = 1").drop("n"), "file_path").drop("file_path")
    several = files.where("n > 1").select(F.col("test_id").alias("_id"))
    more = places.join(several, F.col("test_id").eqNullSafe(F.col("_id")), "left_semi").join(by_file, "file_path").drop("file_path")
    return once.unionByName(more.distinct())


def file_edges(deps: DataFrame, units: DataFrame, go_module: str | None = None) -> DataFrame:
    """``file_path, code_id, dep_type, weight``: the code units that a file depends on.

    Tiers: units of the dependency's name in a file that its module names; all units of the file of a relative module;
    all units of a Go package; units of that name anywhere, within the files that the test file imports if it imports
    any and the dependency has no module.  Each dependency takes its first tier with a match.  The weight is proximity
    times the root of the confidence.
    """
    weight = X.proximity_weight("file_path", "code_file") * F.sqrt("confidence")
    found = cut(_matches(deps, units, go_module).groupBy("file_path", "code_file", "unit", "dep_type").agg(F.max(weight).alias("weight")))
    own = units.select(F.col("id").alias("code_id"), F.col("file_path").alias("code_file"), F.col("name").alias("unit"))
    # Merged and not broadcast: the table of units is small beside the edges made of it, which one task would make.
    whole = found.where(F.col("unit").isNull()).drop("unit").join(own.drop("unit").hint("merge"), "code_file")
    own_named = own.withColumnRenamed("code_file", "_file")  # a unit without a file is met by its name alone
    named = found.where(F.col("unit").isNotNull()).join(own_named.hint("merge"), "unit").where(F.col("code_file").eqNullSafe(F.col("_file")))
    columns = ["file_path", "code_id", "dep_type", "weight"]
    return whole.select(*columns).unionByName(named.select(*columns)).groupBy("file_path", "code_id", "dep_type").agg(F.max("weight").alias("weight"))


def _matches(deps: DataFrame, units: DataFrame, go_module: str | None = None) -> DataFrame:
    """``deps`` with ``code_file, unit`` of their first tier with a match (see :func:`file_edges`); no ``unit``: all units of the file.

    Units of one file and name match alike, so they are one row here, however many ids they have.
    """
    deps = cut(deps.select("file_path", F.col("name").alias("dep"), "dep_type", "module_path", F.coalesce("confidence", F.lit(1.0)).alias("confidence")))
    own = cut(units.select(F.col("file_path").alias("code_file"), F.col("name").alias("unit")).distinct())
    files = own.select(F.col("code_file").alias("file_path")).distinct()
    led = None
    for k, part in enumerate((_module_matches(deps, files), _relative_matches(deps, files), _package_matches(deps, files, go_module))):
        part = part.select(*deps.columns, "code_file", F.lit(k).alias("tier"))
        led = part if led is None else led.unionByName(part)
    led = cut(led)  # the first three tiers, and what the fourth is looked for in
    own_scope = led.select("file_path", "code_file").distinct()
    scoped = own_scope.select("file_path").distinct().withColumn("scoped", F.lit(True))
    told = deps.join(scoped, "file_path", "left").withColumn("free", F.col("module_path").isNotNull() | F.col("scoped").isNull()).drop("scoped")
    # A bare name in a file that imports something means units of what it imports: met by file and name, so a name
    # that thousands of files define stays small.  Only the others are looked for by name alone.
    near = own_scope.join(own, "code_file").withColumnRenamed("file_path", "scope_file")
    inside = told.where(~F.col("free")).join(near, (F.col("file_path") == F.col("scope_file")) & (F.col("dep") == F.col("unit"))).drop("scope_file")
    any_unit = told.where("free").join(own, F.col("dep") == F.col("unit")).unionByName(inside).withColumn("tier", F.lit(3))
    in_module = led.where("tier = 0").withColumn("unit", F.col("dep")).join(own, ["code_file", "unit"])
    in_file = led.where("tier > 0").withColumn("unit", F.lit(None).cast("string"))
    rows = None
    for part in (in_module, in_file, any_unit):
        part = part.select(*deps.columns, "code_file", "unit", "tier")
        rows = part if rows is None else rows.unionByName(part)
    least = F.min("tier").over(Window.partitionBy("file_path", "dep", "dep_type", "module_path"))
    return rows.withColumn("least", least).where(F.col("tier") == F.col("least"))


def import_edges(deps: DataFrame, files: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """``importer_file, imported_file, confidence`` from the dependencies of files that are no tests.

    Sure imports count 1.0; dynamic ones lead to the files of the directory they name (at most ``FANOUT_CAP``, else
    none) and to a file of that stem, at their own confidence.  No loops; the best confidence of a pair counts.
    """
    deps = deps.where(F.col("dep_type").isin(*HARD, *SOFT))
    if tests is not None:
        deps = deps.join(tests.select("file_path").distinct(), "file_path", "left_anti")
    language = X.detect_language("file_path")
    hard = deps.where(F.col("dep_type").isin(*HARD)).withColumn("language", language)
    python = _module_matches(hard.where("language = 'python'"), files.where(F.col("file_path").endswith(".py")))
    js = hard.where(F.col("language").isin("javascript", "typescript"))
    relative = _relative_matches(js.where(F.col("module_path").startswith(".")), files)
    stems = _paths(files).select(F.col("file_path").alias("code_file"), F.regexp_replace(X.basename("file_path"), r"\..*$", "").alias("stem"))
    go = hard.where("language = 'go' and module_path is not null").withColumn("stem", F.substring_index(F.regexp_replace("module_path", "/+$", ""), "/", -1))
    go = go.join(stems.where(F.col("code_file").endswith(".go")), "stem").drop("stem")
    unique = stems.groupBy("stem").agg(F.count("*").alias("n"), F.min("code_file").alias("code_file")).where("n = 1").drop("n")
    js_bare = js.where(~F.coalesce(F.col("module_path").startswith("."), F.lit(False)))
    other = hard.where(~F.coalesce(F.col("language").isin("python", "go", "javascript", "typescript"), F.lit(False))).unionByName(js_bare)
    other = other.join(unique, F.col("name") == F.col("stem")).drop("stem")
    sure = None
    for part in (python, relative, go, other):
        part = part.select("file_path", "code_file", F.lit(1.0).alias("confidence"))
        sure = part if sure is None else sure.unionByName(part)
    token = F.trim(F.regexp_replace("module_path", r"\$\{[^}]*\}", ""))
    soft = deps.where(F.col("dep_type").isin(*SOFT) & F.col("module_path").isNotNull()).withColumn("token", token)
    soft = soft.where((F.col("token") != "") & (F.col("token").startswith(".") | F.contains("token", F.lit("/")) | X.directoryish("token")))
    soft = soft.withColumn("key", X.normal_path(F.concat_ws("/", F.nullif(X.directory("file_path"), F.lit("")), "token"))).select("file_path", "key", F.coalesce("confidence", F.lit(0.3)).alias("confidence"))
    in_dir = _paths(files).select(F.col("file_path").alias("code_file"), X.directory("file_path").alias("key"))
    small = in_dir.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= FANOUT_CAP).select("key")
    by_stem = _paths(files).where(F.col("file_path").rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$")).select(F.col("file_path").alias("code_file"), X.strip_js_extension("file_path").alias("key"))
    targets = in_dir.join(small, "key", "left_semi").unionByName(by_stem)
    rows = sure.unionByName(soft.join(targets, "key").select("file_path", "code_file", "confidence"))
    return rows.where(F.col("file_path") != F.col("code_file")).groupBy(F.col("file_path").alias("importer_file"), F.col("code_file").alias("imported_file")).agg(F.max("confidence").alias("confidence"))


def static_test_imports(tests: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    """Which tests import which files, by their file's import edges; the score is the proximity of the two."""
    own = deps.join(tests.select("file_path").distinct(), "file_path", "left_semi")
    pairs = import_edges(own, files)
    rows = pairs.join(tests.select(F.col("file_path").alias("importer_file"), F.col("name").alias("test_unit_name")), "importer_file")
    eligible = F.col("confidence") >= 1.0
    return rows.select(F.col("importer_file").alias("test_file_path"), "test_unit_name", F.col("imported_file").alias("target_file_path"), eligible.alias("gap_eligible"), X.proximity_weight("importer_file", "imported_file").alias("score"))
