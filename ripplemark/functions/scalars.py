"""Scalar column functions: dates, scores, paths, languages and frameworks.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the language of each.
LANGUAGES = {
    "py": "python", "pyw": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "cs": "csharp", "java": "java",
    "kt": "kotlin", "kts": "kotlin",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
    "swift": "swift", "php": "php", "rb": "ruby", "dart": "dart",
}

# File name patterns and the test framework each stands for; the first that matches counts.
FRAMEWORKS = [
    (r"^test_.*\.py$", "pytest"),
    (r"^.*_test\.py$", "pytest"),
    (r"^.*\.test\.[jt]sx?$", "jest"),
    (r"^.*\.spec\.[jt]sx?$", "playwright"),
    (r"^.*_test\.go$", "go"),
    (r"^.*Tests?\.cs$", "csharp_test"),
    (r"^.*Test\.java$", "junit"),
    (r"^Test.*\.java$", "junit"),
    (r"^.*Test\.kt$", "junit"),
    (r"^.*Tests?\.swift$", "xctest"),
    (r"^.*Test\.php$", "phpunit"),
    (r"^.*_spec\.rb$", "rspec"),
    (r"^test_.*\.rb$", "minitest"),
    (r"^.*_test\.dart$", "dart_test"),
]

# Marks of tests in Rust and C or C++ sources.
RUST_MARKS = ("#[test]", "#[tokio::test]", "#[rstest]", "#[cfg(test)]")
CPP_MARKS = ("TEST(", "TEST_F(", "TEST_CASE(", "BOOST_AUTO_TEST_CASE(")

# Signs of code that is loaded by name at run time.
PLUGIN_SIGNS = {
    "has_plugin_registry": r"\b(registerPlugin|loadPlugin|addPlugin|installPlugin|enabledPlugins?|getPlugin|hasPlugin)\s*\(",
    "has_plugin_manager": r"\b(PluginManager|ModuleRegistry|ExtensionRegistry|PluginLoader|ModuleLoader)\b",
    "has_plugin_dir_ref": r"\b(plugins?|extensions?|addons?)\b",
    "has_plugin_config": r"""require\s*\(\s*['"]([^'"]*[/\\])?(plugins?|extensions?|builtin)['"]\s*\)""",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def timestamp(x: Column | str) -> Column:
    """An ISO-8601 date with any offset, or none (UTC); null if it cannot be read.  Timestamps pass through."""
    return F.try_to_timestamp(_c(x).cast("string"))


def days_since(x: Column | str, as_of: Column | str) -> Column:
    """Fractional days from ``x`` to ``as_of``, not below 0."""
    as_of = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return F.greatest((F.unix_micros(as_of) - F.unix_micros(timestamp(x))) / F.lit(8.64e10), F.lit(0.0))


def recency(x: Column | str, as_of: Column | str) -> Column:
    """The weight 1 / (1 + days) of a date."""
    return F.lit(1.0) / (F.lit(1.0) + days_since(x, as_of))


def coupling_threshold(commits: Column | str) -> Column:
    """How many shared commits count as coupling in a history of so many commits."""
    n = _c(commits)
    return F.when(n <= 0, 2).otherwise(F.greatest(F.lit(2), F.floor(F.log2(n) / 2).cast("int") + 1))


def query_threshold(threshold: Column | str, authors: Column | str) -> Column:
    """The threshold for queries: halved, not below 1, for at most one author."""
    t = _c(threshold)
    return F.when(_c(authors) <= 1, F.greatest(F.lit(1), F.floor(t / 2).cast("int"))).otherwise(t)


def quantized(gap: Column | str, steps: int = 20) -> Column:
    """Rounded half-even to ``1 / steps``, at most 1."""
    return F.least(F.lit(1.0), F.bround(_c(gap) * steps, 0) / steps)


def proximity_adjusted(gap: Column | str, hops: Column | str, share: float = 0.15, reach: int = 5) -> Column:
    """A coverage gap made smaller by the nearness of tested code; hop 0 and unreachable files keep theirs."""
    g, h = _c(gap), _c(hops)
    near = F.greatest(F.lit(0.0), F.lit(float(reach)) - h) / reach
    return F.when((h > 0) & (g > 0), g * F.greatest(F.lit(0.0), 1 - share * near)).otherwise(g)


def hidden_risk(dynamic_edges: Column | str) -> Column:
    return F.least(_c(dynamic_edges) / F.lit(20.0), F.lit(1.0)) * 0.15


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def detect_language(path: Column | str) -> Column:
    """The language of a path by its extension, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def has_code_extension(path: Column | str) -> Column:
    return extension(path).isin(*LANGUAGES)


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def directory(path: Column | str) -> Column:
    """What comes before the last slash; empty at the root."""
    p = _c(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def detect_framework(path: Column | str, content: Column | None = None) -> Column:
    """The test framework of a file by its name, or null; a spec file is Playwright's only if its content says so."""
    name = basename(path)
    text = F.lit("") if content is None else F.coalesce(content, F.lit(""))
    out = F.lit(None).cast("string")
    for pattern, framework in reversed(FRAMEWORKS):
        found = F.when(F.contains(text, F.lit("playwright")), "playwright").otherwise("jest") if framework == "playwright" else F.lit(framework)
        out = F.when(name.rlike(pattern), found).otherwise(out)
    return out


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def is_test_file(path: Column | str, content: Column) -> Column:
    """Test files by name, and Rust, C and C++ sources by the marks in them."""
    text = F.coalesce(content, F.lit(""))
    rust = _c(path).endswith(".rs") & _any_of(text, RUST_MARKS)
    cpp = _c(path).rlike(r"\.(cpp|cc|cxx|c)$") & _any_of(text, CPP_MARKS)
    return detect_framework(path, content).isNotNull() | rust | cpp


def test_framework(path: Column | str, content: Column) -> Column:
    """The framework of a test file, those found by their marks included."""
    return F.coalesce(detect_framework(path, content), F.when(is_test_file(path, content), F.when(_c(path).endswith(".rs"), "rust").otherwise("gtest")))


def is_test_name(name: Column | str, framework: Column | str) -> Column:
    """Whether a unit of a test file is a test, by its last dotted part and the framework."""
    last, fw = F.element_at(F.split(_c(name), r"\."), -1), _c(framework)
    return (
        F.when(fw == "pytest", last.rlike("^(test_|Test)"))
        .when(fw.isin("jest", "playwright"), last.rlike("^(describe$|it$|test)"))
        .when(fw == "go", last.rlike("^(Test|Benchmark)"))
        .when(fw == "rust", last.startswith("test_"))
        .when(fw == "csharp_test", last.rlike("^Test|Tests?$"))
        .when(fw == "gtest", F.lit(True))
        .when(fw.isin("junit", "xctest", "minitest", "phpunit", "dart_test"), last.rlike("^[tT]est"))
        .when(fw == "rspec", last.rlike("^(describe$|it$|context$|test)"))
        .otherwise(F.lit(False))
    )


def proximity_weight(test_path: Column | str, code_path: Column | str) -> Column:
    """1.0 in one directory, 0.8 if half of the deeper path is shared from the root, 0.6 if anything is, else 0.4."""
    a, b = (F.split(F.nullif(directory(F.translate(_c(p), "\\", "/")), F.lit("")), "/") for p in (test_path, code_path))
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), 0)
    common = F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1)
    deeper = F.greatest(F.size(a), F.size(b))
    return F.when(a == b, 1.0).when(common / deeper >= 0.5, 0.8).when(common >= 1, 0.6).otherwise(0.4)


def strip_js_extension(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"\.(js|jsx|ts|tsx|mjs|cjs)$", "")


def test_stem(path: Column | str) -> Column:
    """The source stem that a test file's name points to; null if nothing is left."""
    stem = F.regexp_replace(basename(path), r"\..*$", "")
    stem = F.regexp_replace(stem, r"(_test|Test|_spec|Spec)$", "")
    stem = F.regexp_replace(stem, r"^(test_|Test)", "")
    return F.nullif(stem, F.lit(""))


def normal_path(path: Column | str) -> Column:
    """Forward slashes, without ``.`` parts and with ``..`` folded."""
    parts = F.filter(F.split(F.translate(_c(path), "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    zero = F.array().cast("array<string>")

    def fold(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(parts, zero, fold), "/")


def resolve_js(test_path: Column | str, module: Column | str) -> Column:
    """A relative module as a project path without extension; null for a module that is not relative."""
    m = _c(module)
    joined = strip_js_extension(normal_path(F.concat_ws("/", F.nullif(directory(test_path), F.lit("")), m)))
    return F.when(m.startswith("."), joined)


def suffix_keys(path: Column | str) -> Column:
    """All suffixes of a path in whole parts, without extension: the keys under which a module name may reach it."""
    bare = F.regexp_replace(F.regexp_replace(_c(path), r"\.\w+$", ""), r"/__init__$", "")
    parts = F.split(bare, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def module_key(module: Column | str) -> Column:
    """A dotted module as a path suffix."""
    return F.translate(_c(module), ".", "/")


def go_module_name(go_mod: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(go_mod), r"(?m)^\s*module\s+(\S+)", 1), F.lit(""))


def resolve_go(module_name: Column | str, imported: Column | str) -> Column:
    """The project directory of a Go import; null outside the module."""
    m, i = _c(module_name), _c(imported)
    return F.when(i == m, F.lit("")).when(i.startswith(F.concat(m, F.lit("/"))), F.substr(i, F.length(m) + 2))


def directoryish(token: Column | str) -> Column:
    return (_c(token) != "") & ~_c(token).rlike(r"[./]")


def eval_count(content: Column | str) -> Column:
    """Run-time code construction in JavaScript or TypeScript source."""
    return F.regexp_count(F.coalesce(_c(content), F.lit("")), F.lit(r"new\s+Function\s*\("))


def plugin_signals(content: Column | str) -> Column:
    """Four signs of code that is loaded by name at run time."""
    t = F.coalesce(_c(content), F.lit(""))
    return F.struct(*[t.rlike(p).alias(n) for n, p in PLUGIN_SIGNS.items()])


def shard_of(path: Column | str, shards: list[str]) -> Column:
    """The longest of ``shards`` (directory prefixes) that a path lies in; null if in none."""
    p, out = _c(path), F.lit(None).cast("string")
    for s in sorted({x.rstrip("/") for x in shards}, key=len):
        out = F.when((p == s) | p.startswith(s + "/"), F.lit(s)).otherwise(out)
    return out


def in_directory(path: Column | str, directory_name: str) -> Column:
    return _c(path).startswith(directory_name.rstrip("/") + "/")


def sha256(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)
