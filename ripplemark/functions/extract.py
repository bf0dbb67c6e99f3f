"""Table functions over source text: code units and dependencies, by language, with a registry for other extractors.

Source text is read by a table function (one row in, many rows out), as block ends need a scan that keeps state.  The
extractor registry is a plain dict that travels to the executors with the function.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.scalars import LANGUAGES

Unit = tuple[str, str, int, int]  # name, unit type, first and last line
UNIT_SCHEMA = "name string, unit_type string, line_start int, line_end int"
DEP_SCHEMA = "name string, dep_type string, module_path string, require_type string, confidence double, taint_source string"
_DEP_NAMES = [x.split()[0] for x in DEP_SCHEMA.split(", ")]

_unit_extractors: dict[str, Callable[[str, str], Iterable[Unit]]] = {}
_dep_extractors: dict[str, Callable[[str], Iterable[dict]]] = {}


def register_unit_extractor(language: str, extractor: Callable[[str, str], Iterable[Unit]]) -> None:
    """Takes the place of the built-in extractor of a language: ``extractor(path, content)`` gives units."""
    if not callable(extractor):
        raise TypeError("an extractor is a function")
    _unit_extractors[language] = extractor


def unregister_unit_extractor(language: str) -> None:
    del _unit_extractors[language]


def unit_extractors() -> dict:
    return dict(_unit_extractors)


def register_dep_extractor(language: str, extractor: Callable[[str], Iterable[dict]]) -> None:
    if not callable(extractor):
        raise TypeError("an extractor is a function")
    _dep_extractors[language] = extractor


def unregister_dep_extractor(language: str) -> None:
    del _dep_extractors[language]


def dep_extractors() -> dict:
    return dict(_dep_extractors)


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


# --- block ends --------------------------------------------------------------------------------------------------

_NOISE = re.compile(r"""//.*|/\*.*?(?:\*/|$)|"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$)""")


def bare_lines(lines: list[str]) -> list[str]:
    """Lines without strings and comments; a block comment may span lines."""
    out, inside = [], False
    for line in lines:
        if inside:
            closed = line.find("*/")
            if closed < 0:
                out.append("")
                continue
            line, inside = line[closed + 2 :], False

        def gone(m: re.Match) -> str:
            nonlocal inside
            if m.group().startswith("/*") and not m.group().endswith("*/"):
                inside = True
            return " "

        out.append(_NOISE.sub(gone, line))
    return out


def brace_end(bare: list[str], start: int) -> int:
    """The 1-based last line of the block that opens at or after line ``start`` (0-based); the line itself if none does."""
    depth, opened = 0, False
    for i in range(start, len(bare)):
        for c in bare[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i + 1
            elif c == ";" and not opened and depth == 0:
                return i + 1
        if not opened and i > start + 5:
            return start + 1
    return len(bare) if opened else start + 1


def indent_end(lines: list[str], start: int, indent: int) -> int:
    """The last line before one that is indented no deeper."""
    last = start
    for i in range(start + 1, len(lines)):
        if lines[i].strip():
            if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                break
            last = i
    return last + 1


def keyword_end(lines: list[str], start: int, indent: int) -> int:
    """The line of the ``end`` at the indentation of the opening line."""
    for i in range(start + 1, len(lines)):
        if re.match(r"\s*end\b", lines[i]) and len(lines[i]) - len(lines[i].lstrip()) <= indent:
            return i + 1
    return len(lines)


# --- code units --------------------------------------------------------------------------------------------------

_ID = r"(?P<name>[A-Za-z_$][\w$]*)"
_ANNOTATED = r"(?:@\w+(?:\([^)]*\))?\s*)*"
_ATTRIBUTED = r"(?:\[[^\]]*\]\s*)*"
_TYPE = r"[A-Za-z_][\w.:]*(?:<[^()]*>)?(?:\[\])*[?*&]*\s+"


def _words(text: str) -> str:
    return "(?:(?:" + "|".join(text.split()) + r")\s+)*"


#: What each language's grammar allows before a declaration, in alphabetical order.
MODIFIERS: dict[str, str] = {
    "javascript": "abstract async declare default export static",
    "rust": "async const default unsafe",
    "csharp": "abstract async const event extern file fixed internal new override partial private protected public readonly ref required sealed static unsafe virtual volatile",
    "java": "abstract default final native non-sealed private protected public sealed static strictfp synchronized transient volatile",
    "cpp": "consteval constexpr constinit explicit extern friend inline mutable register static thread_local virtual volatile",
    "kotlin": "abstract actual annotation companion const crossinline data enum expect external final fun infix inline inner internal lateinit noinline open operator out override private protected public sealed suspend tailrec value vararg",
    "swift": "borrowing class consuming convenience distributed dynamic fileprivate final indirect infix internal lazy mutating nonisolated nonmutating open optional override package postfix prefix private public required static unowned weak",
    "php": "abstract final private protected public readonly static",
    "dart": "abstract augment base covariant external final interface late sealed static",
}
#: Words that start a statement which reads like a declaration with a type.
STATEMENTS = "assert await case delete do else goto if new return switch throw typedef using while yield"
_NO_STATEMENT = "(?!(?:" + "|".join(STATEMENTS.split()) + r")\b)"
_TEMPLATE = r"(?:template\s*<[^>]*>\s*)?"


def _line(language: str, rest: str, before: str = "", kind: str | None = None) -> tuple[re.Pattern, str | None]:
    """The pattern of a declaration: what may come before it, its modifiers, and the declaration itself."""
    mods = _words(MODIFIERS[language]) if language in MODIFIERS else ""
    return re.compile(rf"\s*{before}{mods}{rest}"), kind


def _kinds(text: str) -> str:
    return "(?P<kind>" + "|".join(text.split()) + ")"


#: For each brace language ordered line patterns; the kind is a group of the match or a constant.
BRACE: dict[str, list[tuple[re.Pattern, str | None]]] = {
    "javascript": [
        _line("javascript", rf"function\s*\*?\s*{_ID}\s*\(", kind="function"),
        _line("javascript", rf"class\s+{_ID}", kind="class"),
        _line("javascript", rf"(?:const|let|var)\s+{_ID}\s*=\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*=>", kind="function"),
        _line("", r"""describe(?:\.\w+)?\s*\(\s*(?P<q>['"`])(?P<name>.*?)(?P=q)""", kind="test_suite"),
        _line("", r"""(?:it|test)(?:\.\w+)?\s*\(\s*(?P<q>['"`])(?P<name>.*?)(?P=q)""", kind="test_case"),
    ],
    "go": [
        _line("", rf"func\s+(?:\([^)]*\)\s*)?{_ID}\s*[(\[]", kind="function"),
        _line("", rf"type\s+{_ID}(?:\[[^\]]*\])?\s+{_kinds('interface struct')}\b"),
    ],
    "rust": [
        _line("rust", rf"(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+{_ID}\s*[<(]", r"(?:pub(?:\([^)]*\))?\s+)?", "function"),
        _line("", rf"{_kinds('enum struct')}\s+{_ID}", r"(?:pub(?:\([^)]*\))?\s+)?"),
        _line("rust", r"impl\b(?:\s*<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(?P<name>[A-Za-z_]\w*(?:<[^>]*>)?)", kind="impl"),
    ],
    "csharp": [
        _line("csharp", rf"{_kinds('class enum interface record struct')}\s+(?:(?:class|struct)\s+)?{_ID}", _ATTRIBUTED),
        _line("csharp", rf"{_NO_STATEMENT}{_TYPE}{_ID}\s*[<(]", _ATTRIBUTED, "function"),
    ],
    "java": [
        _line("java", rf"{_kinds('class enum interface record')}\s+{_ID}", _ANNOTATED),
        _line("java", rf"{_NO_STATEMENT}{_TYPE}{_ID}\s*\(", _ANNOTATED, "function"),
    ],
    "cpp": [
        _line("", rf"enum\s+(?:(?:class|struct)\s+)?{_ID}", _TEMPLATE, "enum"),
        _line("", rf"(?:inline\s+)?{_kinds('class namespace struct')}\s+{_ID}", _TEMPLATE),
        _line("cpp", rf"{_NO_STATEMENT}{_TYPE}(?P<name>~?[A-Za-z_]\w*(?:::~?[A-Za-z_]\w*)?)\s*\(", _TEMPLATE, "function"),
    ],
    "kotlin": [
        _line("kotlin", rf"{_kinds('class interface object')}\s+{_ID}", _ANNOTATED),
        _line("kotlin", rf"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?{_ID}\s*[<(]", _ANNOTATED, "function"),
    ],
    "swift": [
        _line("swift", rf"func\s+{_ID}\s*[<(]", _ANNOTATED, "function"),
        _line("swift", rf"{_kinds('actor class enum protocol struct')}\s+{_ID}", _ANNOTATED),
    ],
    "php": [
        _line("php", rf"{_kinds('class enum interface trait')}\s+{_ID}"),
        _line("php", rf"function\s+&?{_ID}\s*\(", kind="function"),
    ],
    "dart": [
        _line("dart", rf"{_kinds('class extension mixin')}\s+{_ID}"),
        _line("dart", rf"{_NO_STATEMENT}(?!for\b)(?:factory\s+|{_TYPE})(?:(?:get|set)\s+)?{_ID}\s*(?:\(|=>|\{{)", kind="function"),
    ],
}
BRACE["typescript"], BRACE["c"] = BRACE["javascript"], BRACE["cpp"]
_NOT_NAMES = frozenset("if for while switch catch return else do try sizeof".split())


def _brace_units(content: str, patterns) -> list[Unit]:
    lines = content.split("\n")
    bare = bare_lines(lines)
    out = []
    for i, line in enumerate(lines):
        if not bare[i].strip():
            continue
        for pattern, kind in patterns:
            m = pattern.match(line)
            if m and m["name"] not in _NOT_NAMES:
                out.append((m["name"], kind or m["kind"], i + 1, brace_end(bare, i)))
                break
    return out


def _python_units(content: str) -> list[Unit]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(content)
    out: list[Unit] = []

    def visit(node: ast.AST, owner: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                out.append((x.name, "class", x.lineno, x.end_lineno or x.lineno))
                visit(x, f"{x.name}.")
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "async_function" if isinstance(x, ast.AsyncFunctionDef) else "function"
                out.append((owner + x.name, kind, x.lineno, x.end_lineno or x.lineno))
                visit(x, "")
            else:
                visit(x, owner)

    visit(tree, "")
    return sorted(out, key=lambda u: (u[2], -u[3]))


_PY_LINE = re.compile(r"(?P<indent>\s*)(?P<kind>async\s+def|def|class)\s+(?P<name>[A-Za-z_]\w*)\s*[(:\[]")


def _python_lines(content: str) -> list[Unit]:
    lines, owners, out = content.split("\n"), [], []
    for i, line in enumerate(lines):
        m = _PY_LINE.match(line)
        if m:
            indent = len(m["indent"])
            owners = [o for o in owners if o[0] < indent]
            kind = {"class": "class", "def": "function"}.get(m["kind"], "async_function")
            name = m["name"] if kind == "class" or not owners else f"{owners[-1][1]}.{m['name']}"
            out.append((name, kind, i + 1, indent_end(lines, i, indent)))
            if kind == "class":
                owners.append((indent, m["name"]))
    return out


_RUBY_LINE = re.compile(r"(?P<indent>\s*)(?P<kind>class|module|def)\s+(?:self\.)?(?P<name>[A-Za-z_]\w*(?:::\w+)*[?!=]?)")


def _ruby_units(content: str) -> list[Unit]:
    lines, out = content.split("\n"), []
    for i, line in enumerate(lines):
        m = _RUBY_LINE.match(line)
        if m:
            out.append((m["name"], "function" if m["kind"] == "def" else m["kind"], i + 1, keyword_end(lines, i, len(m["indent"]))))
    return out


def code_units_of(path: str, content: str, custom: dict | None = None) -> list[Unit]:
    """The units of one file; a registered extractor goes before the built-in one.  Unknown languages have none."""
    language = language_of(path)
    own = (_unit_extractors if custom is None else custom).get(language)
    if own:
        return list(own(path, content))
    if language == "python":
        return _python_units(content)
    if language == "ruby":
        return _ruby_units(content)
    return _brace_units(content, BRACE[language]) if language in BRACE else []


# --- dependencies ------------------------------------------------------------------------------------------------

# How sure a way of loading a module is.
CONFIDENCE = {"static": 1.0, "tainted": 1.0, "template": 0.4, "variable": 0.3, "conditional": 0.3, "concat": 0.2, "path_join": 0.2, "eval": 0.0}

# Fixed word lists: what looks like a call but is none that matters.
PYTHON_WORDS = frozenset("if for while with return print class def import from raise assert del yield lambda elif except async await not and or in is pass break continue try finally global nonlocal".split())
JS_WORDS = frozenset("if for while switch import require describe it test expect beforeEach afterEach beforeAll afterAll".split())


def _dep(name: str, dep_type: str = "import", module: str | None = None, how: str | None = None, taint: str | None = None) -> dict:
    confidence = CONFIDENCE["tainted"] if taint else CONFIDENCE.get(how) if how else None
    return {"name": name, "dep_type": dep_type, "module_path": module, "require_type": how, "confidence": confidence, "taint_source": taint}


def deduped(deps: Iterable[dict]) -> list[dict]:
    """The first of each name and type, or the first of them that has a module."""
    out: dict[tuple, dict] = {}
    for d in deps:
        key = (d["name"], d["dep_type"])
        if key not in out or (not out[key].get("module_path") and d.get("module_path")):
            out[key] = d
    return list(out.values())


def _python_deps(content: str) -> Iterable[dict]:
    try:
        nodes = list(ast.walk(ast.parse(content)))
    except (SyntaxError, ValueError, RecursionError):
        for m in re.finditer(r"^(?:from\s+(\S+)\s+)?import\s+(\w+)", content, re.M):
            yield _dep(m[2], module=m[1] or m[2])
        yield from (_dep(n, "call") for n in re.findall(r"(\w+)\s*\(", content) if n not in PYTHON_WORDS)
        return
    for x in nodes:
        if isinstance(x, ast.Import):
            yield from (_dep(a.name.rsplit(".", 1)[-1], module=a.name) for a in x.names)
        elif isinstance(x, ast.ImportFrom) and x.module:
            yield from (_dep(a.name, module=x.module) for a in x.names)
        elif isinstance(x, ast.Call):
            name = getattr(x.func, "id", None) or getattr(x.func, "attr", None)
            if name:
                yield _dep(name, "call")


_JS_FROM = re.compile(r"""\bimport\s+(?P<what>[^;'"()]*?)\bfrom\s*(?P<q>['"])(?P<module>.*?)(?P=q)""")
_JS_CALLED = re.compile(r"\b(require|import)\s*\(")
_JS_TAKEN = re.compile(r"\b(?:const|let|var)\s+(\w+|\{[^}]*\})\s*=\s*(?:await\s+)?$")
_JS_ASSIGNED = re.compile(r"""(?:\b(const|let|var)\s+)?(?<![\w$.])([A-Za-z_$][\w$]*)\s*=\s*(['"])(.+?)\3""")
_JS_TOKEN = re.compile(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\S""")
_SKIPPED_ARGUMENT = 2000


def _argument(content: str, at: int) -> list[str]:
    """The tokens from ``at`` up to the bracket that closes the call; none if it is not closed soon."""
    depth, out = 1, []
    for m in _JS_TOKEN.finditer(content, at, at + _SKIPPED_ARGUMENT):
        t = m.group()
        depth += (t == "(") - (t == ")")
        if not depth:
            return out
        out.append(t)
    return []


def _way(tokens: list[str]) -> tuple[str | None, str | None]:
    """How an argument names a module, and the module as far as it is written out."""
    text = [t[1:-1] if t[0] in "'\"" and len(t) > 1 else None for t in tokens]
    if not tokens:
        return None, None
    if len(tokens) == 1:
        if text[0] is not None:
            return "literal", text[0]
        return ("template", tokens[0][1:-1]) if tokens[0][0] == "`" else ("variable", tokens[0]) if re.match(r"[A-Za-z_$]", tokens[0]) else (None, None)
    if text[0] is not None and tokens[1] == "+":
        return "concat", text[0]
    if tokens[:4] == ["path", ".", "join", "("] and len(tokens) > 6 and tokens[4] in ("__dirname", "__filename") and text[6]:
        return "path_join", text[6]
    if "?" in tokens:
        k = tokens.index("?")
        if len(tokens) > k + 3 and tokens[k + 2] == ":" and text[k + 1] and text[k + 3]:
            return "conditional", f"{text[k + 1]}|{text[k + 3]}"
    return None, None


def _bound_names(what: str | None) -> list[str]:
    """The names that an import clause takes from its module."""
    out = []
    for group in re.findall(r"\{([^}]*)\}", what or ""):
        out += [re.split(r"\s+as\s+|:", n.strip())[0].strip() for n in group.split(",")]
    rest = re.sub(r"\{[^}]*\}", "", what or "")
    out += [n.strip() for n in rest.split(",") if re.fullmatch(r"\s*\w+\s*", n)]
    return [n for n in out if n]


def _js_deps(content: str) -> Iterable[dict]:
    """One walk over the calls that load modules, each read by the shape of its argument; then run-time code and calls."""
    known: dict[str, str] = {}
    for declared, name, _, module in _JS_ASSIGNED.findall(content):
        if declared or name not in known:
            known[name] = module
    loads = [(m.start(), m["module"], m["what"]) for m in _JS_FROM.finditer(content)]
    soft = []
    for m in _JS_CALLED.finditer(content):
        how, module = _way(_argument(content, m.end()))
        if how == "literal" and m[1] == "require":
            taken = _JS_TAKEN.search(content, max(0, m.start() - 500), m.start())
            loads.append((m.start(), module, taken[1] if taken else None))
        elif how == "literal":
            soft.append(_dep(f"import({module})", "dynamic_import", module))
        elif how and m[1] == "require":
            soft += _js_soft(how, module, known)
    for _, module, what in sorted(loads, key=lambda x: x[0]):
        yield _dep(module.rsplit("/", 1)[-1].split(".")[0], module=module)
        yield from (_dep(n, module=module) for n in _bound_names(what))
    yield from soft
    yield from (_dep("new Function(...)", "eval_import", None, "eval") for _ in re.findall(r"\bnew\s+Function\s*\(", content))
    yield from (_dep(n, "call") for n in re.findall(r"(\w+)\s*\(", content) if n not in JS_WORDS)


def _js_soft(how: str, module: str, known: dict[str, str]) -> Iterable[dict]:
    """A module that is not written out in the call; a variable with a known text is as good as that text."""
    if how == "variable":
        if module in known:
            yield _dep(f"require({module})", "tainted_import", known[module], how, f"{module}={known[module]}")
        elif module not in JS_WORDS:
            yield _dep(f"require({module})", "dynamic_import", module, how)
        return
    shown = {"template": "`{0}`", "concat": "'{0}' + ...", "conditional": "cond ? '{1}' : '{2}'", "path_join": "path.join(__dirname, '{0}', ...)"}[how]
    yield _dep(f"require({shown.format(module, *module.split('|'))})", "dynamic_import", module, how)


def _last(text: str, mark: str) -> str:
    return text.rsplit(mark, 1)[-1]


def _go_deps(content: str) -> Iterable[dict]:
    blocks = re.findall(r"import\s*\((.*?)\)", content, re.S)
    paths = [p for b in blocks for p in re.findall(r'"([^"]+)"', b)] + re.findall(r'^import\s+(?:\w+\s+)?"([^"]+)"', content, re.M)
    yield from (_dep(_last(p, "/"), module=p) for p in paths)


def _rust_deps(content: str) -> Iterable[dict]:
    for path in re.findall(r"\buse\s+([^;]+);", content):
        head, _, group = path.partition("{")
        names = group.rstrip("} \n").split(",") if group else [_last(path, "::")]
        module = head.strip().rstrip(":") if group else path.rpartition("::")[0] or path
        yield from (_dep(re.split(r"\s+as\s+", n.strip())[0], module=module.replace("::", ".").strip()) for n in names if n.strip() and n.strip() != "self")


def _by_pattern(pattern: str, mark: str, flags: int = re.M, strip: str = ""):
    def run(content: str) -> Iterable[dict]:
        for m in re.findall(pattern, content, flags):
            name = re.sub(strip, "", _last(m, mark)) if strip else _last(m, mark)
            if name and name != "*":
                yield _dep(name, module=m)

    return run


DEPS: dict[str, Callable[[str], Iterable[dict]]] = {
    "python": _python_deps,
    "javascript": _js_deps,
    "typescript": _js_deps,
    "go": _go_deps,
    "rust": _rust_deps,
    "csharp": _by_pattern(r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", "."),
    "java": _by_pattern(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;?", "."),
    "kotlin": _by_pattern(r"^\s*import\s+([\w.*]+)", "."),
    "c": _by_pattern(r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""", "/", strip=r"\.\w+$"),
    "cpp": _by_pattern(r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""", "/", strip=r"\.\w+$"),
    "swift": _by_pattern(r"^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+)?([\w.]+)", "."),
    "php": lambda c: [*_by_pattern(r"^\s*use\s+([\w\\]+)", "\\")(c), *_by_pattern(r"""(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""", "/", strip=r"\.\w+$")(c)],
    "ruby": _by_pattern(r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]""", "/"),
    "dart": _by_pattern(r"""^\s*import\s+['"]([^'"]+)['"]""", "/", strip=r"\.\w+$"),
}


def dependencies_of(path: str, content: str, custom: dict | None = None) -> list[dict]:
    language = language_of(path)
    own = (_dep_extractors if custom is None else custom).get(language) or DEPS.get(language)
    return deduped({n: d.get(n) for n in _DEP_NAMES} for d in own(content)) if own else []


# --- as table functions ------------------------------------------------------------------------------------------


def code_units(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``files`` (``file_path, content``) to code units with an id of path, name and type.  Null content has none.

    ``keep``: columns of the files that their units have too.
    """
    custom = unit_extractors()

    def run(batches):
        for batch in batches:
            rows = [(i, p, *u) for i, (p, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if p is not None for u in code_units_of(p, c or "", custom)]
            place, *cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            kept = [batch.column(2 + i).take(pa.array(place, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), *kept], names=["file_path", "name", "unit_type", "line_start", "line_end", *keep])

    files = files.select("file_path", "content", *keep)
    more = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)
    units = files.mapInArrow(run, f"file_path string, {UNIT_SCHEMA}{more}")
    return units.select(F.concat_ws(":", "file_path", "name", "unit_type").alias("id"), "*")


def dependencies(files: DataFrame) -> DataFrame:
    """``files`` to dependencies."""
    custom = dep_extractors()

    def run(batches):
        for batch in batches:
            rows = [(p, d) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p is not None for d in dependencies_of(p, c or "", custom)]
            kinds = {n: pa.float64() if n == "confidence" else pa.string() for n in _DEP_NAMES}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), *(pa.array([d[n] for _, d in rows], k) for n, k in kinds.items())], names=["file_path", *_DEP_NAMES])

    return files.select("file_path", "content").mapInArrow(run, f"file_path string, {DEP_SCHEMA}")


# The annotations that mark a function as a test, where a name alone does not.
TEST_MARKS = {
    "rust": "test tokio::test rstest",
    "junit": "Test ParameterizedTest RepeatedTest",
    "xctest": "Test",
    "csharp_test": "Fact Theory Test TestMethod",
}
#: How a language writes an annotation: before its name, behind its name and arguments, and any other one.
ANNOTATIONS = {"rust": (r"#\[", r"\]", None), "csharp_test": (r"\[", r"\]", r"\[[^\]]*\]")}
AT_SIGN = ("@", "", r"@\w+(\s*\([^)]*\))?")


def _declared(close: str, other: str | None):
    """From text behind an annotation's name to the name that it declares: the last word before the first bracket, if only words stand before it."""
    ended = rf"^\s*(\([^)]*\))?{close}"

    def name(after):
        head = F.regexp_replace(after, ended, " ")
        head = F.regexp_replace(head, other, " ") if other else head
        head = F.substring_index(F.regexp_replace(head, "<[^<>]*>", " "), "(", 1)
        head = F.regexp_replace(head, r"[\[\]?.,<>]", " ")
        return F.when(after.rlike(ended) & head.rlike(r"^[\w\s]+$"), F.regexp_extract(head, r"([A-Za-z_]\w*)\s*$", 1)).otherwise("")

    return name


def marked_names(content, framework):
    """The names that annotations mark as tests, as a column."""
    out = F.array().cast("array<string>")
    for name, marks in TEST_MARKS.items():
        start, close, other = ANNOTATIONS.get(name, AT_SIGN)
        after = F.split(content, rf"{start}(?:{'|'.join(marks.split())})\b")
        behind = F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0)))
        found = F.array_remove(F.transform(behind, _declared(close, other)), "")
        out = F.when(framework == name, found).otherwise(out)
    return out


def test_units(files: DataFrame) -> DataFrame:
    """The tests among the code units of test files, with their framework.

    Files are dealt out by path first: a few small splits may hold very many of them, and all their units would be one task's.
    """
    from ripplemark.functions.scalars import is_test_name, test_framework

    content = F.coalesce("content", F.lit(""))
    own = files.withColumn("framework", test_framework("file_path", F.col("content"))).where(F.col("framework").isNotNull())
    own = own.repartition("file_path").withColumn("marked", marked_names(content, F.col("framework")))
    units = code_units(own, ("framework", "marked")).drop("id")
    last = F.element_at(F.split("name", r"\."), -1)
    units = units.where(F.col("unit_type").isin("test_suite", "test_case") | F.array_contains("marked", last) | is_test_name("name", "framework"))
    return units.select(F.concat_ws(":", "file_path", "name").alias("id"), "file_path", "name", "framework", "line_start", "line_end").dropDuplicates(["id"])
