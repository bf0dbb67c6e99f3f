"""Command line: one subcommand for each query of a project, and ``run`` to record the outcome of a test command."""

from __future__ import annotations

import argparse
import inspect
import json
import os
import subprocess
import sys
import tempfile

from ripplemark.plans.describe import target
from ripplemark.plans.project import QUERIES, Project, storage_dir




def parser() -> argparse.ArgumentParser:
    """Arguments follow from the signature of each query: those without a default are positional."""
    out = argparse.ArgumentParser(prog="ripplemark")
    out.add_argument("--project-dir", default=".")
    out.add_argument("--storage-dir")
    out.add_argument("--json", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    for name in QUERIES:
        sub = commands.add_parser(name.replace("_", "-"), help=(inspect.getdoc(target(name)) or "").split("\n")[0])
        for p in list(inspect.signature(target(name)).parameters.values())[1:]:
            if p.kind is p.VAR_KEYWORD:
                continue
            text = str(p.annotation)
            kind = int if text.startswith("int") else str
            many = {"nargs": "+"} if text.startswith("list") else {}
            if p.default is p.empty:
                sub.add_argument(p.name, type=(lambda x: x.lower() in ("1", "true", "yes", "pass", "passed")) if text == "bool" else kind, **many)
            elif isinstance(p.default, bool):
                sub.add_argument(f"--{p.name.replace('_', '-')}", default=p.default, action=argparse.BooleanOptionalAction)
            else:
                sub.add_argument(f"--{p.name.replace('_', '-')}", default=p.default, type=kind, **many)
    run = commands.add_parser("run", help="runs a test command and records its results")
    run.add_argument("test_command", nargs=argparse.REMAINDER)
    return out


def framework_of(command: list[str]) -> str | None:
    """The framework of a test command, by the first word that names one."""
    names = {"pytest": "pytest", "py.test": "pytest", "jest": "jest", "go": "go", "cargo": "cargo"}
    return next((names[w] for w in (os.path.basename(c) for c in command) if w in names), None)


def augmented(command: list[str], framework: str | None, report: str) -> list[str]:
    """The command with what makes its output readable by machines."""
    if framework == "pytest" and not {"-v", "--verbose"} & set(command):
        return [*command, "-v"]
    if framework == "jest":
        return [*command, "--json", f"--outputFile={report}"]
    return command


def record_run(project: Project, command: list[str]) -> dict:
    from ripplemark.sources.files import results_of

    framework = framework_of(command)
    with tempfile.TemporaryDirectory() as folder:
        report = os.path.join(folder, "report.json")
        done = subprocess.run(augmented(command, framework, report), cwd=project.root, capture_output=True, text=True, check=False)
        lines = project.spark.createDataFrame([(x,) for x in done.stdout.splitlines() or [""]], "value string")
        found = results_of(project.spark, framework or "", lines, report if os.path.exists(report) else None, project.root)
        n = 0 if found is None else found.count()
        if n:
            project.store.append("test_results", found)
    return {"exit_code": done.returncode, "framework": framework, "recorded": n}


def main(argv: list[str] | None = None, spark=None) -> int:
    args = vars(parser().parse_args(argv))
    command, as_json = args.pop("command").replace("-", "_"), args.pop("json")
    root, folder = os.path.abspath(args.pop("project_dir")), args.pop("storage_dir")
    if spark is None:
        from ripplemark.session import local_session

        spark = local_session()
    project = Project(spark, root, storage_dir(root, folder))
    if command == "run":
        out = {"result": record_run(project, args["test_command"])}
    else:
        out = project.call(command, **args)
    if as_json:
        print(json.dumps(out, default=str))
    else:
        result = out["result"]
        for row in result if isinstance(result, list) else result.items():
            print("  ".join(f"{k}={v}" for k, v in row.items()) if isinstance(row, dict) else f"{row[0]}: {row[1]}")
    failed = isinstance(out["result"], dict) and out["result"].get("status") in ("error", "git_error")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
