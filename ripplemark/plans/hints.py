"""What to ask next, by the result of a query."""

from __future__ import annotations

from collections.abc import Callable

_RULES: dict[str, Callable[[object], list[tuple[str, str]]]] = {}


def _rule(*names: str):
    def keep(f):
        _RULES.update(dict.fromkeys(names, f))
        return f

    return keep


@_rule("analyze", "update")
def _built(result) -> list[tuple[str, str]]:
    return [("risk_map", "see where risk is concentrated"), ("test_gaps", "see what has no test")]


@_rule("risk_map")
def _risks(result) -> list[tuple[str, str]]:
    files = result.get("files", [])
    out = [("suggest_tests", f"tests for {files[0]['file_path']}"), ("ownership", f"who wrote {files[0]['file_path']}")] if files else []
    if result.get("_meta", {}).get("uniform_components"):
        out.append(("stats", "see which data is missing"))
    return out


@_rule("impact", "diff_impact")
def _impacted(result) -> list[tuple[str, str]]:
    return [("record_result", "record the outcome of the tests")] if result else [("test_gaps", "the change has no test"), ("suggest_tests", "find tests by name")]


@_rule("suggest_tests")
def _suggested(result) -> list[tuple[str, str]]:
    return [("record_result", "record the outcome of the tests")] if result else [("test_gaps", "no test is near this file")]


@_rule("test_gaps")
def _gaps(result) -> list[tuple[str, str]]:
    return [("churn", f"how often {result[0]['file_path']} changes")] if result else []


@_rule("stale_tests")
def _stale(result) -> list[tuple[str, str]]:
    return [("update", "refresh edges after removing stale tests")] if result else []


@_rule("triage")
def _triage(result) -> list[tuple[str, str]]:
    return [("suggest_tests", "tests for the riskiest files"), ("who_reviews", "who should look at them")]


@_rule("churn", "history")
def _churned(result) -> list[tuple[str, str]]:
    return [("coupling", "what changes together with it")] if result else [("analyze", "there is no history yet")]


@_rule("coupling")
def _coupled(result) -> list[tuple[str, str]]:
    return [("impact", "tests that its partners share")] if result.get("co_change_partners") else [("stats", "see the threshold for coupling")]


@_rule("ownership", "who_reviews")
def _owned(result) -> list[tuple[str, str]]:
    return [("history", "see its commits")] if result else []


@_rule("stats")
def _stats(result) -> list[tuple[str, str]]:
    return [("analyze", "all tables are empty")] if not any(v for v in result.values() if isinstance(v, int)) else []


@_rule("record_result")
def _recorded(result) -> list[tuple[str, str]]:
    return [("risk_map", "scores take instability into account")]


@_rule("start_job", "job_status")
def _job(result) -> list[tuple[str, str]]:
    return [("job_status", "follow the job")] if result.get("status") == "running" else []


def next_steps(query: str, result) -> list[dict]:
    """Suggested queries with a reason; none for unknown queries or failed ones."""
    if isinstance(result, dict) and result.get("status") in ("error", "git_error", "no_data"):
        return [{"query": "analyze", "reason": "there is no data yet"}] if result["status"] == "no_data" else []
    return [{"query": q, "reason": r} for q, r in _RULES.get(query, lambda _: [])(result)]
