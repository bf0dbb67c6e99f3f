"""The queries of a project as JSON schemas, made from their signatures."""

from __future__ import annotations

import inspect

from ripplemark.operators.control import Jobs, Locks
from ripplemark.plans.project import QUERIES, Project

_OTHERS = {"acquire_file_lock": Locks.acquire, "release_file_lock": Locks.release, "refresh_file_lock": Locks.refresh, "check_file_lock": Locks.check, "check_locks": Locks.check_many, "list_file_locks": Locks.list, "job_status": Jobs.status, "cancel_job": Jobs.cancel}
#: The largest limit that front ends take; without a limit answers are whole.
MOST = 1000
_KINDS = {"int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object"}


def target(name: str):
    """The function behind a query."""
    return _OTHERS.get(name) or getattr(Project, name)


def schema(name: str) -> dict:
    """Name, description and parameters of a query; those without a default are required, and a limit that is given has its bound."""
    properties, required = {}, []
    for p in list(inspect.signature(target(name)).parameters.values())[1:]:
        if p.kind is p.VAR_KEYWORD or p.name == "step":
            continue
        text = str(p.annotation)
        kind = _KINDS.get(text.split("[")[0].split(" ")[0], "string")
        properties[p.name] = {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {})
        if p.name == "limit":
            properties[p.name] |= {"minimum": 1, "maximum": MOST}
        if p.default is p.empty:
            required.append(p.name)
        elif p.default is not None:
            properties[p.name]["default"] = p.default
    return {"name": name, "description": (inspect.getdoc(target(name)) or name).split("\n")[0], "parameters": {"type": "object", "properties": properties, "required": required}}


def schemas() -> list[dict]:
    return [schema(n) for n in QUERIES]
