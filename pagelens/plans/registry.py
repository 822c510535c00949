"""All queries of the library, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ["requests", "demand", "content", "facts", "serving", "pages", "readability", "page_facts", "page_scores", "signed", "bodies"]


def _entries() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        out.update(import_module(f"pagelens.plans.{name}").QUERIES)
    return out


def queries() -> dict:
    return {name: entry[0] for name, entry in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for name, entry in _entries().items() if entry[1]}
