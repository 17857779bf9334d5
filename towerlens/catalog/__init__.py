"""Registered queries over the given tables and, where SQL can say it, their SQL text."""

from __future__ import annotations

import importlib

AREAS = ("cleaning", "sequences", "grids", "around_outages", "summaries", "evaluation", "audits", "tables", "models")


def load() -> tuple[dict, dict]:
    found: dict = {}
    sql: dict = {}
    for area in AREAS:
        module = importlib.import_module(f"towerlens.catalog.{area}")
        found.update(module.QUERIES)
        sql.update(module.SQL)
    return found, sql
