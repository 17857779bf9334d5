"""A query list of one area: ``register(name, sql)`` as decorator."""

from __future__ import annotations

from collections.abc import Callable


class Area:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(function: Callable) -> Callable:
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function
        return keep
