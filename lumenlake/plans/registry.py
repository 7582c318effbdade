"""A query module's own registry: name -> callable and, where SQL can express it, name -> oracle."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add
