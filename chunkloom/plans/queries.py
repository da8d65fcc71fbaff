"""What a module of queries registers: functions of (spark, sf_dir) by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registered:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
