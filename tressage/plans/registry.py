"""A module's queries: ``@Q.query(sql)`` over a function of (spark, folder)."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.registered: dict[str, tuple] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f):
            key = name or f.__name__
            if key in self.registered:
                raise ValueError(f"query {key} is defined twice")
            self.registered[key] = (f, sql)
            return f

        return add
