"""What modules of queries share."""

from __future__ import annotations

from cuelake.sources.views import with_views


class Registry:
    """Collects a module's queries and the SQL they are compared with."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, names: str = "", sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = with_views(names, sql)
            return f

        return keep
