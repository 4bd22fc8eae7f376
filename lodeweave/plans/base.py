"""A module's queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodeweave.sources.catalog_views import SQL


class Registry:
    """Queries by the name of their function. A check is written after the catalog's table expressions, unless ``views`` is false."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[..., DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, *, views: bool = True):
        def add(f):
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracles[f.__name__] = f"WITH RECURSIVE {SQL.strip()}{oracle}" if views else oracle
            return f

        return add
