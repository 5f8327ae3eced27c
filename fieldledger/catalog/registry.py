"""Named queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import VIEWS
from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `@view` in the SQL stands for the view's common table expression."""

    def add(fn):
        assert name not in QUERIES, name

        def run(spark: SparkSession, d: str) -> DataFrame:
            return fn(configure(spark), d)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = re.sub(r"@(\w+)", lambda m: VIEWS.get(m.group(1), m.group(0)), sql.strip())
        return run

    return add
