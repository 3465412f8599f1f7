"""Where the library's queries are registered, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.views import VIEWS, frames, sql_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*views: str, sql: str | None = None):
    """Register f(*frames of the views) under its name, with the SQL over the same views."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*frames(spark, sf_dir, *views))

        QUERIES[f.__name__] = run
        if sql:
            own = [v for v in views if v in VIEWS]
            text = sql.strip().replace("AS string)", "AS VARCHAR)")
            if own:
                text = f"{sql_prefix(*own)}{', ' + text[5:] if text.startswith('WITH ') else ' ' + text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return add
