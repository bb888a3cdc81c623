"""Registry of named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tallyscope.plans.views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the named canonical views."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _with_views(sql.strip(), views)
        return fn

    return register


def _with_views(sql: str, views: Sequence[str]) -> str:
    needed: list[str] = []

    def add(view: str) -> None:
        text, deps = SQL_VIEWS[view]
        for dep in deps:
            add(dep)
        if view not in needed:
            needed.append(view)

    for view in views:
        add(view)
    if not needed:
        return sql
    head = ", ".join(f"{v} AS ({SQL_VIEWS[v][0].strip()})" for v in needed)
    if sql.lower().startswith("with "):
        return f"WITH {head}, {sql[5:]}"
    return f"WITH {head} {sql}"
