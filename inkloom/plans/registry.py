"""Registry that keeps each query beside the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_DEPENDENCIES, VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _with_views(names: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEW_DEPENDENCIES.get(name, ()):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in ordered]
    body = body.strip()
    recursive = ""
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            recursive = "RECURSIVE " if "RECURSIVE" in head else ""
            body = body[len(head):]
            return f"WITH {recursive}{', '.join(ctes + [body])}" if ctes else f"WITH {recursive}{body}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its checking SQL."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = _with_views(views, sql)
        return fn

    return wrap
