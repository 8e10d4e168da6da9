"""Query registry: a Spark plan over a data folder and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.sources.market_views import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(market)``. ``views`` names the market views the SQL text reads."""

    def add(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Market(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return add


def with_views(sql: str, views: str) -> str:
    from tapeloom.plans.view_sql import VIEWS

    wanted: list[str] = []

    def need(v: str) -> None:
        deps, _ = VIEWS[v]
        for d in deps:
            need(d)
        if v not in wanted:
            wanted.append(v)

    for v in views.split():
        need(v)
    ctes = [f"{v} as ({VIEWS[v][1].strip()})" for v in wanted]
    body = sql.strip()
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            return opening + ",\n".join([*ctes, body[len(opening):]])
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
