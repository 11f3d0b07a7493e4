"""Queries by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, duck_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", ctes: str = "") -> Callable:
    """Register a function of :class:`Views`. ``sql`` may use the views named in ``views``
    and further common table expressions ``ctes``."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            head = duck_with(*views.split()) if views else ""
            if sql.startswith("WITH RECURSIVE"):
                # the views stand where the statement names them
                ORACLES[name] = sql.replace("{line_item}", head.removeprefix("WITH ").strip())
                return f
            if ctes:
                head = f"{head},\n{ctes}" if head else f"WITH {ctes}"
            ORACLES[name] = f"{head}\n{sql}"
        return f

    return register


#: Largest-remainder allocation in SQL: parts of |total| by integer weight w within g,
#: ties by person.
def allocate_sql(source: str, group: str, extra: str = "", total: str = "total", w: str = "w", tie: str = "person_id") -> str:
    return f"""
SELECT {group}, {tie}{extra}, sign(total) * (base + CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY rem DESC, {tie}) <= abs(total) - sum(base) OVER (PARTITION BY {group}) THEN 1 ELSE 0 END) AS share
FROM (SELECT *, abs(total)::HUGEINT * w // nullif(sw, 0) AS base, abs(total)::HUGEINT * w % nullif(sw, 0) AS rem FROM (SELECT *, sum(w) OVER (PARTITION BY {group})::HUGEINT AS sw FROM ({source}) a0) a1) a2"""


#: n / d half-even, for n >= 0.
def half_even_sql(n: str, d: str) -> str:
    return f"(({n})::HUGEINT // ({d})::HUGEINT + CASE WHEN 2 * (({n})::HUGEINT % ({d})::HUGEINT) > ({d}) OR (2 * (({n})::HUGEINT % ({d})::HUGEINT) = ({d}) AND (({n})::HUGEINT // ({d})::HUGEINT) % 2 = 1) THEN 1 ELSE 0 END)"
