"""Registered queries: a Spark plan and, where SQL can say it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from featmart.plans import roles
from featmart.session import bound_tasks, tune

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def with_roles(body: str) -> str:
    """Put the role views that `body` mentions, and the ones those need, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in roles.SQL.items():
            if roles.mentions(text, name) and name not in needed:
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({roles.SQL[name]})" for name in needed)
    stripped = body.strip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {views},\n{stripped[5:]}"
    return f"WITH {views}\n{stripped}"


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under `name`; role views are added to `sql` automatically."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(plan)
        def tuned(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            bound_tasks(spark)
            return plan(spark, folder)

        PLANS[name] = tuned
        if sql is not None:
            SQL[name] = with_roles(sql)
        return plan

    return register
