"""Registry of queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is its independent check."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(views.Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return deco


def with_views(sql: str) -> str:
    """Prefix the stand-in view definitions that ``sql`` mentions as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for v in re.findall(r"\bv_\w+\b", text):
            if v in views.VIEW_SQL and v not in needed:
                visit(views.VIEW_SQL[v])
                needed.append(v)

    visit(sql)
    body = sql.strip().replace("$NOW", f"TIMESTAMP '{views.NOW}'")
    if not needed:
        return body
    ctes = ",\n".join(f"{v} AS ({views.VIEW_SQL[v]})" for v in needed)
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
