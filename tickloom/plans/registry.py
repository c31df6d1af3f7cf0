"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schema import MINUTES
from ..sources.domain import SQL, Tables, bars_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(body: str) -> str:
    """Put the domain views that a body names in front of it; bars_1h is the view of hourly bars."""
    views = {name: SQL[name] for name in ("ticks", "trades", "equity") if re.search(rf"\b{name}\b", body)}
    for name in sorted(set(re.findall(r"\bbars_(\w+)\b", body))):
        views.setdefault("ticks", SQL["ticks"])
        views[f"bars_{name}"] = bars_sql(MINUTES[name])
    rest = body.strip()
    recursive = "RECURSIVE " if rest.startswith("RECURSIVE ") else ""
    rest = rest.removeprefix("RECURSIVE ")
    heads = [f"{name} AS MATERIALIZED ({text})" for name, text in views.items()]
    if not rest.upper().startswith("SELECT"):
        heads, rest = [*heads, ""], rest
        return f"WITH {recursive}" + ",\n".join(heads) + rest
    return (f"WITH {recursive}" + ",\n".join(heads) + "\n" if heads else "") + rest


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(tables) under `name`; `sql` begins with SELECT, or with common table expressions and no WITH."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, root: f(Tables(spark, root))
        if sql is not None:
            ORACLES[name] = _sql(sql)
        return f

    return add
