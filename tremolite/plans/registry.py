"""Query registry: a name, a Spark callable over the driver tables, and an optional SQL twin for the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(views) -> DataFrame under `name`; view names used in `sql` are defined in front of it."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return wrap


def with_views(sql: str) -> str:
    sql = sql.strip().rstrip(";")
    used = [n for n in VIEW_SQL if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    prelude = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in used)
    m = re.match(r"(?is)^with(\s+recursive)?\s+", sql)
    if m:
        return f"WITH{m.group(1) or ''} {prelude},\n{sql[m.end():]}"
    return f"WITH {prelude}\n{sql}"
