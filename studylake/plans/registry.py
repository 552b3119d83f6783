"""Named queries over the views, each with the SQL that an oracle runs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import VIEWS, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The SQL below the definitions of the views that it names."""
    found: list[str] = []

    def add(text: str) -> None:
        for v in re.findall(r"\bv_[a-z]+\b", text):
            if v in VIEWS and v not in found:
                add(VIEWS[v])
                found.append(v)

    add(sql)
    names = {n: n for n in (*VIEWS, "orders", "customer", "lineitem", "events", "documents", "part", "supplier", "embeddings")}
    heads = ", ".join(f"{v} as ({VIEWS[v].format(**names)})" for v in found)
    return f"with {heads}{', ' if sql.lstrip().startswith(',') else ' '}{sql.lstrip().removeprefix(',')}" if heads else sql


def query(name: str, build: Callable, sql: str | None = None) -> None:
    """build(v) gives the DataFrame; v(name) gives a table or view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(lambda table: view(spark, sf_dir, table))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql)
