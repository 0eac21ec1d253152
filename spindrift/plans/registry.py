"""Where queries are collected by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .projections import Data, reached_views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: dict[str, str] | None = None, name: str | None = None):
    """Register ``build(data)`` under its name, with the SQL that gives the same rows (behind the views that it names)."""

    def register(build: Callable[[Data], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Data(spark, sf_dir))
        if sql:
            ORACLES[key] = with_views(sql, more)
        return build

    return register


def report(key: str, sql: str, tables: dict[str, Callable[[Data], DataFrame]], more: dict[str, str], extra: dict[str, str] | None = None) -> None:
    """A report as SQL over tables that operators make (``tables``); the oracle makes them from ``more``. ``extra``: views over them that both share."""
    reached = " ".join([sql, *((extra or {})[n] for n in reached_views(sql, extra or {}))])
    named = [n for n in tables if re.search(rf"\b{n}\b", reached)]  # only what this report reaches is made
    text = with_views(sql, extra)
    for n in named:  # under names of this library, so that a caller's views stay as they are
        text = re.sub(rf"\b{n}\b", f"spindrift_{n}", text)

    def build(data: Data) -> DataFrame:
        for n in named:
            tables[n](data).createOrReplaceTempView(f"spindrift_{n}")
        return data.sql(text)

    QUERIES[key] = lambda spark, sf_dir: build(Data(spark, sf_dir))
    ORACLES[key] = with_views(sql, more | (extra or {}))
