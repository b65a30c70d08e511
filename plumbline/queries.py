"""Named queries of the comparison engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_learn, queries_more, queries_screen, queries_tables

MODULES = (queries_screen, queries_tables, queries_more, queries_learn)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_screen.screen_ship_years(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
