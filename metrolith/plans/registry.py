"""Registration of queries, their SQL for DuckDB, and the inventory rows they show."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, tuple[int, ...]] = {}


class Tables:
    """The input tables of a query: ``t.orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, rows: tuple[int, ...] = (), oracle: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ROWS[name] = tuple(rows)
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def portable(name: str, rows: tuple[int, ...], sql: str, duckdb: str | None = None) -> None:
    """Register SQL with ``{table}`` names that both engines run as it stands."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(t: Tables) -> DataFrame:
        return t.spark.sql(sql, **{k: getattr(t, k) for k in tables})

    query(name, rows, re.sub(r"\{(\w+)\}", r"\1", duckdb or sql))(run)
