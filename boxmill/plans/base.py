"""How plans register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Views:
    """The fixture views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str = "", views: str = "", recursive: bool = False) -> Callable[[Callable[[Views], DataFrame]], Query]:
    """Registers f(views) under its name; sql is its DuckDB twin over the named views."""

    def registered(f: Callable[[Views], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = duck(sql, *views.split(), recursive=recursive)
        return run

    return registered


def twin_of(name: str) -> Callable[[Callable[[Views], DataFrame]], Query]:
    """Registers f(views) under its own name with the SQL of another query that gives the same rows."""

    def registered(f: Callable[[Views], DataFrame]) -> Query:
        run = query()(f)
        SQL[f.__name__] = SQL[name]
        return run

    return registered
