"""The registered queries of this subpackage and, where one exists, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epochwise.plans.hubs import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """What the Python workers need: the package, and batches of texts that fit beside one another."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, table)``, where ``table(name)`` reads a table of the folder."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap
