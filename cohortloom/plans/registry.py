"""Query catalogue: a Spark callable per operator id and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import ship_package, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register a query; `rounded` names the double columns both sides round to `digits` digits."""
    cols = rounded.split()

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            df = fn(spark, folder)
            missing = set(cols) - set(df.columns)
            if missing:
                raise ValueError(f"{name}: no columns {sorted(missing)}")
            return df.select(
                *[(F.round(c, digits) + 0.0).alias(c) if c in cols else F.col(c) for c in df.columns]
            )

        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql:
            replaced = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS q" if cols else sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table, spread over all cores before costly expressions run on them."""
    return spread(table(spark, folder, name).select(*columns))
