"""Registry that pairs each bound query with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Setting of a session: partitions to deal out a table into before its texts are taken apart.
SPREAD = "spark.glossa.textPartitions"


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are about to be taken apart.

    It stays as the scan cuts it, unless the session sets ``SPREAD``: a file of one row group, such as a test table, is one
    task otherwise.
    """
    rows, wanted = table(spark, sf_dir, name), spark.conf.get(SPREAD, None)
    return rows if wanted is None else rows.repartition(int(wanted))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column, so that sums taken in another order still compare equal."""
    return df.select(
        *[
            (F.round(F.col(f"`{name}`"), places) + F.lit(0.0)).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
