"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the input tables: ``t.orders`` is a parquet scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


def present(df: DataFrame) -> DataFrame:
    """Dates and times leave a query as ISO text, so every client reads the same value."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd").alias(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Every DOUBLE column to fixed decimals, ``special`` naming columns with their own precision.

    Written as floor(x * 10^d + 0.5) / 10^d, the one form all engines compute alike on ties.
    """
    def fix(name: str) -> Column:
        c, unit = F.col(f"`{name}`"), float(10 ** special.get(name, digits))
        return F.when(~F.isnan(c), F.floor(c * unit + 0.5) / unit).alias(name)

    return df.select(*[fix(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(q.build(Tables(spark, sf_dir)))

    run.__name__ = q.name
    return run
