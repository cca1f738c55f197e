"""Names of queries, and inputs that Spark and the checking SQL build from the same statement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that costs far more than its rows: a small file is one task otherwise, however many rows it becomes."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of a statement over the tables that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)
