"""Spark sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "palisade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the operators rely on: UTC, adaptive execution, Arrow. A cluster's own settings win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
