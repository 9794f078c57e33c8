"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: seq, domain (the user), at in whole seconds, held in seconds, failed."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("domain"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("held"), (F.col("event_type") == "error").alias("failed"))
