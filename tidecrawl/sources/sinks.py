"""Sinks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_jsonl(pages: DataFrame, path: str, single_file: bool = False) -> None:
    """One JSON object on each line, UTF-8, nulls written; replaces what is there."""
    rows = pages.coalesce(1) if single_file else pages
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def listing(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows for a report, and with each the number that is left out."""
    more = rows.agg(F.greatest(F.count("*") - most, F.lit(0))).scalar()
    return rows.orderBy(order).limit(most).withColumn("n_more", more)
