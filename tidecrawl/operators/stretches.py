"""Long orders cut into stretches, so that running figures over one key, or over all rows, need no task of that length.

Rows are range-partitioned by key and order. A stretch is summed up alone; what a key's earlier stretches hand on is a
window over one row for each stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrawl.operators.tables import written

MOST = 1 << 22  # rows of one key that a task may sort


def stretched(rows: DataFrame, keys: list[str], order: list[str], most: int = MOST) -> tuple[DataFrame, bool]:
    """rows plus _part, and whether they were cut: only if a key has more than most rows.

    _part rises with the order. The cut is a written table, as range bounds are sampled and may differ in another run.
    """
    each = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("heaviest"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    if each.heaviest <= most:
        return rows.withColumn("_part", F.lit(0)), False
    cut = rows.repartitionByRange(-(-each.total // most), *keys, *order).withColumn("_part", F.spark_partition_id())
    return written(cut, "stretches"), True


def earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def handed_on(rows: DataFrame, cut: bool, keys: list[str], total: Column, top: Column) -> DataFrame:
    """rows plus _base, the sum of total over the key's earlier stretches, and _lead, the largest top of those, each
    less its own _base; 0 and null in a first stretch."""
    if not cut:
        return rows.withColumns({"_base": F.lit(0), "_lead": F.lit(None)})
    sums = rows.groupBy(*keys, "_part").agg(total.alias("_total"), top.alias("_top"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_total").over(earlier(keys)), F.lit(0)))
    sums = sums.withColumn("_lead", F.max(F.col("_top") - F.col("_base")).over(earlier(keys)))
    sums = sums.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_base", "_lead")
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    return rows.join(sums, same).drop("_of", *[f"_{i}" for i in range(len(keys))])
