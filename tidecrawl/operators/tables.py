"""Written intermediate tables, for loops that must not grow their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a local session may use a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='tidecrawl-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidecrawl/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place, files = _hadoop_path(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        place, files = _hadoop_path(df.sparkSession, df._written_at)
        files.delete(place, True)
