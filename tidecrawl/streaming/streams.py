"""Streaming forms of the stateful operators."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrawl.operators.tables import shared_dir


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """events as a stream with ts as event time; a batch takes files_per_batch files at most, however many wait."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(stream: DataFrame, key: str, delay: str | None = None) -> DataFrame:
    """The first event of each key: the seen-set of a frontier, which forgets nothing.

    Its state grows with the keys and lies in the state store. With a delay, keys are remembered that long only.
    """
    if delay is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def paced(stream: DataFrame, interval: int, delay: str = "1 hour") -> DataFrame:
    """(seq, granted, waited) of a stream (domain, at, seq, ts): requests to a domain are interval apart at least.

    The state of a domain is the time of its next slot in seconds, kept from batch to batch; requests of one batch are
    served by at and seq. A timer forgets the slot when the watermark has passed it, as it holds nobody back then.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        free = state.get[0] if state.exists else None
        rows = sorted((a, s) for f in frames for a, s in zip(f["at"], f["seq"]))
        out = []
        for at, seq in rows:
            go = at if free is None else max(at, free)
            out.append((seq, go, go - at))
            free = go + interval
        state.update((free,))
        state.setTimeoutTimestamp(max(1000 * free, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["seq", "granted", "waited"])

    return stream.withWatermark("ts", delay).groupBy("domain").applyInPandasWithState(step, "seq long, granted long, waited long", "free long", "update", "EventTimeTimeout")


def rates_by_window(stream: DataFrame, width: str, delay: str = "0 seconds") -> DataFrame:
    """(start, event_type, n) of tumbling windows."""
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.unix_seconds("window.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for the input there is now, as a table in the shared folder."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/tidecrawl/stream-{uuid.uuid4().hex}"
    if mode == "update":  # each row is given once
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start()
    elif mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(stream.columns)
