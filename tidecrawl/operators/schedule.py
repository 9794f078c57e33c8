"""Request schedules: what a rate limiter would grant, as closed forms over windows, and folds where limits are coupled."""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrawl.operators.stretches import MOST, handed_on, stretched


def token_bucket(log: DataFrame, key: str, at: str, seq: str, interval: int, burst: int = 1, most: int = MOST) -> DataFrame:
    """log plus granted: the time at which a bucket of burst tokens, one more each interval, lets a request pass.

    Times and interval are integers of one unit. Requests of a key are served in order of arrival. With
    T_i = (i + 1) * interval + max over j <= i of (at_j - j * interval), a grant is max(at_i, T_(i-1) - (burst - 1) * interval).
    A key of more than most requests is cut into stretches.
    """
    if interval < 0 or burst < 1:
        raise ValueError("interval must not be negative, burst must be 1 or more")
    rows, cut = stretched(log, [key], [at, seq], most)
    own = Window.partitionBy(key, "_part").orderBy(at, seq)
    rows = rows.withColumn("_s", (F.row_number().over(own) - 1).cast("long") * interval)
    rows = rows.withColumn("_max", F.max(F.col(at) - F.col("_s")).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = handed_on(rows, cut, [key], F.count("*") * interval, F.max(F.col(at) - F.col("_s")))
    lead = F.greatest(F.col("_max") - F.col("_base"), F.col("_lead"))
    due = F.col("_base") + F.col("_s") + lead - (burst - 1) * interval
    return rows.withColumn("granted", F.greatest(F.col(at), F.coalesce(due, F.col(at)))).select(*log.columns, "granted")


def spacing(log: DataFrame, key: str | None, at: str, seq: str, gap: Column, most: int = MOST) -> DataFrame:
    """log plus granted and waited: each request follows the one before by that one's gap at least.

    With S_i the sum of the gaps before i, a grant is S_i + max over j <= i of (at_j - S_j). Without key all requests
    share one schedule. A schedule of more than most requests is cut into stretches.
    """
    keys = [key] if key else []
    rows, cut = stretched(log.withColumn("_gap", gap), keys, [at, seq], most)
    own = Window.partitionBy(*keys, "_part").orderBy(at, seq)
    rows = rows.withColumn("_s", F.coalesce(F.sum("_gap").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_max", F.max(F.col(at) - F.col("_s")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = handed_on(rows, cut, keys, F.sum("_gap"), F.max(F.col(at) - F.col("_s")))
    granted = F.col("_base") + F.col("_s") + F.greatest(F.col("_max") - F.col("_base"), F.col("_lead"))
    return rows.withColumn("granted", granted).withColumn("waited", F.col("granted") - F.col(at)).select(*log.columns, "granted", "waited")


def polite_gap(interval: float, min_delay: float, crawl_delay: Column, jitter: float = 0.0, seed: int = 0) -> Column:
    """Seconds between two requests to a domain."""
    if min(interval, min_delay, jitter) < 0:
        raise ValueError("delays must not be negative")
    base = F.greatest(F.lit(float(interval)), F.lit(float(min_delay)), F.coalesce(crawl_delay, F.lit(0.0)))
    return base + F.rand(seed) * jitter if jitter else base


def learned_delays(log: DataFrame, learned: DataFrame, most: int = MOST) -> DataFrame:
    """log(domain, at, seq, ...) plus delay: the largest of learned(domain, since, delay) known at the next request.

    A delay learned later also pushes back the slot after a request that is already out, so each request takes the
    delays known when the next one arrives. Requests and delays share one order, in which the delay is a running
    maximum; a domain of more than most of them is cut into stretches.
    """
    back, cut = stretched(log.withColumns({"_at": -F.col("at").cast("double"), "_seq": -F.col("seq")}), ["domain"], ["_at", "_seq"], most)
    back = back.withColumn("_lag", F.lag("_at").over(Window.partitionBy("domain", "_part").orderBy("_at", "_seq")))
    back = handed_on(back, cut, ["domain"], F.lit(0), F.max("_at"))
    following = F.coalesce(-F.coalesce("_lag", "_lead"), F.lit(float("inf")))
    asked = back.select("domain", following.alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_delay"), F.struct(*log.columns).alias("_row"))
    known = learned.select("domain", F.col("since").cast("double").alias("_t"), F.lit(0).alias("_kind"), F.col("delay").cast("double").alias("_delay"), F.lit(None).alias("_row"))
    rows, cut = stretched(asked.unionByName(known), ["domain"], ["_t", "_kind"], most)
    own = Window.partitionBy("domain", "_part").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = handed_on(rows.withColumn("_max", F.max("_delay").over(own)), cut, ["domain"], F.lit(0), F.max("_delay"))
    return rows.where("_row is not null").select("_row.*", F.coalesce(F.greatest("_max", "_lead"), F.lit(0.0)).alias("delay"))


def coupled_limits(log: DataFrame, host_interval: float, global_interval: float, burst: int = 1) -> DataFrame:
    """(seq, domain, at, granted) of log(seq, domain, at) under a token bucket for each host and one for all.

    A bucket holds burst tokens and gains one each interval. A host's requests go one after the other: the first waits
    for its host's token, then queues for a common one, in the order in which requests get that far, and is charged to
    the host when it leaves. The limits feed back on each other, so one ordered pass over the whole log decides: rows
    stream through one task, which holds two figures for each host and the requests that wait.
    """
    if min(host_interval, global_interval) < 0 or burst < 1:
        raise ValueError("intervals must not be negative, burst must be 1 or more")

    def run(batches):
        due = {}  # when a host's bucket will be full
        waiting = {}  # requests of a host behind its first
        queue = []  # (when it has its host's token, seq, domain, at) of each host's first request
        common, free = [float("-inf")], {}

        def enter(domain, at, seq):
            begin = max(at, free.get(domain, at))  # the request before must have left
            heapq.heappush(queue, (max(begin, due.get(domain, float("-inf")) - (burst - 1) * host_interval), seq, domain, at))

        def leave():
            ready, seq, domain, at = heapq.heappop(queue)
            go = max(ready, common[0] - (burst - 1) * global_interval)
            common[0] = max(common[0], go) + global_interval
            due[domain] = max(due.get(domain, float("-inf")), go) + host_interval
            free[domain] = go
            if waiting[domain]:
                enter(domain, *waiting[domain].popleft())
            else:
                del waiting[domain]
            return seq, domain, at, go

        def frame_of(out):
            return pd.DataFrame(out, columns=["seq", "domain", "at", "granted"])

        for frame in batches:
            out = []
            for seq, domain, at in zip(frame["seq"], frame["domain"], frame["at"]):
                while queue and queue[0][0] < at:  # what comes at the same time may still be ahead of it
                    out.append(leave())
                if domain in waiting:
                    waiting[domain].append((at, seq))
                else:
                    waiting[domain] = deque()
                    enter(domain, at, seq)
            yield frame_of(out)
        while queue:
            yield frame_of([leave() for _ in range(min(len(queue), 10_000)) if queue])

    rows = log.select(F.col("seq").cast("long"), "domain", F.col("at").cast("double")).repartition(1).sortWithinPartitions("at", "seq")
    return rows.mapInPandas(run, "seq long, domain string, at double, granted double")


def with_pauses(log: DataFrame, interval: float, replies: DataFrame) -> DataFrame:
    """(seq, domain, at, granted) when a reply may stop its whole host: replies(seq, pause) in seconds, null for none.

    The pause counts from the request's own grant and holds back every later request to the host, so it is a longer
    gap after that request.
    """
    rows = log.select(F.col("seq").cast("long"), "domain", F.col("at").cast("double")).join(replies.select("seq", F.col("pause").cast("double")), "seq", "left")
    gap = F.greatest(F.lit(float(interval)), F.when(~F.isnan("pause"), F.col("pause")))
    return spacing(rows, "domain", "at", "seq", gap).select("seq", "domain", "at", "granted")
