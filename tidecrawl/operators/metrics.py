"""Figures about crawls and request logs, as grouped and windowed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrawl.functions.urls import normalize_url
from tidecrawl.operators.stretches import MOST, earlier, handed_on, stretched


def places(number: Column | str, n: int) -> Column:
    """A number with n decimal places, from its exact binary value and half to even, as C and Python print it; Java's
    %f, and so format_string, rounds the shortest decimal form half up."""
    return F.call_function("format_number", F.col(number) if isinstance(number, str) else number, F.lit(f"0.{'0' * n}"))


def pages_by_depth(pages: DataFrame) -> DataFrame:
    return pages.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth")


def duplicate_keys(urls: DataFrame) -> DataFrame:
    return urls.groupBy(normalize_url("url").alias("url_key")).agg(F.count("*").alias("n")).where("n > 1")


def failed_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_if(F.col("error").isNotNull()).alias("failed"))


def queue_stats(pages: DataFrame, offers: int, admitted: int) -> DataFrame:
    """Counters of a crawl that has ended."""
    return pages.agg(
        F.lit(admitted).cast("long").alias("added"), F.lit(offers - admitted).cast("long").alias("duplicates"), F.count("*").alias("visited"),
        F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.lit(0).cast("long").alias("queued"), F.lit(0).cast("long").alias("in_progress"),
    )


def throughput(done: Column, elapsed: Column) -> Column:
    """done / elapsed, 0 without time."""
    return F.coalesce(F.try_divide(done, elapsed), F.lit(0.0))


def actual_rate() -> Column:
    """(n - 1) / (last - first) of the grouped rows' column at; null below two rows or without time between."""
    return F.try_divide(F.count("at") - 1, F.max("at") - F.min("at"))


def rates(log: DataFrame) -> DataFrame:
    """(domain, is_total, n, rate): of each domain and, with is_total 1, of all."""
    return log.groupingSets([["domain"], []], "domain").agg(F.grouping("domain").cast("int").alias("is_total"), F.count("*").alias("n"), actual_rate().alias("rate"))


def violations(log: DataFrame, limit: float | None, total_limit: float | None = None, tolerance: float = 0.1) -> DataFrame:
    """rates() that exceed their limit, of a domain or of all, by more than the tolerance; None is no limit."""
    over = F.when(F.col("is_total") == 1, F.lit(total_limit).cast("double")).otherwise(F.lit(limit).cast("double"))
    return rates(log).withColumn("limit", over).where(F.col("rate") > F.col("limit") * (1 + tolerance))


def violation_lines(found: DataFrame) -> DataFrame:
    """violations() as text."""
    return found.select("domain", F.format_string("%s: %s rps > limit %s", F.coalesce("domain", F.lit("global")), places("rate", 2), F.col("limit").cast("string")).alias("line"))


def timers(log: DataFrame) -> DataFrame:
    """(started, finished, elapsed) of log(at, ...); null, null and 0 without rows."""
    return log.agg(F.min("at").alias("started"), F.max("at").alias("finished"), F.coalesce(F.max("at") - F.min("at"), F.lit(0)).alias("elapsed"))


def crawl_stats(pages: DataFrame, log: DataFrame, blocked: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row that rolls up a crawl: pages by outcome, time, request rate, blocked URLs, attempts and retries.

    pages(error), log(domain, at), blocked(url) and attempts(request, n, success) as the crawl left them.
    """
    done = pages.agg(F.count("*").alias("visited"), F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    rate = log.agg(F.coalesce(actual_rate(), F.lit(0.0)).alias("average_rps"), F.countDistinct("domain").alias("domains"))
    parts = [timers(log), rate, blocked.agg(F.count("*").alias("blocked")), http_counters(attempts).select("attempts", "retries")]
    out = done.withColumns({f"_{i}": part.select(F.struct("*")).scalar() for i, part in enumerate(parts)})  # of one row each
    out = out.select(*done.columns, *[f"_{i}.*" for i in range(len(parts))])
    return out.withColumn("pages_per_sec", throughput(F.col("processed") + F.col("failed"), F.col("elapsed")))


def domain_report(log: DataFrame, delays: DataFrame) -> DataFrame:
    """domain_stats() of each domain with its crawl delay from delays(host, delay); null where there is none."""
    stats = domain_stats(log).where("is_total = 0").drop("is_total")
    return stats.join(delays.select(F.col("host").alias("domain"), F.when(F.col("delay") > 0, F.col("delay")).alias("crawl_delay")), "domain", "left")


def reports(states: DataFrame, interval: int) -> DataFrame:
    """(elapsed, processed, failed, queued, in_progress, pages_per_sec) at every interval and at the end.

    states(added, started, finished, failed) has the times of each URL, as integers from the start of the crawl on. A
    report at time t counts what has happened up to t.
    """
    steps = F.array(
        F.struct(F.col("added").alias("t"), F.lit(1).alias("q"), F.lit(0).alias("i"), F.lit(0).alias("p"), F.lit(0).alias("f")),
        F.struct(F.col("started").alias("t"), F.lit(-1).alias("q"), F.lit(1).alias("i"), F.lit(0).alias("p"), F.lit(0).alias("f")),
        F.struct(F.col("finished").alias("t"), F.lit(0).alias("q"), F.lit(-1).alias("i"), (~F.col("failed")).cast("int").alias("p"), F.col("failed").cast("int").alias("f")),
    )
    each = states.select(F.explode(steps).alias("s")).select("s.*").withColumn("k", F.ceil(F.col("t") / interval))
    sums = each.groupBy("k").agg(F.max("t").alias("t"), *[F.sum(c).alias(c) for c in "qipf"])
    every = sums.agg(F.max("k").alias("last"), F.max("t").alias("end")).select(F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "last"))).alias("k"), "end")
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row for each report
    rows = every.join(sums.withColumn("k", F.greatest("k", F.lit(1))).groupBy("k").agg(*[F.sum(c).alias(c) for c in "qipf"]), "k", "left")
    rows = rows.select(F.least(F.col("k") * interval, "end").alias("elapsed"), *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in "qipf"])
    return rows.select("elapsed", F.col("p").alias("processed"), F.col("f").alias("failed"), F.col("q").alias("queued"), F.col("i").alias("in_progress"), throughput(F.col("p") + F.col("f"), F.col("elapsed")).alias("pages_per_sec"))


def report_lines(reports: DataFrame) -> DataFrame:
    """reports() as text."""
    line = F.format_string("[%6ss] processed=%d queued=%d in_progress=%d errors=%d speed=%s pages/s", places(F.col("elapsed").cast("double"), 1), "processed", "queued", "in_progress", "failed", places("pages_per_sec", 2))
    return reports.select("elapsed", line.alias("line"))


def current_rate(log: DataFrame, now: float, window: float = 10.0) -> DataFrame:
    """(rate) of the requests after now - window; 0 below two or without time between."""
    return log.where(F.col("at") > now - window).agg(F.coalesce(actual_rate(), F.lit(0.0)).alias("rate"))


def trailing_rates(log: DataFrame, window: int) -> DataFrame:
    """log(domain, at as integer, ...) plus n_recent and rate_recent over (at - window, at] of its domain.

    Time is cut into spans of one window. A row's frame lies in its own span and the one before, so a task sorts two
    spans of a domain, however long the log is; only the times of the earlier span go along.
    """
    rows = log.withColumn("_row", F.struct(*log.columns)).withColumn("_span", F.floor(F.col("at") / window))
    rows = rows.select("domain", "at", "_span", "_row").unionByName(rows.select("domain", "at", F.col("_span") + 1, F.lit(None).alias("_row")).toDF("domain", "at", "_span", "_row"))
    own = Window.partitionBy("domain", "_span").orderBy("at").rangeBetween(-(window - 1), 0)
    rate = F.try_divide(F.count("*").over(own) - 1, F.col("at") - F.min("at").over(own))
    rows = rows.withColumn("n_recent", F.count("*").over(own)).withColumn("rate_recent", F.coalesce(rate, F.lit(0.0)))
    return rows.where("_row is not null").select("_row.*", "n_recent", "rate_recent")


def gaps(log: DataFrame, most: int = MOST) -> DataFrame:
    """log(domain, at, seq, ...) plus gap to the request before of its domain."""
    rows, cut = stretched(log, ["domain"], ["at", "seq"], most)
    rows = rows.withColumn("_lag", F.lag("at").over(Window.partitionBy("domain", "_part").orderBy("at", "seq")))
    rows = handed_on(rows, cut, ["domain"], F.lit(0), F.max("at"))
    return rows.withColumn("gap", F.col("at") - F.coalesce("_lag", "_lead")).select(*log.columns, "gap")


def domain_stats(log: DataFrame) -> DataFrame:
    """(domain, is_total, requests, avg_wait, avg_interval) of log(domain, at, waited)."""
    every = F.try_divide(F.max("at") - F.min("at"), F.count("*") - 1)
    return log.groupingSets([["domain"], []], "domain").agg(F.grouping("domain").cast("int").alias("is_total"), F.count("*").alias("requests"), F.coalesce(F.avg("waited"), F.lit(0.0)).alias("avg_wait"), every.alias("avg_interval"))


def concurrency_peaks(slots: DataFrame, most: int = MOST) -> DataFrame:
    """(domain, is_total, peak) of slots(domain, start, end): most slots held at once; a slot ends before another starts."""
    spread = slots.select("domain", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("domain", "e.*")
    steps = spread.groupBy("domain", "t", "d").agg(F.sum("d").alias("by"))

    def peak(rows, keys):
        rows, _ = stretched(rows, keys, ["t", "d"], most)
        own = Window.partitionBy(*keys, "_part").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
        parts = rows.withColumn("held", F.sum("by").over(own)).groupBy(*keys, "_part").agg(F.max("held").alias("held"), F.sum("by").alias("by"))
        held = F.col("held") + F.coalesce(F.sum("by").over(earlier(keys)), F.lit(0))
        return parts.withColumn("held", held).groupBy(*keys).agg(F.greatest(F.max("held"), F.lit(0)).alias("peak"))

    whole = peak(steps.groupBy("t", "d").agg(F.sum("by").alias("by")), [])
    each = peak(steps, ["domain"])
    return each.select("domain", F.lit(0).alias("is_total"), "peak").unionByName(whole.select(F.lit(None).cast("string").alias("domain"), F.lit(1).alias("is_total"), "peak"))


def http_counters(attempts: DataFrame) -> DataFrame:
    """(attempts, retries, succeeded, failed) of attempts(request, n, success): a request's last attempt decides."""
    each = attempts.groupBy("request").agg(F.count("*").alias("n"), F.max_by("success", "n").alias("ok"))
    return each.agg(F.sum("n").alias("attempts"), F.sum(F.col("n") - 1).alias("retries"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def speed_up(sequential: Column, parallel: Column) -> Column:
    return F.when(parallel == 0, F.lit(float("inf"))).otherwise(sequential / parallel)


def page_summary(pages: DataFrame) -> DataFrame:
    """Counts of a parsed page's parts."""
    return pages.select(
        "url", F.length("text").cast("long").alias("n_chars"), F.size("links").cast("long").alias("n_links"), F.size("images").cast("long").alias("n_images"),
        (F.size("headings.h1") + F.size("headings.h2") + F.size("headings.h3")).cast("long").alias("n_headings"),
        F.aggregate("tables", F.lit(0), lambda n, t: n + F.size(t["rows"])).cast("long").alias("n_table_rows"),
        F.aggregate("lists", F.lit(0), lambda n, x: n + F.size(x["items"])).cast("long").alias("n_list_items"),
    )


def progress(pages: DataFrame, queued: int, in_progress: int, elapsed: float) -> DataFrame:
    """One snapshot: elapsed, processed, failed, queued, in_progress, pages_per_sec."""
    done = pages.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return done.select(F.lit(float(elapsed)).alias("elapsed"), "processed", "failed", F.lit(queued).alias("queued"), F.lit(in_progress).alias("in_progress"), throughput(F.col("processed") + F.col("failed"), F.lit(float(elapsed))).alias("pages_per_sec"))


def summary_line(stats: DataFrame) -> DataFrame:
    """domain_stats() as text; - for what is unknown."""
    show = lambda c: F.coalesce(places(c, 2), F.lit("-"))
    return stats.select("domain", F.format_string("%s: %d requests, wait %s s, interval %s s", F.coalesce("domain", F.lit("total")), "requests", show("avg_wait"), show("avg_interval")).alias("line"))
