"""Crawls as level-by-level joins of a frontier with a corpus.

A page's place in the crawl is the path of link positions that leads to it. Paths of one level sort like a serial
first-in-first-out crawl visits its pages, so a page limit is exact, and no global numbering is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecrawl.functions.html import PAGE_FIELDS, parse_page
from tidecrawl.functions.retry import Policy, error_text, retry_timeline, retry_waits, rotated_agent
from tidecrawl.functions.urls import host_of, is_web, normalize_url
from tidecrawl.operators.fetch import Corpus, parsed
from tidecrawl.operators.filters import allows, same_domain
from tidecrawl.operators.robots import Robots, for_all, judged, policy_of, robots_files, union_all
from tidecrawl.operators.schedule import polite_gap, spacing
from tidecrawl.operators.stretches import MOST, handed_on, stretched
from tidecrawl.operators.tables import written


@dataclass(frozen=True)
class Limits:
    max_depth: int = 2
    max_pages: int = 100
    same_domain_only: bool = True
    allowed_domains: tuple[str, ...] | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    filter_seeds: bool = False  # seeds must pass scheme and domain too

    def __post_init__(self) -> None:
        if self.max_pages < 1:
            raise ValueError("max_pages must be 1 or more")
        if self.max_depth < 0:
            raise ValueError("max_depth must be 0 or more")


@dataclass
class Crawl:
    """pages: a row for each fetch; blocked: (url_key, url) that robots rules kept out; offers: links offered; robots:
    the robots files that were asked for."""

    pages: DataFrame
    blocked: DataFrame
    offers: int
    admitted: int
    robots: Robots | None = None

    @property
    def duplicates(self) -> int:
        return self.offers - self.admitted


def offered(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    """The first offer of each key that wasn't seen: (url_key, url, depth, ord)."""
    keyed = rows.withColumn("url_key", normalize_url("url")).where("url_key is not null")
    first = keyed.groupBy("url_key").agg(F.min_by(F.struct("url", "depth", "ord"), F.col("ord")).alias("f")).select("url_key", "f.*")
    return first if seen is None else first.join(seen, "url_key", "left_anti")


def retried(fetched: DataFrame, replies: DataFrame, policy: Policy) -> DataFrame:
    """Fetched rows with the outcome of their retries, as replies(url_key, replies) script them.

    success, status, error, body and attempts are those of the last attempt; times and waits tell when each attempt
    began, in seconds from the first, and what followed it. Addresses without a script keep their one attempt.
    """
    rows = fetched.join(replies.select("url_key", "replies"), "url_key", "left").withColumn("_o", F.when(F.col("replies").isNotNull(), retry_timeline(F.col("replies"), policy)))
    last = F.element_at("replies", F.least(F.col("_o.attempts"), F.size("replies")))
    name = F.when(F.col("_o.timed_out"), "FetchError").otherwise(F.col("_o.error_class"))
    message = F.when(F.col("_o.timed_out"), F.format_string("operation timeout %ss exceeded", F.lit(f"{policy.operation_timeout:g}"))).when(last["raised"].isNotNull(), last["raised"]).otherwise(F.format_string("HTTP %d", F.col("_o.status")))
    scripted = F.col("_o").isNotNull() & F.col("url_key").isNotNull()
    failed = scripted & ~F.col("_o.success")
    columns = {
        "success": F.when(scripted, F.col("_o.success") & F.col("success")).otherwise(F.col("success")),
        "status": F.when(failed, F.col("_o.status")).otherwise(F.col("status")),
        "error": F.when(failed, error_text(name, message, F.col("_o.attempts"))).otherwise(F.col("error")),
        "body": F.when(failed, "").otherwise(F.col("body")),
    }
    kept = [columns[c].alias(c) if c in columns else F.col(c) for c in fetched.columns]
    alone = F.array(F.struct(F.lit(0.0).alias("wait"), F.lit(False).alias("pauses")))
    waits = F.when(scripted, retry_waits(F.col("_o"), F.col("replies"), policy)).otherwise(alone)
    return rows.select(*kept, F.when(scripted, F.col("_o.attempts")).otherwise(1).alias("attempts"), waits.alias("waits"))


def crawl(
    spark: SparkSession, pages: DataFrame, seeds: list[str] | DataFrame, limits: Limits = Limits(), robots: DataFrame | None = None, agents: tuple[str, ...] = ("*",),
    selectors: dict | None = None, fields: list[str] = PAGE_FIELDS, parser=parse_page, replies: DataFrame | None = None, policy: Policy = Policy(), on_level=None, keep=None,
) -> Crawl:
    """Breadth-first crawl of the corpus pages(url, html, ...) from the seeds, a list or a table (pos, url).

    Each key is fetched once; failures count towards max_pages, and the links of the last page allowed are not
    offered. Filters come before deduplication, so a rejected link isn't remembered. With robots(url, status, text),
    blocked seeds are dropped; links to origins already known are dropped when offered, and those to new origins
    become failed rows with no attempt, which use up the page limit. With replies(url_key, replies), fetches are
    retried by the policy. With selectors, a column data holds the selected fields; fields are the parts of the page
    row that are taken. on_level(depth, pages) is called after each level with its rows; keep(url) is a further test
    of links, as a column.
    """
    if isinstance(seeds, DataFrame):
        seed_rows = seeds.select("url", F.lit(0).alias("depth"), F.array(F.col("pos").cast("int")).alias("ord"))
    else:
        seed_rows = spark.createDataFrame([(u, 0, [i]) for i, u in enumerate(seeds)], "url string, depth int, ord array<int>")
    blocked = []
    if robots is not None:
        checked = written(robots_files(seed_rows, robots), "robots")
        rules = written(Robots(checked).rules_for(list(agents)), "rules")
        verdict = written(for_all(judged(seed_rows, list(agents), policy_of(checked), rules)), "verdicts")
        blocked.append(seed_rows.join(verdict.where("not allowed"), "url", "left_semi").select("url", "ord"))
        seed_rows = seed_rows.join(verdict.where("allowed"), "url", "left_semi")
    domains = limits.allowed_domains
    if domains is None:
        hosts = limits.same_domain_only or limits.filter_seeds
        domains = tuple(r[0] for r in seed_rows.select(host_of("url")).distinct().collect()) if hosts else ()  # as many as seeds
    if limits.filter_seeds:
        seed_rows = seed_rows.where(is_web("url"))
        if any(domains):
            seed_rows = seed_rows.where(same_domain(host_of("url"), [d for d in domains if d]))
    offers = seed_rows.count()
    frontier = written(offered(seed_rows, None), "frontier")
    admitted = frontier.count()
    base, seen, levels, left = Corpus(pages), frontier.select("url_key"), [], limits.max_pages

    def rows_of(batch):
        rows = base.fetch(batch.drop("url_key"))
        return retried(rows, replies, policy) if replies is not None else rows.withColumn("attempts", F.lit(1))

    n = admitted
    for depth in range(limits.max_depth + 1):
        if not n or left <= 0:
            break
        closes = n >= left
        batch = frontier.orderBy("ord").limit(left) if n > left else frontier
        left -= min(n, left)
        rows = rows_of(batch)
        if robots is not None:
            fresh = written(robots_files(batch, robots).join(checked.select("origin"), "origin", "left_anti"), "robots")
            if not fresh.isEmpty():  # each file is read once
                checked, rules = checked.unionByName(fresh), rules.unionByName(written(Robots(fresh).rules_for(list(agents)), "rules"))
            verdict = for_all(judged(batch, list(agents), policy_of(checked), rules))
            rows = rows.join(verdict, "url", "left")
            no = ~F.coalesce("allowed", F.lit(True))
            message = F.concat(F.lit("RobotsDisallowedError: disallowed by robots.txt: "), F.col("url"))
            gone = {"success": F.col("success") & ~no, "status": F.when(~no, F.col("status")), "error": F.when(no, message).otherwise(F.col("error")), "body": F.when(no, "").otherwise(F.col("body")), "attempts": F.when(no, 0).otherwise(F.col("attempts"))}
            if "waits" in rows.columns:
                gone["waits"] = F.when(no, F.slice("waits", 1, 0)).otherwise(F.col("waits"))
            rows = rows.select(*[gone.get(c, F.col(c)).alias(c) for c in rows.columns if c != "allowed"])
        level = written(parsed(rows, list(dict.fromkeys([*fields, "links"])), parser, selectors), f"level{depth}")
        if robots is not None:
            blocked.append(level.where("attempts = 0").select("url", "ord"))
        levels.append(level)
        if on_level is not None:
            on_level(depth, level)
        if depth == limits.max_depth:
            break
        links = level.where("error is null").select(F.posexplode("links").alias("pos", "url"), F.lit(depth + 1).alias("depth"), F.col("ord").alias("parent"))
        links = links.where(allows(F.col("url"), [d for d in domains if d], limits.same_domain_only and any(domains), list(limits.include), list(limits.exclude)))
        if keep is not None:
            links = links.where(keep(F.col("url")))
        links = links.select("url", "depth", F.concat("parent", F.array("pos")).alias("ord"))
        if robots is not None:
            links = written(links, "offers")
            no = written(for_all(judged(links, list(agents), policy_of(checked), rules)).where("not allowed"), "verdicts")
            blocked.append(links.join(no, "url", "left_semi").select("url", "ord"))
            links = links.join(no, "url", "left_anti")
        if closes:
            break
        links = written(links, "links")
        offers += links.count()
        frontier = written(offered(links, seen), "frontier")
        n = frontier.count()
        admitted += n
        seen = seen.union(frontier.select("url_key"))  # written tables, one for each level

    empty = spark.createDataFrame([], "url string, ord array<int>")
    out = union_all(levels) if levels else parsed(rows_of(seed_rows.limit(0)), list(dict.fromkeys([*fields, "links"])), parser, selectors)
    stopped = union_all(blocked) if blocked else empty
    stopped = stopped.groupBy(normalize_url("url").alias("url_key")).agg(F.min_by("url", F.struct(F.size("ord"), "ord")).alias("url"))
    stopped = stopped.withColumn("error", F.concat(F.lit("RobotsDisallowedError: disallowed by robots.txt: "), F.col("url")))
    return Crawl(out, stopped, offers, admitted, Robots(checked) if robots is not None else None)


def request_log(found: Crawl, agents: list[str], interval: float, min_delay: float = 0.0, seed: int | None = None, most: int = MOST) -> DataFrame:
    """(seq, domain, url, attempt, agent, at, granted, waited): the requests of a crawl, each attempt a row.

    Requests are numbered in the order of one worker: by depth, then place, then attempt; agents take turns in that
    order, or with a seed at random. Each host has a worker of its own that starts at 0, keeps the interval, min_delay
    and the host's crawl delay between requests, waits before a retry, and stops all requests to the host meanwhile.
    """
    waits = F.col("waits") if "waits" in found.pages.columns else F.when(F.col("attempts") > 0, F.array(F.struct(F.lit(0.0).alias("wait"), F.lit(False).alias("pauses"))))
    rows = found.pages.select("depth", "ord", "url", F.posexplode(waits).alias("n", "w"))
    rows = rows.select("depth", "ord", "url", (F.col("n") + 1).alias("attempt"), F.col("w.wait").alias("wait"))
    rows, cut = stretched(rows, [], ["depth", "ord", "attempt"], most)
    own = Window.partitionBy("_part").orderBy("depth", "ord", "attempt")
    rows = handed_on(rows.withColumn("_k", F.row_number().over(own)), cut, [], F.count("*"), F.lit(0))
    rows = rows.withColumn("seq", (F.col("_base") + F.col("_k") - 1).cast("long")).withColumn("domain", host_of("url"))
    delay = F.lit(None).cast("double")
    if found.robots is not None:
        asked = found.pages.select("url", F.struct("depth", "ord").alias("seq"))
        rows = rows.join(found.robots.host_delays(agents, asked).withColumnRenamed("host", "domain"), "domain", "left")
        delay = F.col("delay")
    gap = F.greatest(polite_gap(interval, min_delay, delay), F.col("wait"))
    rows = rows.select("seq", "domain", "url", "attempt", rotated_agent(agents, F.col("seq"), seed).alias("agent"), F.lit(0.0).alias("at"), gap.alias("gap"))
    return spacing(rows, "domain", "at", "seq", F.col("gap"), most).drop("gap")


def link_depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): breadth-first distance over edges(src, dst) from seeds(node), up to max_depth."""
    now = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "nodes")
    reached = now
    for depth in range(1, max_depth + 1):
        step = now.join(edges, now["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        now = written(step.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "nodes")
        if now.isEmpty():
            break
        reached = reached.union(now)
    return reached


def queue_order(offers: DataFrame) -> DataFrame:
    """(url_key, url, priority, rank): one row for each key, highest priority first, then first come."""
    keyed = offers.withColumn("url_key", normalize_url("url"))
    first = keyed.groupBy("url_key").agg(F.min_by(F.struct("url", "priority", "seq"), F.col("seq")).alias("f")).select("url_key", "f.*")
    return first.orderBy(F.desc("priority"), "seq")


def capped_heads(queue: DataFrame, active: DataFrame, cap: int, top: int) -> DataFrame:
    """The next top entries of queue(host, priority, seq, ...) when each host may have cap active ones."""
    if cap < 1:
        raise ValueError("max_per_domain must be 1 or more")
    own = Window.partitionBy("host").orderBy(F.desc("priority"), "seq")
    heads = queue.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= cap)  # cut before the shuffle too
    rows = heads.join(active.select("host", F.col("n").alias("_n")), "host", "left")
    return rows.where(F.col("_k") <= cap - F.coalesce("_n", F.lit(0))).orderBy(F.desc("priority"), "seq").limit(top).drop("_k", "_n")
