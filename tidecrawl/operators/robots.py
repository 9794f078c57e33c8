"""robots.txt as tables: parsing, rule choice and verdicts in DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecrawl.functions.urls import agent_token, host_of, origin_of, path_of

LIMIT = 500 * 1024  # characters of a file that count
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"  # around keys and values, in any script
NUMBER = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?)$"
GROUP_KEYS = ("user-agent", "allow", "disallow", "crawl-delay")


def lines(files: DataFrame) -> DataFrame:
    """(origin, line, key, value) of files(origin, text)."""
    rows = files.select("origin", F.posexplode(F.split(F.substring("text", 1, LIMIT), LINE_ENDS)).alias("line", "raw"))
    bare = F.substring_index("raw", "#", 1)
    cut = F.instr(bare, ":")
    rows = rows.select("origin", "line", bare.alias("raw"), cut.alias("cut")).where("cut > 0")
    return rows.select("origin", "line", F.lower(F.regexp_replace(F.expr("substring(raw, 1, cut - 1)"), BLANK, "")).alias("key"), F.regexp_replace(F.expr("substring(raw, cut + 1)"), BLANK, "").alias("value"))


def grouped(files: DataFrame) -> DataFrame:
    """Lines of groups with their group number; a user-agent line after any other group line opens a new group."""
    own = Window.partitionBy("origin").orderBy("line")
    kept = lines(files).where(F.col("key").isin(*GROUP_KEYS))
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(own), F.lit("")) != "user-agent")
    kept = kept.withColumn("opens", opens.cast("int"))
    return kept.withColumn("group_no", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0))).where("group_no > 0").drop("opens")


def pattern_regex(pattern: Column) -> Column:
    """A pattern as a regular expression: * any text, $ at the end anchors, the rest literal, matched from the start."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    quoted = F.concat(F.lit("\\Q"), F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?s)^"), quoted, F.when(anchored, "$").otherwise(""))


def rules_of(groups: DataFrame) -> DataFrame:
    """(origin, group_no, rule_no, allow, pattern, pattern_regex)"""
    rows = groups.where("key in ('allow', 'disallow') and value <> ''")
    rows = rows.select("origin", "group_no", F.col("line").alias("rule_no"), (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return rows.withColumn("pattern_regex", pattern_regex(F.col("pattern")))


def agents_of(groups: DataFrame) -> DataFrame:
    """(origin, group_no, agent)"""
    return groups.where("key = 'user-agent'").select("origin", "group_no", agent_token("value").alias("agent")).distinct()


def delays_of(groups: DataFrame) -> DataFrame:
    """(origin, group_no, delay): the last valid one of each group."""
    number = F.when(F.col("value").rlike(NUMBER), F.replace("value", F.lit("_"), F.lit("")).try_cast("double"))
    rows = groups.where("key = 'crawl-delay'").select("origin", "group_no", "line", number.alias("delay")).where("delay >= 0 and not isnan(delay)")
    return rows.groupBy("origin", "group_no").agg(F.max_by("delay", "line").alias("delay"))


def sitemaps_of(files: DataFrame) -> DataFrame:
    return lines(files).where("key = 'sitemap' and value <> ''").select("origin", "line", F.col("value").alias("sitemap"))


def policy_of(files: DataFrame) -> DataFrame:
    """(origin, status, policy): rules, allow_all for 4xx but 429, disallow_all for everything else that failed."""
    status = F.col("status")
    policy = F.when(status < 400, "rules").when((status < 500) & (status != 429), "allow_all").otherwise("disallow_all")
    return files.select("origin", "status", policy.alias("policy"))


def each(agents: list[str]) -> Column:
    return F.explode(F.array(*(F.lit(a) for a in dict.fromkeys(agents))))


def judged(urls: DataFrame, agents: list[str], policies: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, agent, allowed) from policies(origin, policy) and Robots.rules_for() of the agents."""
    rows = urls.select("url").distinct().withColumn("origin", origin_of("url")).withColumn("path", path_of("url"))
    pairs = rows.withColumn("agent", each(agents)).join(policies.select("origin", "policy"), "origin", "left")
    hit = pairs.join(rules, ["origin", "agent"], "left")
    plain = ~F.col("pattern").contains("*") & ~F.col("pattern").endswith("$")  # most rules need no regular expression
    hit = hit.withColumn("hit", F.when(plain, F.col("path").startswith(F.col("pattern"))).otherwise(F.expr("path rlike pattern_regex")))
    best = F.max_by(F.when(F.col("hit"), F.col("allow")), F.when(F.col("hit"), F.struct(F.length("pattern"), "allow")))
    out = hit.groupBy("url", "agent", "path", "policy").agg(best.alias("best"))
    allowed = F.when(F.col("policy") == "allow_all", True).when(F.col("policy") == "disallow_all", False).when(F.col("path") == "/robots.txt", True).otherwise(F.coalesce("best", F.lit(True)))
    return out.select("url", "agent", allowed.alias("allowed"))


def for_all(verdicts: DataFrame) -> DataFrame:
    """(url, allowed): every agent may fetch it."""
    return verdicts.groupBy("url").agg(F.bool_and("allowed").alias("allowed"))


class Robots:
    """The robots files of some origins: files(origin, status, text). Origins without a file have no rules."""

    def __init__(self, files: DataFrame) -> None:
        self.files = files
        self.policies = policy_of(files)
        self.groups = grouped(files.where("status < 400"))
        self.agents, self.rules, self.delays = agents_of(self.groups), rules_of(self.groups), delays_of(self.groups)

    def effective(self, agents: list[str]) -> DataFrame:
        """(asked, origin, group_no): all groups that name the agent's token, or else all that name *."""
        named = self.agents.withColumn("asked", each(agents)).withColumn("token", agent_token("asked")).where("agent = token or agent = '*'")
        rank = Window.partitionBy("asked", "origin")
        named = named.withColumn("own", (F.col("agent") == F.col("token")).cast("int")).withColumn("best", F.max("own").over(rank))
        return named.where("own = best").select("asked", "origin", "group_no").distinct()

    def rules_for(self, agents: list[str]) -> DataFrame:
        """(origin, agent, pattern, pattern_regex, allow): the rules that hold for each agent."""
        effective = self.effective(agents).withColumnRenamed("asked", "agent")
        return effective.join(self.rules, ["origin", "group_no"]).select("origin", "agent", "pattern", "pattern_regex", "allow")

    def verdicts(self, urls: DataFrame, agents: list[str]) -> DataFrame:
        """(url, agent, allowed): the longest matching pattern decides, Allow at equal length; none allows."""
        return judged(urls, agents, self.policies, self.rules_for(agents))

    def allowed_for_all(self, urls: DataFrame, agents: list[str]) -> DataFrame:
        """(url, allowed): every agent may fetch it."""
        return for_all(self.verdicts(urls, agents))

    def crawl_delays(self, agents: list[str]) -> DataFrame:
        """(origin, agent, delay) of every known origin; null if the agent's groups set none."""
        found = self.effective(agents).join(self.delays, ["origin", "group_no"]).groupBy("origin", F.col("asked").alias("agent")).agg(F.max("delay").alias("delay"))
        return self.files.select("origin").distinct().withColumn("agent", each(agents)).join(found, ["origin", "agent"], "left")

    def host_delays(self, agents: list[str], requests: DataFrame | None = None) -> DataFrame:
        """(host, delay): the largest over agents, and over the origins of a host; 0 for none.

        With requests(seq, url), that of the host's origin which was asked for last, as each origin sets it anew.
        """
        rows = self.crawl_delays(agents).withColumn("host", host_of("origin"))
        if requests is not None:
            last = requests.groupBy(host_of("url").alias("host")).agg(F.max_by(origin_of("url"), "seq").alias("origin"))
            rows = last.join(rows.drop("host"), "origin", "left")
        return rows.groupBy("host").agg(F.coalesce(F.max("delay"), F.lit(0.0)).alias("delay"))

    def crawl_delay(self, agent: str, requests: DataFrame) -> DataFrame:
        """(delay) for the origin requested last in requests(seq, url); 0 if unknown or unset."""
        last = requests.select(F.max_by(origin_of("url"), "seq").alias("origin"))
        return last.join(self.crawl_delays([agent]), "origin", "left").select(F.coalesce("delay", F.lit(0.0)).alias("delay"))

    def fetch_count(self) -> DataFrame:
        """(fetched): how many files were asked for, one for each origin."""
        return self.files.agg(F.countDistinct("origin").alias("fetched"))

    def cached(self, urls: DataFrame) -> DataFrame:
        """(url, cached): whether the file of the URL's origin is among these."""
        known = self.files.select("origin").distinct().withColumn("cached", F.lit(True))
        return urls.select("url").distinct().withColumn("origin", origin_of("url")).join(known, "origin", "left").select("url", F.coalesce("cached", F.lit(False)).alias("cached"))

    def report(self, urls: DataFrame, agents: list[str]) -> DataFrame:
        """(url, agent, status, policy, n_groups, n_sitemaps, verdict, delay) of each URL for each agent."""
        records = self.as_records().select("origin", "status", "policy", F.coalesce(F.size("groups"), F.lit(0)).alias("n_groups"), F.coalesce(F.size("sitemaps"), F.lit(0)).alias("n_sitemaps"))
        rows = self.verdicts(urls, agents).withColumn("origin", origin_of("url")).join(records, "origin").join(self.crawl_delays(agents), ["origin", "agent"], "left")
        return rows.select("url", "agent", "status", "policy", "n_groups", "n_sitemaps", F.when(F.col("allowed"), "allowed").otherwise("BLOCKED").alias("verdict"), F.coalesce("delay", F.lit(0.0)).alias("delay"))

    def as_records(self) -> DataFrame:
        """One nested row for each origin: groups with agents, allow, disallow and crawl delay; sitemaps."""
        names = self.agents.groupBy("origin", "group_no").agg(F.sort_array(F.collect_set("agent")).alias("user_agents"))
        ordered = F.sort_array(F.collect_list(F.struct("rule_no", "allow", "pattern")))
        rules = self.rules.groupBy("origin", "group_no").agg(ordered.alias("r"))
        pick = lambda allow: F.coalesce(F.transform(F.filter("r", lambda x: x["allow"] == allow), lambda x: x["pattern"]), F.array().cast("array<string>"))
        rows = names.join(rules, ["origin", "group_no"], "left").join(self.delays, ["origin", "group_no"], "left")
        group = F.struct("group_no", "user_agents", pick(True).alias("allow"), pick(False).alias("disallow"), F.col("delay").alias("crawl_delay"))
        maps = sitemaps_of(self.files).groupBy("origin").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "sitemap"))), lambda x: x["sitemap"]).alias("sitemaps"))
        return self.policies.join(rows.groupBy("origin").agg(F.sort_array(F.collect_list(group)).alias("groups")), "origin", "left").join(maps, "origin", "left")


def robots_files(urls: DataFrame, corpus: DataFrame) -> DataFrame:
    """(origin, status, text): one lookup for each origin of urls in corpus(url, status, text); a miss is a 404."""
    origins = urls.select(origin_of("url").alias("origin")).distinct()
    files = corpus.select(F.regexp_replace("url", r"/robots\.txt$", "").alias("origin"), "status", "text").where(corpus["url"].endswith("/robots.txt"))
    return origins.join(files, "origin", "left").select("origin", F.coalesce("status", F.lit(404)).alias("status"), F.coalesce("text", F.lit("")).alias("text"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
