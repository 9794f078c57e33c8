"""URL filters as predicates. Cheap tests come first; exclusion beats inclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrawl.functions.urls import host_of, is_web


def same_domain(host: Column, domains: list[str]) -> Column:
    """host is one of the domains or below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith(f".{d.lower()}")
    return out


def matches_any(url: Column, patterns: list[str]) -> Column:
    """Unanchored regular expressions; inline flags such as (?i) work."""
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(p)
    return out


def allows(url: Column, domains: list[str] = (), same_domain_only: bool = True, include: list[str] = (), exclude: list[str] = ()) -> Column:
    test = is_web(url)
    if same_domain_only:
        test = test & same_domain(host_of(url), list(domains))
    if exclude:
        test = test & ~matches_any(url, list(exclude))
    if include:
        test = test & matches_any(url, list(include))
    return F.coalesce(test, F.lit(False))


def in_domains(rows: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is in domains(domain) or below one: each host is spread to its suffixes, then an equi-join."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(host).distinct().withColumn("domain", F.explode(suffixes)).join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain").select(host).distinct()
    return rows.join(hosts, host, "left_semi")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of each key."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_first"))
    return best.select("_first.*")
