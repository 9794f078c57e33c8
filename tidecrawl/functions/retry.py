"""Retry rules as native column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    max_retries: int = 3
    backoff_base: float = 0.5
    backoff_factor: float = 2.0
    backoff_max: float = 30.0
    backoff_jitter: float = 0.5
    max_retry_after: float = 60.0
    operation_timeout: float = 120.0


def is_retryable_status(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def backoff_delay(n: Column, policy: Policy, seed: int | None = None) -> Column:
    """Seconds before attempt n + 1; the jitter comes after the bound, so may exceed it."""
    delay = F.least(F.lit(policy.backoff_max), F.lit(policy.backoff_base) * F.pow(F.lit(policy.backoff_factor), n - 1))
    return delay if seed is None or not policy.backoff_jitter else delay * (1 + F.rand(seed) * policy.backoff_jitter)


#: Hours east of Greenwich of the zone names that dates in headers may have; other names count as Greenwich.
ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AST": -4, "ADT": -3}
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
#: Day, month, year, time and zone of the date forms of the protocol: with the month before the day in one of them.
DAY_FIRST = r"^(?:[A-Za-z]+,?\s+)?(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([A-Za-z]+|[+-]\d{4}))?$"
MONTH_FIRST = r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(\d{4})$"


def header_date(value: Column) -> Column:
    """Seconds since 1970 of a date in a header; null if it is none. Years of two digits lie in 1969-2068."""
    first = value.rlike(MONTH_FIRST)

    def part(day_first: int, month_first: int | None) -> Column:
        other = F.lit("") if month_first is None else F.regexp_extract(value, MONTH_FIRST, month_first)
        return F.when(first, other).otherwise(F.regexp_extract(value, DAY_FIRST, day_first))

    day, month, year, hour, minute, second, zone = part(1, 2), part(2, 1), part(3, 6), part(4, 3), part(5, 4), part(6, 5), part(7, None)
    place = F.instr(F.lit(MONTHS), F.initcap(month))
    number = year.try_cast("int")
    full = F.when(F.length(year) == 4, number).when(number > 68, number + 1900).otherwise(number + 2000)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", full, ((place + 2) / 3).cast("int"), day.try_cast("int"), hour.try_cast("int"), minute.try_cast("int"), F.coalesce(second.try_cast("int"), F.lit(0)))
    names = F.create_map(*[x for name, h in ZONES.items() for x in (F.lit(name), F.lit(3600 * h))])
    shift = F.when(zone.rlike(r"^[+-]\d{4}$"), F.when(zone.startswith("-"), -1).otherwise(1) * (zone.substr(2, 2).try_cast("int") * 3600 + zone.substr(4, 2).try_cast("int") * 60)).otherwise(F.coalesce(F.try_element_at(names, F.upper(zone)), F.lit(0)))
    known = (first | value.rlike(DAY_FIRST)) & (place % 3 == 1)
    return F.when(known, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("double") - shift)


def parse_retry_after(value: Column, now: Column) -> Column:
    """Seconds from a Retry-After header: a number, or a date, 0 if it is past; null for anything else."""
    v = F.trim(value)
    ahead = header_date(v) - now
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("double")).when(ahead.isNotNull(), F.greatest(ahead, F.lit(0.0)))


def classify(status: Column, raised: Column, retry_after: Column) -> Column:
    """struct(error_class, retryable, retry_after) of one attempt; raised names a connection error, timeout or other."""
    network = raised.isin("timeout", "connection")
    failed = raised.isNotNull() | (status >= 400)
    name = F.when(raised.isNotNull(), "FetchError").when(status == 429, "RateLimitExceeded").when(status >= 400, "FetchError")
    again = F.when(raised.isNotNull(), network).when(failed, is_retryable_status(status)).otherwise(False)
    return F.struct(name.alias("error_class"), again.alias("retryable"), F.when(status.isin(429, 503), retry_after).alias("retry_after"))


def error_text(name: Column, message: Column, attempts: Column) -> Column:
    return F.format_string("%s: %s (attempts: %d)", name, message, attempts)


def rotated_agent(agents: list[str], seq: Column, seed: int | None = None) -> Column:
    """Round robin over the agents, or with a seed a random choice that the seed and seq decide."""
    if not agents or any(not a.strip() for a in agents):
        raise ValueError("user agents must not be blank")
    turn = seq if seed is None else F.xxhash64(F.lit(seed), seq)
    return F.element_at(F.array(*map(F.lit, agents)), (F.pmod(turn, F.lit(len(agents))) + 1).cast("int"))


def retry_waits(outcome: Column, replies: Column, policy: Policy) -> Column:
    """array<struct<wait:double, pauses:boolean>>: what follows each attempt of a retry_timeline().

    wait is the time up to the next attempt, 0 after the last; pauses says that the whole host waits, as it does after
    a Retry-After and after status 429.
    """

    def after(t, i):
        reply = F.element_at(replies, F.least(i + 1, F.size(replies)))
        again = i + 1 < F.size(outcome["times"])
        asked = (reply["status"] == 429) | (reply["status"].isin(503) & reply["retry_after"].isNotNull())
        wait = F.when(again, F.element_at(outcome["times"], F.when(again, i + 2).otherwise(1)) - t).otherwise(0.0)
        return F.struct(wait.alias("wait"), (again & F.coalesce(asked, F.lit(False))).alias("pauses"))

    return F.transform(outcome["times"], after)


def retry_timeline(replies: Column, policy: Policy) -> Column:
    """Outcome of one URL from its scripted replies, array<struct<status:int, raised:string, retry_after:double>>.

    One reply is used for each attempt, the last again and again. struct(success, status, attempts, times, error_class,
    timed_out): times are the starts of the attempts in seconds. Backoff is without jitter.
    """
    return F.get(F.transform(F.array(replies), lambda r: _timeline(r, policy)), F.lit(0))  # takes replies once


def _timeline(replies: Column, policy: Policy) -> Column:
    empty = F.array().cast("array<double>")
    start = F.struct(F.lit(0.0).alias("t"), F.lit(False).alias("stop"), F.lit(False).alias("success"), F.lit(None).cast("int").alias("status"), F.lit(0).alias("attempts"), empty.alias("times"), F.lit(None).cast("string").alias("error_class"), F.lit(False).alias("timed_out"))

    def attempt(s, n):
        reply = F.element_at(replies, F.least(n, F.size(replies)))
        status, raised = reply["status"], reply["raised"]
        verdict = classify(status, raised, reply["retry_after"])
        failed = verdict["error_class"].isNotNull()
        wait = F.when(verdict["retry_after"].isNotNull(), F.least(verdict["retry_after"], F.lit(policy.max_retry_after))).otherwise(backoff_delay(n, policy))
        again = failed & verdict["retryable"] & (n <= policy.max_retries)
        late = again & (s["t"] + wait > policy.operation_timeout)
        new = F.struct((s["t"] + F.when(again, wait).otherwise(0.0)).alias("t"), (~again | late).alias("stop"), (~failed).alias("success"), status.alias("status"), n.alias("attempts"), F.concat(s["times"], F.array(s["t"])).alias("times"), verdict["error_class"].alias("error_class"), late.alias("timed_out"))
        return F.when(s["stop"], s).otherwise(new)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(policy.max_retries + 1)), start, attempt)
    return F.struct(*[end[c].alias(c) for c in ("success", "status", "attempts", "times", "error_class", "timed_out")])
