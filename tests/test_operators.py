import random

import pytest
from pyspark.sql import functions as F

from tidecrawl.functions import retry
from tidecrawl.operators import fetch, frontier, metrics, robots, schedule

SITE = {
    "/": ["/a", "/b", "/a/", "/#top", "http://other.test/", "mailto:x@y", "/files/doc.pdf"], "/a": ["/", "/b", "/a/deep", "/a#frag"], "/b": ["/a/", "/c", "/catalogue/1"],
    "/a/deep": ["/a/deep/deeper"], "/a/deep/deeper": [], "/files/doc.pdf": [], "/catalogue/1": [],
}


def site(spark, extra=()):
    rows = [(f"http://site.test{p}", "".join(f'<a href="{h}">x</a>' for h in hrefs)) for p, hrefs in SITE.items()]
    rows += [("http://other.test/", '<a href="/x">x</a>'), ("http://other.test/x", ""), *extra]
    return spark.createDataFrame(rows, "url string, html string")


def run(spark, **limits):
    found = frontier.crawl(spark, site(spark), ["http://site.test/"], frontier.Limits(**limits))
    return {r.url.removeprefix("http://site.test"): r for r in found.pages.collect()}, found


def test_crawl(spark):
    pages, found = run(spark, max_depth=2)
    assert {u: r.depth for u, r in pages.items()} == {"/": 0, "/a": 1, "/b": 1, "/files/doc.pdf": 1, "/a/deep": 2, "/c": 2, "/catalogue/1": 2}
    assert pages["/c"].status == 404 and pages["/c"].error and not pages["/c"].links
    stats = metrics.queue_stats(found.pages, found.offers, found.admitted).first()
    assert (stats.processed, stats.failed, stats.queued) == (6, 1, 0)


def test_crawl_limits(spark):
    assert len(run(spark, max_depth=0)[0]) == 1 and len(run(spark, max_depth=1)[0]) == 4
    assert list(run(spark, max_depth=2, max_pages=3)[0]) and len(run(spark, max_depth=2, max_pages=3)[0]) == 3
    assert set(run(spark, max_depth=2, include=("/catalogue/", "/b$"))[0]) == {"/", "/b", "/catalogue/1"}
    assert "http://other.test/x" in run(spark, max_depth=2, same_domain_only=False)[0]
    with pytest.raises(ValueError):
        frontier.Limits(max_pages=0)


ROBOTS = """\ufeff# of the harbour office
Disallow: /before-any-group
User-agent:\t*
\tDisallow:\t/store/
Allow : /store/open/   # to all
Disallow: *.plan$
Disallow: /find?
Crawl-delay:\u00a02.25

User-agent: Heron/4
User-agent:\tGull (white)
Disallow: /nest/
CRAWL-DELAY: 1_0

Sitemap:\thttp://harbour.example/map.xml
User-agent: Cormorant
Disallow: /
Crawl-delay: 4d
"""


def rules(spark, *files):
    return robots.Robots(spark.createDataFrame(list(files), "origin string, status int, text string"))


def test_robots(spark):
    known = rules(spark, ("http://harbour.example", 200, ROBOTS), ("http://gone.example", 410, ""), ("http://busy.example", 429, ""), ("http://down.example", 500, ""))
    want = {"/": 1, "/before-any-group": 1, "/store/open/x": 1, "/a.plan?x": 1, "/find": 1, "/robots.txt": 1, "/Store/x": 1, "/store/": 0, "/store/x": 0, "/a.plan": 0, "/find?boat": 0}
    urls = spark.createDataFrame([(f"http://harbour.example{p}",) for p in [*want, "/nest/1"]] + [(f"http://{h}.example/x",) for h in ("gone", "busy", "down", "unknown")], "url string")
    got = {(r.url.removeprefix("http://harbour.example"), r.agent): r.allowed for r in known.verdicts(urls, ["*", "heron/9", "Cormorant", "Heronry/1"]).collect()}
    for p, ok in want.items():
        assert got[p, "*"] == got[p, "Heronry/1"] == bool(ok), p
    assert not got["/nest/1", "heron/9"] and got["/store/x", "heron/9"] and not got["/", "Cormorant"] and got["/robots.txt", "Cormorant"]
    assert [got[f"http://{h}.example/x", "*"] for h in ("gone", "busy", "down", "unknown")] == [True, False, False, True]
    delays = {(r.origin, r.agent): r.delay for r in known.crawl_delays(["*", "GULL", "Cormorant"]).collect()}
    assert [delays["http://harbour.example", a] for a in ("*", "GULL", "Cormorant")] == [2.25, 10.0, None]
    record = next(r for r in known.as_records().collect() if r.origin == "http://harbour.example")
    assert record.sitemaps == ["http://harbour.example/map.xml"] and [g.user_agents for g in record.groups] == [["*"], ["gull", "heron"], ["cormorant"]]


def test_robots_odd_files(spark):
    text = "User-agent: a\nAllow: /x\nDisallow: /x\nCrawl-delay: nan\nUser-agent: b\nDisallow:\nUser-agent: A\nDisallow: /y\\E.z # c\nunknown: 1\nDisallow: /k*m\x0b\x1f Disallow\x1f: /u\u2028Disallow: /v"
    known = rules(spark, ("http://s.test", 200, text))
    urls = spark.createDataFrame([(f"http://s.test{p}",) for p in ("/x", "/y", r"/y\E.z", "/yE-z", "/k/l/m/n", "/u", "/v")], "url string")
    got = {(r.url[13:], r.agent): r.allowed for r in known.verdicts(urls, ["a", "b", "c"]).collect()}
    assert got["/x", "a"] and got["/x", "b"] and not got[r"/y\E.z", "a"] and got["/yE-z", "a"] and got["/x", "c"]
    assert not got["/k/l/m/n", "a"] and not got["/u", "a"] and not got["/v", "a"] and got["/u", "b"]
    assert known.delays.count() == 0


def test_crawl_delay_numbers(spark):
    values = {"3": 3.0, " 0.5 ": 0.5, ".5": 0.5, "1.": 1.0, "1e1": 10.0, "+2": 2.0, "1_0": 10.0, "inf": float("inf"), "3d": None, "3f": None, "-1": None, "nan": None, "0x1": None, "1__0": None, "": None, "1,5": None}
    known = rules(spark, *[(f"http://h{i}.test", 200, f"User-agent: *\nCrawl-delay:{v}") for i, v in enumerate(values)])
    got = {r.origin: r.delay for r in known.delays.collect()}
    assert [got.get(f"http://h{i}.test") for i in range(len(values))] == list(values.values())


def test_host_delays_follow_the_last_origin(spark):
    known = rules(spark, ("http://h.test", 200, "User-agent: *\nCrawl-delay: 5"), ("https://h.test", 200, "User-agent: *\nCrawl-delay: 2"))
    log = spark.createDataFrame([(1, "http://h.test/a"), (2, "https://h.test/b")], "seq int, url string")
    assert [tuple(r) for r in known.host_delays(["*"], log).collect()] == [("h.test", 2.0)] and [tuple(r) for r in known.host_delays(["*"]).collect()] == [("h.test", 5.0)]


def test_crawl_with_robots(spark):
    extra = [("http://site.test/start", '<a href="/store/x">p</a><a href="/a">a</a><a href="http://other.test/">o</a>')]
    files = spark.createDataFrame([("http://site.test/robots.txt", 200, ROBOTS), ("http://other.test/robots.txt", 200, "User-agent: *\nDisallow: /")], "url string, status int, text string")
    limits = frontier.Limits(max_depth=1, same_domain_only=False)
    levels = []
    found = frontier.crawl(spark, site(spark, extra), ["http://site.test/start", "http://site.test/store/"], limits, files, on_level=lambda d, rows: levels.append((d, rows.count())))
    pages = {r.url: r for r in found.pages.collect()}
    assert set(pages) == {"http://site.test/start", "http://site.test/a", "http://other.test/"} and levels == [(0, 1), (1, 2)]
    assert pages["http://other.test/"].attempts == 0 and pages["http://other.test/"].error.startswith("RobotsDisallowedError")
    assert {r.url for r in found.blocked.collect()} == {"http://site.test/store/x", "http://site.test/store/", "http://other.test/"}
    log = frontier.request_log(found, ["*"], 1.0).orderBy("seq").collect()
    assert [(r.url, r.granted) for r in log] == [("http://site.test/start", 0.0), ("http://site.test/a", 2.25)]


def test_crawl_with_retries(spark):
    """A page that comes back, one that never does, and a crawl that only sees what they link to."""
    kind = "url_key string, replies array<struct<status:int,raised:string,retry_after:double>>"
    replies = spark.createDataFrame([("http://site.test/a", [(500, None, None), (503, None, 4.0), (200, None, None)]), ("http://site.test/b", [(None, "timeout", None)]), ("http://site.test/c", [(404, None, None)])], kind)
    found = frontier.crawl(spark, site(spark), ["http://site.test/"], frontier.Limits(max_depth=2), replies=replies, policy=retry.Policy(backoff_jitter=0.0))
    pages = {r.url.removeprefix("http://site.test"): r for r in found.pages.collect()}
    assert set(pages) == {"/", "/a", "/b", "/files/doc.pdf", "/a/deep"}
    assert (pages["/a"].attempts, pages["/a"].success, pages["/b"].attempts, pages["/b"].status) == (3, True, 4, None)
    assert pages["/b"].error == "FetchError: timeout (attempts: 4)"
    log = {(r.url.removeprefix("http://site.test"), r.attempt): (r.granted, r.agent) for r in frontier.request_log(found, ["x", "y"], 1.0).collect()}
    # the interval is 1, the backoff 0.5, 1 and 2, Retry-After 4
    assert [log["/a", k][0] for k in (1, 2, 3)] == [1, 2, 6] and [log["/b", k] for k in (1, 2, 3, 4)] == [(7, "x"), (8, "y"), (9, "x"), (11, "y")]


def test_bodies_are_read_for_hits_only(spark):
    """In the plan of a level the corpus meets a bitmap before any exchange of its bodies."""
    found = fetch.Corpus(site(spark)).fetch(spark.createDataFrame([("http://site.test/a",)], "url string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan.lower().replace("bitmapconstructagg", "bitmap_construct_agg") and "broadcast" in plan and found.first().status == 200


def test_which_page_of_an_address_is_fetched(spark):
    asked = spark.createDataFrame([("http://pier.test/",)], "url string")
    rows = [("http://pier.test/", "late rope", 9), ("http://pier.test/", "sail", 4), ("http://pier.test/", "oar", 7)]
    for shift in range(3):
        pages = spark.createDataFrame(rows[shift:] + rows[:shift], "url string, html string, nth int").coalesce(1)
        assert fetch.fetch(asked, pages, "nth").first().body == "sail"
        assert len({fetch.fetch(asked, pages.repartition(k)).first().body for k in (1, 2, 3)}) == 1
    assert fetch.fetch(asked, spark.createDataFrame([("http://pier.test/", None, 1)], "url string, html string, nth int")).first().success


def test_token_bucket(spark):
    def grants(times, interval, burst):
        log = spark.createDataFrame([("h", i, t) for i, t in enumerate(times)], "key string, seq int, at long")
        return [r.granted for r in schedule.token_bucket(log, "key", "at", "seq", interval, burst).orderBy("seq").collect()]

    assert grants([0] * 10, 200, 1) == [k * 200 for k in range(10)]
    assert grants([0] * 6, 100, 3) == [0, 0, 0, 100, 200, 300]
    assert grants([0, 5000, 5000, 5000], 200, 1) == [0, 5000, 5200, 5400]


def test_spacing_like_a_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.randrange(1000), rng.randrange(1, 60)) for i in range(300)]
    log = spark.createDataFrame(rows, "domain string, seq int, at long, gap long")
    for key, groups in (("domain", "ab"), (None, [None])):
        for most in (1000, 40):
            got = {r.seq: r.granted for r in schedule.spacing(log, key, "at", "seq", F.col("gap"), most).collect()}
            for d in groups:
                free = 0
                for _, seq, at, gap in sorted((r for r in rows if d in (None, r[0])), key=lambda r: (r[2], r[1])):
                    assert got[seq] == max(at, free)
                    free = max(at, free) + gap


def test_stretches(spark):
    rng = random.Random(6)
    rows = [(rng.choice(("a", "b", None)), i, rng.randrange(2000), rng.randrange(1, 90)) for i in range(400)]
    log = spark.createDataFrame(rows, "domain string, seq int, at long, held long")
    slots = log.select("domain", F.col("at").alias("start"), (F.col("at") + F.col("held")).alias("end"))
    for whole, cut in (
        (schedule.token_bucket(log, "domain", "at", "seq", 20, 3), schedule.token_bucket(log, "domain", "at", "seq", 20, 3, most=30)),
        (metrics.gaps(log), metrics.gaps(log, most=30)),
        (metrics.concurrency_peaks(slots), metrics.concurrency_peaks(slots, most=30)),
    ):
        assert whole.columns == cut.columns
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert metrics.gaps(log.limit(0)).count() == 0


def test_pauses(spark):
    log = spark.createDataFrame([(0, "a", 0.0), (1, "a", 1.0), (2, "b", 1.0), (3, "a", 50.0)], "seq long, domain string, at double")
    replies = spark.createDataFrame([(0, 30.0), (1, None), (2, 5.0)], "seq long, pause double")
    assert {r.seq: r.granted for r in schedule.with_pauses(log, 2.0, replies).collect()} == {0: 0.0, 1: 30.0, 2: 1.0, 3: 50.0}


def plain_limits(rows, host, common, burst):
    """Buckets step by step, in whole numbers: a queue for each host, one for all."""
    full = lambda every: {"tokens": burst * every, "at": 0, "every": every}  # noqa: E731  a token is worth its interval

    def fill(bucket, now):
        bucket["tokens"] = min(burst * bucket["every"], bucket["tokens"] + now - bucket["at"])
        bucket["at"] = now

    hosts, every = {}, full(common)
    waiting, common_queue, out, now = {}, [], {}, 0
    arrivals = sorted((at, seq, d) for seq, d, at in rows)
    while len(out) < len(rows):
        while arrivals and arrivals[0][0] <= now:
            at, seq, d = arrivals.pop(0)
            waiting.setdefault(d, []).append(seq)
        moved = True
        while moved:
            moved = False
            ready = []
            for d, queue in waiting.items():
                bucket = hosts.setdefault(d, full(host))
                fill(bucket, now)
                if queue and (queue[0] not in [s for s, _ in common_queue]) and bucket["tokens"] >= host:
                    ready.append((queue[0], d))
            common_queue += sorted(ready)
            fill(every, now)
            if common_queue and every["tokens"] >= common:
                seq, d = common_queue.pop(0)
                every["tokens"] -= common
                fill(hosts[d], now)
                hosts[d]["tokens"] = max(0, hosts[d]["tokens"] - host)
                waiting[d].pop(0)
                out[seq] = now
                moved = True
        now += 1
    return out


@pytest.mark.parametrize("burst", [1, 3])
def test_coupled_limits(spark, burst):
    rng = random.Random(burst)
    cases = [[(i, "h", 0) for i in range(6)], [(i, f"h{i % 3}", 0) for i in range(18)], [(i, rng.choice("abc"), rng.randrange(60)) for i in range(40)], [(i, rng.choice("ab"), i * 9) for i in range(25)]]
    for rows in cases:
        for host, common in ((10, 1), (3, 7), (5, 5)):
            log = spark.createDataFrame(rows, "seq long, domain string, at double".replace("double", "long")).withColumn("at", F.col("at").cast("double"))
            got = {r.seq: r.granted for r in schedule.coupled_limits(log, float(host), float(common), burst).collect()}
            assert got == plain_limits(rows, host, common, burst)
    with pytest.raises(ValueError):
        schedule.coupled_limits(log, 1.0, 1.0, 0)


def test_burst(spark):
    log = spark.createDataFrame([(i, "h", 0.0) for i in range(6)], "seq long, domain string, at double")
    assert [r.granted for r in schedule.coupled_limits(log, 1.0, 0.0, 3).orderBy("seq").collect()] == [0, 0, 0, 1, 2, 3]


def test_peaks(spark):
    slots = spark.createDataFrame([("a", 0, 2), ("a", 1, 3), ("a", 2, 4), ("b", 1, 2)], "domain string, start int, end int")
    assert {r.domain: r.peak for r in metrics.concurrency_peaks(slots).collect()} == {"a": 2, "b": 1, None: 3}


def test_places_like_python(spark):
    figures = [4.125, 35281.125, 0.375, 1.005, 1.015, 2.675, 8.345, 0.0, 1e6, 99.995, -0.125]
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in figures], "x double").select("x", metrics.places("x", 2).alias("y")).collect()}
    assert got == {x: f"{x:.2f}" for x in figures}
    log = spark.createDataFrame([("pier", t, t % 8) for t in (0, 33, 66, 99, 132, 165, 198, 265)] + [("quay", 0, 3)], "domain string, at long, waited long")
    lines = {r.domain: r.line for r in metrics.summary_line(metrics.domain_stats(log)).collect()}
    assert lines["pier"] == f"pier: 8 requests, wait {22 / 8:.2f} s, interval {265 / 7:.2f} s" and lines["quay"] == "quay: 1 requests, wait 3.00 s, interval - s"
    assert "wait 4.12 s" in metrics.summary_line(metrics.domain_stats(log.withColumn("waited", F.lit(4.125)))).where("domain = 'pier'").first().line


def test_queue(spark):
    offers = spark.createDataFrame([(0, "http://x.test/a", 0), (1, "http://x.test/high", 9), (2, "http://x.test/a/", 0), (3, "http://x.test/b", 0)], "seq int, url string, priority int")
    assert [r.url[-1] for r in frontier.queue_order(offers).collect()] == ["h", "a", "b"]
    queue = spark.createDataFrame([("a", 1, i) for i in range(4)] + [("b", 0, 9)], "host string, priority int, seq int")
    rows = frontier.capped_heads(queue, spark.createDataFrame([], "host string, n int"), 2, 10).collect()
    assert [(r.host, r.seq) for r in rows] == [("a", 0), ("a", 1), ("b", 9)]


def outcome(spark, replies, **policy):
    kind = "replies array<struct<status:int,raised:string,retry_after:double>>"
    rows = spark.createDataFrame([(replies,)], kind)
    return rows.select(retry.retry_timeline(F.col("replies"), retry.Policy(backoff_jitter=0.0, **policy)).alias("o")).first().o


def test_retries(spark):
    assert outcome(spark, [(429, None, 3.0), (200, None, None)]).times == [0, 3]
    assert outcome(spark, [(503, None, 3600.0), (200, None, None)], max_retry_after=10.0).times == [0, 10]
    assert outcome(spark, [(None, "timeout", None), (200, None, None)]).success
    assert outcome(spark, [(None, "invalid", None)]).attempts == 1
    late = outcome(spark, [(500, None, None)], backoff_base=1.0, operation_timeout=5.0)
    assert late.times == [0, 1, 3] and late.timed_out
    assert outcome(spark, [(429, None, 1.0)]).error_class == "RateLimitExceeded"


def test_header_dates(spark):
    from email.utils import parsedate_to_datetime

    values = ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "6 Nov 1994 08:49:37", "Sun, 06 Nov 1994 08:49:37 +0530", "Sun, 06 Nov 1994 08:49:37 -0800", "06 Nov 2068 08:49:37 PDT", "6 Nov 68 08:49 UT", "6 Nov 69 08:49:00 XYZ"]
    rows = spark.createDataFrame([(v,) for v in [*values, "31 Feb 2020 00:00:00 GMT", "6 Abc 1994 08:49:37", "yesterday", None]], "v string")
    got = [r[0] for r in rows.select(retry.header_date(F.col("v"))).collect()]

    def seconds(v):
        at = parsedate_to_datetime(v)
        return (at if at.tzinfo else at.replace(tzinfo=__import__("datetime").timezone.utc)).timestamp()

    assert got == [*map(seconds, values), None, None, None, None]


def test_random_agents(spark):
    rows = spark.range(300).select(retry.rotated_agent(["a", "b", "c"], F.col("id"), 7).alias("x"), retry.rotated_agent(["a", "b", "c"], F.col("id"), 7).alias("y")).collect()
    assert all(r.x == r.y for r in rows) and all(60 < sum(r.x == a for r in rows) < 140 for a in "abc")


def test_learned_delays_in_stretches(spark):
    rng = random.Random(5)
    log = [(i, rng.choice("aaab"), rng.randrange(40)) for i in range(60)]
    learned = [(rng.choice("aabc"), rng.randrange(50), float(rng.randrange(9))) for _ in range(15)]
    want = {}
    for domain in "ab":
        own = sorted((at, seq) for seq, d, at in log if d == domain)
        for (_, seq), following in zip(own, [at for at, _ in own[1:]] + [float("inf")]):
            want[seq] = max([delay for d, since, delay in learned if d == domain and since <= following], default=0.0)
    rows, known = spark.createDataFrame(log, "seq long, domain string, at long"), spark.createDataFrame(learned, "domain string, since long, delay double")
    for most in (schedule.MOST, 7):
        assert {r.seq: r.delay for r in schedule.learned_delays(rows, known, most).collect()} == want
    assert {r.delay for r in schedule.learned_delays(rows, known.limit(0)).collect()} == {0.0}
    assert schedule.learned_delays(rows.limit(0), known).count() == 0


def test_trailing_rates_over_spans(spark):
    rng = random.Random(6)
    log = [(i, rng.choice("aaab"), rng.randrange(-30, 60)) for i in range(80)]
    want = {}
    for seq, domain, at in log:
        met = [t for _, d, t in log if d == domain and at - 10 < t <= at]
        want[seq] = (len(met), (len(met) - 1) / (at - min(met)) if at > min(met) else 0.0)
    found = metrics.trailing_rates(spark.createDataFrame(log, "seq long, domain string, at long"), 10)
    assert found.columns == ["seq", "domain", "at", "n_recent", "rate_recent"]
    assert {r.seq: (r.n_recent, r.rate_recent) for r in found.collect()} == want


def test_capped_heads_with_active_ones(spark):
    queue = [(h, i, i % 3) for i, h in enumerate("aaaabbbc")]
    active = {"a": 1, "b": 2}
    want = []
    for host in "abc":
        want += sorted((-p, seq, host) for h, seq, p in queue if h == host)[: 2 - active.get(host, 0)]
    found = frontier.capped_heads(spark.createDataFrame(queue, "host string, seq int, priority int"), spark.createDataFrame(list(active.items()), "host string, n int"), 2, 10)
    assert [(r.host, r.seq) for r in found.collect()] == [(host, seq) for _, seq, host in sorted(want)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
