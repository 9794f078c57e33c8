"""Fetching as joins with a corpus table pages(url, html[, status, headers, error]).

Bodies are read where they are asked for only: which page a key stands for is decided on keys and addresses, and a
bitmap of the addresses asked for keeps all other bodies out of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrawl.functions.html import PAGE_FIELDS, is_html, parse_html, parse_page
from tidecrawl.functions.urls import normalize_url
from tidecrawl.operators.bitmaps import bitmap_of, likely
from tidecrawl.operators.tables import written


class Corpus:
    """pages with one address for each URL key: the least. Of rows with that address the first by the column order
    stands for it; without one, the least by status, error, digest of the body and headers."""

    def __init__(self, pages: DataFrame, order: str | None = None) -> None:
        self.pages, self.order = pages, order
        keyed = pages.select(normalize_url("url").alias("url_key"), "url").where("url_key is not null")
        self.index = written(keyed.groupBy("url_key").agg(F.min("url").alias("page_url")), "corpus")

    def bodies(self, asked: DataFrame) -> DataFrame:
        """(page_url, status, body, headers, error) of the addresses in asked(page_url), and by chance of a few others."""
        have = self.pages.columns
        rows = self.pages.select(
            F.col("url").alias("page_url"),
            (F.col("status") if "status" in have else F.lit(200)).cast("int").alias("status"),
            (F.col("html") if "html" in have else F.col("body")).alias("body"),
            (F.col("headers") if "headers" in have else F.create_map().cast("map<string,string>")).alias("headers"),
            (F.col("error") if "error" in have else F.lit(None)).cast("string").alias("error"),
            *([F.col(self.order).alias("nth")] if self.order else []),
        )
        nth = F.struct("nth") if self.order else F.struct("status", "error", F.md5("body"), F.col("headers").cast("string"))
        met = likely(rows, "page_url", bitmap_of(asked.where("page_url is not null"), "page_url"))
        return met.groupBy("page_url").agg(F.min_by(F.struct("status", "body", "headers", "error"), nth).alias("r")).select("page_url", "r.*")

    def fetch(self, urls: DataFrame) -> DataFrame:
        """All columns of urls(url, ...) plus url_key, success, status, body, headers, error.

        An address that the corpus lacks gives status 404; 400 and above is a failure that keeps its status and has an
        empty body; a bad address or a recorded error fails without a status.
        """
        asked = urls.withColumn("url_key", normalize_url("url")).join(self.index, "url_key", "left")
        got = asked.join(self.bodies(asked), "page_url", "left")
        bad = F.col("url_key").isNull()
        status = F.when(bad | F.col("error").isNotNull(), F.lit(None).cast("int")).otherwise(F.coalesce("status", F.lit(404)))
        reason = F.when(bad, "ValueError: invalid URL").when(F.col("error").isNotNull(), F.col("error")).when(status >= 400, F.format_string("FetchError: HTTP %d", status))
        body = F.when(reason.isNull(), F.coalesce("body", F.lit(""))).otherwise("").alias("body")
        return got.select(*urls.columns, "url_key", reason.isNull().alias("success"), status.alias("status"), body, F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), reason.alias("error"))


def fetch(urls: DataFrame, pages: DataFrame, order: str | None = None) -> DataFrame:
    return Corpus(pages, order).fetch(urls)


def fetch_many(spark, urls: list[str] | DataFrame, pages: DataFrame, order: str | None = None) -> DataFrame:
    """A row for each address of the list, or of a table (pos, url), in its order; repeated ones are fetched each time."""
    asked = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos int, url string")
    return fetch(asked, pages, order).orderBy("pos")


def bodies(fetched: DataFrame) -> DataFrame:
    """(url, body), one row for each address, of repeated ones the last; '' for failures."""
    return fetched.groupBy("url").agg(F.max_by("body", "pos").alias("body"))


def parsed(fetched: DataFrame, fields: list[str] = PAGE_FIELDS, parser=parse_page, selectors: dict | None = None) -> DataFrame:
    """The canonical page row of each fetched one, or the wanted fields of it.

    What isn't HTML or failed has the same shape, empty. A page that the parser can't read keeps its status and has the
    error. With selectors, a column data holds the selected parts, taken from the same parse.
    """
    body = F.when(F.col("success") & is_html("headers"), F.col("body")).otherwise("")
    out = fetched.withColumn("_page", parse_html(body, F.col("url"), fields, parser, selectors))
    failed = F.col("_page.parse_error").isNotNull()
    out = out.withColumn("error", F.coalesce("error", F.when(failed, F.concat(F.lit("ParseError: "), F.col("_page.parse_error")))))
    out = out.withColumn("success", F.col("success") & ~failed)
    return out.drop("body", "headers").select("*", "_page.*").drop("_page", "parse_error")


def fetch_and_parse(urls: DataFrame, pages: DataFrame, fields: list[str] = PAGE_FIELDS, parser=parse_page) -> DataFrame:
    """The page rows of urls(url, ...); in the order of pos if there is such a column."""
    out = parsed(fetch(urls, pages), fields, parser)
    return out.orderBy("pos") if "pos" in urls.columns else out
