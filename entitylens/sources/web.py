"""Sitemaps and listings from fetched text (SRC4-SRC10, SRC14, SRC15), and a paged source for tables that stand in for remote ones (SRC1, SRC2, SRC11, SRC12).

The network itself is out of scope: pages come as tables (url, html). `PagedSource` is a
Python data source whose fetcher a subclass gives; `fetch_with_retry` has the retry policy of SRC1.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls
from ..functions.dates import iso_date


def sitemap_posts(pages: DataFrame, base_url: str, prefix: str = "/p/") -> DataFrame:
    """Distinct absolute links of pages whose path begins with the prefix, sorted."""
    hrefs = pages.select(F.explode(urls.links(F.col("html"))).alias("href"))
    found = hrefs.select(urls.absolute(F.col("href"), base_url).alias("url"))
    return found.where(urls.url_path(F.col("url")).startswith(prefix)).distinct().orderBy("url")


def sitemap_entries(pages: DataFrame, prefix: str) -> DataFrame:
    """(url, lastmod) of <url> blocks whose loc begins with the prefix."""
    blocks = pages.select(F.explode(F.regexp_extract_all("html", F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    made = blocks.select(F.trim(F.regexp_extract("b", "(?s)<loc>(.*?)</loc>", 1)).alias("url"), iso_date(F.regexp_extract("b", "(?s)<lastmod>(.*?)</lastmod>", 1)).alias("lastmod"))
    return made.where(F.col("url").startswith(prefix)).orderBy("url")


def trimmed_xml(c):
    """The payload from its declaration or <urlset on."""
    return F.regexp_extract(c, r"(?s)(<\?xml.*|<urlset.*)$", 1)


def sitemap_years(pages: DataFrame, base_url: str) -> DataFrame:
    """Distinct absolute links to a sitemap's year pages, sorted."""
    hrefs = pages.select(F.explode(urls.links(F.col("html"))).alias("href")).where(F.col("href").contains("/sitemap/"))
    return hrefs.select(urls.absolute(F.col("href"), base_url).alias("url")).distinct().orderBy("url")


def listing_index(pages: DataFrame, pattern: str, order: str | None = None) -> DataFrame:
    """(symbol, url) of loc elements in any namespace that the pattern matches in full; the last of a symbol wins.

    order: a column with the order of the pages; without it, of a symbol's last ones on several pages the greatest url wins.
    """
    page = F.col(order) if order else F.lit(0)
    locs = pages.select(page.alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<(?:\\w+:)?loc>\\s*(.*?)\\s*</(?:\\w+:)?loc>"), F.lit(1))).alias("ord", "url"))
    made = locs.withColumn("symbol", F.upper(F.regexp_extract("url", f"^(?:{pattern})$", 1))).where("symbol <> ''")
    return made.groupBy("symbol").agg(F.max_by("url", F.struct("page", "ord", "url")).alias("url")).orderBy("symbol")


def instrument_candidates(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """Instruments of one exchange from a CSV with header; the longest name of a symbol, the earliest of equals; the fallback if the file cannot be read."""
    try:
        rows = spark.read.option("header", True).csv(path)
        rows = rows.where((F.col("exchange") == "NSE") & (F.col("segment") == "NSE") & F.col("instrument_type").isin("EQ", "BE") & (F.col("tradingsymbol") != ""))
    except Exception:
        if fallback is None:
            raise
        return fallback
    rows = rows.select(F.upper("tradingsymbol").alias("symbol"), F.col("name").alias("display_name"), F.monotonically_increasing_id().alias("ord"))
    best = rows.groupBy("symbol").agg(F.max_by("display_name", F.struct(F.length("display_name"), -F.col("ord"))).alias("display_name"))
    return best.select("symbol", "display_name", F.lit("NSE").alias("exchange")).orderBy("symbol")


def index_constituents(raw: DataFrame, index_symbol: str, column: str = "json") -> DataFrame:
    """Members of an index payload, without the row of the index itself."""
    rows = raw.select(F.inline(F.from_json(column, "data array<struct<symbol:string,meta:struct<companyName:string,isin:string,industry:string>>>")["data"]))
    return rows.where(F.col("symbol") != index_symbol).select("symbol", F.col("meta.companyName").alias("name"), F.col("meta.isin").alias("isin"), F.col("meta.industry").alias("industry"))


def search_code(body):
    """A search answer's code: the first that is all digits in its list, else the first six digits that stand alone."""
    return F.coalesce(F.nullif(F.regexp_extract(body, r'"scrip_cd"\s*:\s*"?(\d+)"?\s*[,}\]]', 1), F.lit("")), F.nullif(F.regexp_extract(body, r"\b(\d{6})\b", 1), F.lit("")))


def with_codes(universe: DataFrame, by_isin: DataFrame, by_name: DataFrame) -> DataFrame:
    """Codes by ISIN, else by name."""
    return universe.join(by_isin.withColumnRenamed("code", "_i"), "isin", "left").join(by_name.withColumnRenamed("code", "_n"), "name", "left").withColumn("code", F.coalesce("_i", "_n")).drop("_i", "_n")


def script_rows(pages: DataFrame, element_id: str, schema: str) -> DataFrame:
    """Rows of a JSON list inside a script element."""
    raw = F.regexp_extract("html", f'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1)
    return pages.select(F.inline(F.from_json(F.replace(raw, F.lit("<\\/"), F.lit("</")), schema)))


def bucket_candidates(raw: DataFrame, column: str = "json") -> DataFrame:
    """Candidates of the `companies` and `brands` lists of a payload."""
    item = "array<struct<display_name:string,name:string,exchange:string,symbol:string,slug:string>>"
    p = F.from_json(column, f"companies {item}, brands {item}")
    rows = raw.select(F.inline(F.concat(F.coalesce(p["companies"], F.array().cast(item)), F.coalesce(p["brands"], F.array().cast(item)))))
    made = rows.select(F.trim(F.coalesce("display_name", "name")).alias("display_name"), F.upper(F.trim("exchange")).alias("exchange"), F.upper(F.trim("symbol")).alias("symbol"), F.trim("slug").alias("slug"))
    return made.where((F.col("display_name") != "") & (F.col("symbol") != "") & F.col("exchange").isin("NSE", "BSE"))


def fetch_with_retry(fetch: Callable[[str], str], url: str, retries: int = 4, wait: Callable[[float], None] = time.sleep) -> str:
    """Calls `fetch`; a refusal for too many requests is tried again after 2^n + 1 seconds."""
    for n in range(retries + 1):
        try:
            return fetch(url)
        except PermissionError:
            if n == retries:
                raise
            wait(2**n + 1)
    raise AssertionError


class PagedReader(DataSourceReader):
    """Pages of each key until one is empty, all announced rows are read, or `most` pages."""

    def __init__(self, fetch_page: Callable[[str, int], tuple[list[tuple], int]], options: dict):
        self.fetch_page, self.keys, self.most = fetch_page, options["keys"].split(","), int(options.get("most", 20))

    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def read(self, partition):
        seen = 0
        for page in range(self.most):
            rows, total = self.fetch_page(partition.value, page)
            if not rows:
                return
            for r in rows:
                yield (partition.value, page, *r)
            seen += len(rows)
            if seen >= total:
                return


class PagedSource(DataSource):
    """Base of a paged source: a subclass gives `name`, `columns` and `fetch_page(key, page)` -> (rows, number of rows in all).

    spark.dataSource.register(Sub); spark.read.format(Sub.name()).option("keys", "a,b").load()
    reads (key, page, *columns), one partition for each key.
    """

    columns = "item string"

    @staticmethod
    def fetch_page(key: str, page: int) -> tuple[list[tuple], int]:
        raise NotImplementedError

    def schema(self):
        return f"key string, page int, {self.columns}"

    def reader(self, schema):
        return PagedReader(type(self).fetch_page, self.options)
