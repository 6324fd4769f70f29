"""Listing URLs (URL1-URL5). The hosts are parameters: see `sources.rules.SiteRules`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import slugify, strip
from .udfs import let


def absolute(href: Column, base: str) -> Column:
    """Joins a path or an absolute URL to the base."""
    x = F.trim(href)
    return F.when(x.rlike("(?i)^[a-z][a-z0-9+.-]*:"), x).when(x.startswith("//"), F.concat(F.lit(base.split("//")[0]), x)).when(x.startswith("/"), F.concat(F.lit(base.rstrip("/")), x)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), x))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def _tail(url: Column, hosts: list[str]) -> Column:
    """Path parts behind /markets/stocks/ on an allowed host, else null."""

    def behind(parts: Column) -> Column:
        ok = (F.size(parts) >= 3) & (F.lower(F.get(parts, F.lit(0))) == "markets") & (F.lower(F.get(parts, F.lit(1))) == "stocks")
        return F.when(ok, F.slice(parts, 3, 100))

    return F.when(url_host(F.trim(url)).isin(hosts), let(F.filter(F.split(url_path(F.trim(url)), "/"), lambda p: p != ""), behind))


def listing_parts(url: Column, hosts: list[str]) -> Column:
    """struct(kind, slug, exchange, symbol, market_key): kind is `slug`, `market` or null."""

    def parts(tail: Column) -> Column:
        one, two = F.get(tail, F.lit(0)), F.get(tail, F.lit(1))
        is_slug = (F.size(tail) == 1) & one.rlike(r"^[A-Za-z0-9._-]+$") & ~F.lower(one).rlike("^(?:search$|http|www)")
        exchange, symbol = F.upper(one), F.upper(two)
        is_market = (F.size(tail) == 2) & exchange.isin(V.EXCHANGES) & symbol.rlike(r"^[A-Z0-9._&-]+$")
        kind = F.when(is_slug, F.lit("slug")).when(is_market, F.lit("market"))
        made = F.struct(kind.alias("kind"), one.alias("one"), exchange.alias("exchange"), symbol.alias("symbol"))
        return let(made, _named_parts)

    return let(_tail(url, hosts), parts)


def _named_parts(p: Column) -> Column:
    market = p["kind"] == "market"
    return F.struct(p["kind"].alias("kind"), F.when(p["kind"] == "slug", p["one"]).alias("slug"), F.when(market, p["exchange"]).alias("exchange"), F.when(market, p["symbol"]).alias("symbol"), F.when(market, F.concat_ws(":", p["exchange"], p["symbol"])).alias("market_key"))


def canonical_listing(url: Column, hosts: list[str]) -> Column:
    """https, first host, upper-case market parts, no query; null for anything else."""
    base = f"https://{hosts[0]}/markets/stocks/"

    def made(p: Column) -> Column:
        return F.when(p["kind"] == "slug", F.concat(F.lit(base), p["slug"], F.lit("/"))).when(p["kind"] == "market", F.concat(F.lit(base), p["exchange"], F.lit("/"), p["symbol"], F.lit("/")))

    return let(listing_parts(url, hosts), made)


def market_key(url: Column, hosts: list[str]) -> Column:
    return listing_parts(url, hosts)["market_key"]


def slug_hint(url: Column, hosts: list[str]) -> Column:
    return F.nullif(F.replace(listing_parts(url, hosts)["slug"], F.lit("-"), F.lit(" ")), F.lit(""))


def symbol_alias(url: Column, hosts: list[str]) -> Column:
    """The market symbol as an alias phrase of 2 to 12 characters."""
    from .text import phrase_key

    x = phrase_key(listing_parts(url, hosts)["symbol"])
    return F.when(F.length(x).between(2, 12), x)


def tracker_symbol(url: Column) -> Column:
    """First exchange only, and a narrower alphabet than the canonical form."""
    return F.nullif(F.regexp_extract(url, "/markets/stocks/NSE/([A-Z0-9&-]+)/?", 1), F.lit(""))


def links(html: Column) -> Column:
    """Double-quoted hrefs."""
    return F.regexp_extract_all(html, F.lit('(?i)href="([^"]+)"'), F.lit(1))


def edition_id(url: Column, title: Column) -> Column:
    return slugify(F.coalesce(F.nullif(strip(url_path(url), "/"), F.lit("")), title))
