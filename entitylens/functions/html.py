"""HTML pages (DOC1-DOC11, DOC18): expressions where regular expressions do, an Arrow-batched reader for blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import iso_date
from .text import collapse
from .udfs import sliced_udf

NODES = "array<struct<ord:int,tag:string,text:string,href:string,in_blockquote:boolean,in_list_item:boolean>>"


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def article(html: Column, fallback: bool = True) -> Column:
    """Inside of the first <article>; the whole page, or nothing, if there is none."""
    found = html.rlike("(?is)<article[^>]*>.*?</article>")
    return F.when(found, F.regexp_extract(html, "(?is)<article[^>]*>(.*?)</article>", 1)).otherwise(html if fallback else F.lit(""))


def meta(html: Column, key: str) -> Column:
    k = re.escape(key)
    orders = [f'(?i)<meta[^>]+{a}[^>]+{b}' for name in ("property", "name") for a, b in ((f'{name}="{k}"', 'content="([^"]+)"'), ('content="([^"]+)"', f'{name}="{k}"'))]
    return collapse(F.coalesce(*[_first(html, p) for p in orders]))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element without tags; entities stay as they are."""
    inside = F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.when(html.rlike(f"(?is)<{tag}[^>]*>.*?</{tag}>"), collapse(F.regexp_replace(inside, "<[^>]+>", " ")))


def meta_title(html: Column, suffix: str = r"\s*\|\s*Substack\s*$") -> Column:
    return F.trim(F.regexp_replace(F.coalesce(meta(html, "og:title"), meta(html, "twitter:title")), "(?i)" + suffix, ""))


def page_title(html: Column) -> Column:
    return F.coalesce(meta_title(html), tag_text(html, "h1"), tag_text(html, "title"), F.lit(""))


def json_ld_date(html: Column) -> Column:
    """First readable datePublished or dateCreated of the page's ld+json scripts, objects or lists."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))

    def dates(raw: Column) -> Column:
        value = F.try_parse_json(F.trim(raw))
        one = F.array(F.coalesce(F.try_variant_get(value, "$.datePublished", "string"), F.try_variant_get(value, "$.dateCreated", "string")))
        items = F.from_json(F.trim(raw), "array<struct<datePublished:string,dateCreated:string>>")
        listed = F.transform(items, lambda x: F.coalesce(x["datePublished"], x["dateCreated"]))
        return F.when(F.trim(raw).startswith("["), listed).otherwise(one)

    found = F.filter(F.transform(F.flatten(F.transform(scripts, dates)), iso_date), lambda d: d != "")
    return F.get(found, F.lit(0))


def published_date(html: Column) -> Column:
    meta_day = F.nullif(iso_date(meta(html, "article:published_time")), F.lit(""))
    loose = F.nullif(iso_date(_first(html, r'property="article:published_time"\s+content="([^"]+)"')), F.lit(""))
    time_tag = F.nullif(iso_date(_first(html, '<time[^>]*datetime="([^"]+)"')), F.lit(""))
    return F.coalesce(meta_day, loose, time_tag, json_ld_date(html))


def tracker_date(html: Column) -> Column:
    return F.substring(F.coalesce(_first(html, r'"datePublished"\s*:\s*"([^"]+)"'), _first(html, '<time[^>]*datetime="([^"]+)"'), F.lit("")), 1, 10)


def preload(html: Column) -> Column:
    """struct(title, post_date, body_html) of a page's preloaded payload, a JSON text inside a JavaScript string."""
    literal = _first(html, r'(?s)window\._preloads\s*=\s*JSON\.parse\("((?:\\.|[^\\"])*)"\)')
    decoded = F.get(F.from_json(F.concat(F.lit('["'), literal, F.lit('"]')), "array<string>"), F.lit(0))
    return F.from_json(decoded, "post struct<title:string,post_date:string,body_html:string>")["post"]


class BlockReader(HTMLParser):
    """Text blocks of a page in order, each with its tag, last link and surroundings.

    skip: elements whose text does not count. A block ends at the next block, and at the
    start and end of the elements in `breaks`.
    """

    BLOCKS = frozenset(("h1", "h2", "h3", "p"))

    def __init__(self, skip: frozenset[str] = frozenset(), breaks: frozenset[str] = frozenset(("blockquote",))):
        super().__init__()
        self.skip, self.breaks = skip, breaks
        self.depth = dict.fromkeys(("blockquote", "li", "skip"), 0)
        self.found: list[dict] = []
        self.tag, self.parts, self.link = None, [], None

    def close_block(self):
        text = " ".join(" ".join(self.parts).split())
        if self.tag and text:
            self.found.append({"ord": len(self.found), "tag": self.tag, "text": text, "href": self.link, "in_blockquote": self.tag == "p" and self.depth["blockquote"] > 0, "in_list_item": self.depth["li"] > 0 and (self.tag == "p" or bool(self.skip))})
        self.tag, self.parts, self.link = None, [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.skip:
            self.close_block()
            self.depth["skip"] += 1
        elif self.depth["skip"]:
            return
        if tag in self.breaks and tag == "blockquote" or tag in self.BLOCKS:
            self.close_block()
        if tag in self.BLOCKS:
            self.tag = tag
        elif tag in ("blockquote", "li"):
            self.depth[tag] += 1
        elif tag == "a" and self.tag and self.tag != "p":
            self.link = next((v for k, v in reversed(attrs) if k == "href" and v), self.link)

    def handle_endtag(self, tag):
        if tag in self.skip and self.depth["skip"]:
            self.close_block()
            self.depth["skip"] -= 1
            return
        if self.depth["skip"]:
            return
        if tag in self.BLOCKS or tag in self.breaks:
            self.close_block()
        if tag in ("blockquote", "li"):
            self.depth[tag] = max(0, self.depth[tag] - 1)

    def handle_data(self, data):
        if self.tag and not self.depth["skip"]:
            self.parts.append(data)


def read_blocks(html: str | None, stories: bool = False) -> list[dict]:
    reader = BlockReader(frozenset(("script", "style")), frozenset(("li",))) if stories else BlockReader()
    reader.feed(html or "")
    return reader.found


@sliced_udf(NODES)
def block_nodes(html: str | None) -> list[dict]:
    """Headings and paragraphs of an article; a blockquote's start and end end a block."""
    return read_blocks(html)


@sliced_udf(NODES)
def story_nodes(html: str | None) -> list[dict]:
    """As block_nodes, without scripts and styles; the end of a list item ends a block."""
    return read_blocks(html, stories=True)


class _HeadingReader(HTMLParser):
    def __init__(self, tags: tuple[str, ...]):
        super().__init__()
        self.tags, self.inside, self.open, self.parts, self.found = tags, False, False, [], []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if self.inside and tag in self.tags:
            self.open, self.parts = True, []

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if self.open and tag in self.tags:
            text = " ".join(" ".join(self.parts).split())
            if text:
                self.found.append(text)
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.parts.append(data)


def read_headings(html: str | None, tags: tuple[str, ...]) -> list[str]:
    reader = _HeadingReader(tags)
    reader.feed(html or "")
    return reader.found


@sliced_udf("array<string>")
def article_headings(html: str | None) -> list[str]:
    """h2 and h3 inside the article."""
    return read_headings(html, ("h2", "h3"))


@sliced_udf("array<string>")
def article_h2(html: str | None) -> list[str]:
    return read_headings(html, ("h2",))


def presentation_headings(html: Column) -> Column:
    """Feed A: headings below 100 characters."""
    return F.filter(article_headings(html), lambda h: F.length(h) < 100)


def barred_headings(html: Column) -> Column:
    """Feed B: second-level headings with a bar, below 150 characters."""
    return F.filter(article_h2(html), lambda h: (F.length(h) < 150) & h.contains("|"))


class _TextEvents(HTMLParser):
    """(text, whether it is a link's) in order; a link's text comes at its end."""

    def __init__(self):
        super().__init__()
        self.found, self.link = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = []

    def handle_endtag(self, tag):
        if tag == "a" and self.link is not None:
            self.found.append((" ".join(self.link).strip(), True))
            self.link = None

    def handle_data(self, data):
        if self.link is not None:
            self.link.append(data)
        self.found.append((data, False))


@sliced_udf("array<struct<ord:int,text:string,is_link:boolean>>")
def text_events(html: str | None) -> list[dict]:
    reader = _TextEvents()
    reader.feed(html or "")
    return [{"ord": i, "text": t, "is_link": link} for i, (t, link) in enumerate(reader.found)]
