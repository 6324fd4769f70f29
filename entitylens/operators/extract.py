"""Posts and stories from pages (DOC12-DOC17): one state machine for each page, pages side by side."""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, html, predicates, text, urls
from ..functions import vocabulary as V
from ..functions.udfs import sliced_udf
from ..sources.rules import NameRules, SiteRules
from .graph import checkpointed
from .relational import dealt


def editions(pages: DataFrame, site: SiteRules) -> DataFrame:
    """pages (url, html) -> editions (url, edition_id, title, date, article) whose title fits the site's pattern."""
    # As a generated column the title is made once, and its filter stays behind whatever deals the pages out.
    made = pages.select("url", "html", F.explode(F.array(html.page_title(F.col("html")))).alias("title")).where(predicates.is_target_title(F.col("title"), site.title_include, site.title_exclude))
    plain = F.lower("title").isin(site.generic_titles)
    shown = F.when(plain, F.coalesce(F.nullif(text.title_from_path(urls.url_path(F.col("url"))), F.lit("")), F.col("title"))).otherwise(F.col("title"))
    return made.select("url", urls.edition_id(F.col("url"), F.col("title")).alias("edition_id"), shown.alias("title"), F.coalesce(html.published_date(F.col("html")), F.lit("")).alias("date"), html.article(F.col("html")).alias("article"))


#: What the state machine reads of a block.
NODE = ("url", "edition_id", "ord", "tag", "text", "heading", "in_blockquote", "in_list_item", "name", "company_id", "listing", "probable", "sector_like", "listable", "sector_hint", "hint_listable", "speaker_line", "direct_quote", "quote", "speaker")
Node = namedtuple("Node", NODE)


def prepared_nodes(posts: DataFrame, site: SiteRules, names: NameRules) -> DataFrame:
    """A row for each block with all that the state machine asks of it; native, so that the machine itself only keeps state."""
    nodes = posts.select("url", "edition_id", F.inline(html.block_nodes("article")))
    parts = text.heading_parts(F.col("text"))
    # Names are read of headings and list items, sectors of headings, speakers and quotes of paragraphs; most blocks are long paragraphs.
    nodes = nodes.withColumn("heading", F.col("tag") != "p").withColumn("name", F.when(F.col("heading"), parts["name"]).when(F.col("in_list_item"), text.company_name(F.col("text"))))
    nodes = nodes.withColumn("direct_quote", F.when(~F.col("heading"), text.is_direct_quote(F.col("text"))))
    nodes = nodes.withColumn("hint", F.when(F.col("heading"), parts["hint"]))
    nodes = nodes.withColumn("listing", F.when(F.col("heading"), urls.canonical_listing(urls.absolute(F.col("href"), site.base_url), site.listing_hosts)))
    probable = predicates.is_probable_company(F.col("name"), F.col("listing").isNotNull(), names.exact_keys, names.patterns, names.allow_keys, site.own_titles)
    split = F.when(F.col("direct_quote"), text.quote_and_speaker(F.col("text")))
    of_heading = lambda x: F.when(F.col("heading"), x)
    made = {
        "in_blockquote": F.coalesce("in_blockquote", F.lit(False)), "in_list_item": F.coalesce("in_list_item", F.lit(False)), "company_id": text.slugify(F.col("name")), "probable": F.when(F.col("name").isNotNull(), probable),
        "sector_like": of_heading(predicates.is_sector_like(F.col("text"))), "listable": of_heading(predicates.is_listable_sector(F.col("text"))),
        "sector_hint": F.when(predicates.is_sector_like(F.col("hint")), F.col("hint")), "hint_listable": F.coalesce(predicates.is_listable_sector(F.col("hint")), F.lit(False)),
        "speaker_line": F.when(~F.col("heading"), text.is_speaker_line(F.col("text"))), "quote": split["quote"], "speaker": split["speaker"],
    }
    return nodes.select(*[made.get(x, F.col(x)).alias(x) for x in NODE])


_SPLITS = tuple(re.compile(p) for p in (r"^(.+?)\s+[–—-]\s+(.+)$", r'^(.+?[”"])\s*[–—-]\s*(.+)$'))


def plausible_speaker(value: str) -> bool:
    if not 3 <= len(value) <= 90 or "%" in value or not re.search("[A-Za-z]", value) or sum(map(str.isdigit, value)) > 1:
        return False
    if value.lower().startswith(tuple(V.SPEAKER_TITLES)) or "," in value:
        return True
    words = re.findall("[A-Za-z][A-Za-z.&']*", value)
    return 1 <= len(words) <= 6 and all(w[0].isupper() for w in words)


def _unquoted(x: str) -> str:
    return x.strip().strip(text.QUOTES).strip()


def split_quote(value: str) -> tuple[str, str | None]:
    """As text.quote_and_speaker, for quotes that the machine has joined from several blocks."""
    value = value.strip()
    for pattern in _SPLITS:
        if m := pattern.match(value):
            quote, speaker = _unquoted(m[1]), _unquoted(m[2])
            if quote and speaker and plausible_speaker(speaker):
                return quote, speaker
    return value.strip(text.QUOTES), None


def slug(x: str) -> str:
    return re.sub("[^a-z0-9]+", "-", x.lower().strip()).strip("-") or "unknown"


@dataclass
class PageReader:
    """Reads the prepared blocks of one page; see `prepared_nodes` for what a block knows."""

    url: str
    edition: str
    companies: dict = field(default_factory=dict)
    quotes: list = field(default_factory=list)
    mentions: dict = field(default_factory=dict)  # by company, in the order of their first mention
    sector: str | None = None
    sector_listable: bool = False
    company: str | None = None
    context: str | None = None
    quoted: list = field(default_factory=list)

    def know(self, node) -> str | None:
        """Registers a block's company; a later name counts if it is shorter, a link if there was none."""
        if not node.name or not node.probable:
            return None
        known = self.companies.setdefault(node.company_id, {"id": node.company_id, "name": node.name, "listing_url": node.listing})
        known["listing_url"] = known["listing_url"] or node.listing
        if len(node.name) < len(known["name"]):
            known["name"] = node.name
        return node.company_id

    def mention(self, company: str, kind: str):
        known = self.mentions.get(company)
        if known is None:
            self.mentions[company] = {"id": slug(f"{self.edition}-{company}-{kind}-{len(self.mentions)}"), "company_id": company, "sector": self.sector, "mention_type": kind}
            return
        if kind == "heading":
            known["mention_type"] = kind
        if self.sector and (kind == "heading" or not known["sector"]):
            known["sector"] = self.sector

    def quote(self, value: str, speaker: str | None):
        value = _unquoted(value)
        if self.company and value:
            self.quotes.append({"id": slug(f"{self.edition}-{self.company}-{len(self.quotes)}"), "company_id": self.company, "sector": self.sector, "text": value, "context": self.context, "speaker": speaker})
            self.mention(self.company, "heading")
            self.context = None

    def end_blockquote(self):
        parts, self.quoted = self.quoted, []
        if not parts or not self.company:
            return
        value, speaker = split_quote(" ".join(n.text for n in parts))
        if not speaker and len(parts) > 1 and parts[-1].speaker_line:
            value, speaker = " ".join(n.text for n in parts[:-1]), parts[-1].text.lstrip("-–— ").strip()
        self.quote(value, speaker)

    def read(self, node):
        if node.in_blockquote:
            if self.company:
                self.quoted.append(node)
            return
        self.end_blockquote()
        if node.heading:
            self.read_heading(node)
        elif node.in_list_item:
            if self.sector and self.sector_listable and (listed := self.know(node)):
                self.mention(listed, "list")
            self.company = self.context = None
        elif self.company and node.speaker_line and self.quotes and self.quotes[-1]["company_id"] == self.company and not self.quotes[-1]["speaker"]:
            self.quotes[-1]["speaker"] = node.text.lstrip("-–— ").strip()
        elif self.company and node.direct_quote:
            self.quote(node.quote, node.speaker)
        else:
            self.context = node.text

    def read_heading(self, node):
        structured = bool(node.listing) or "|" in node.text or node.tag == "h3" and node.probable
        found = self.know(node) if structured and node.name else None
        if found:
            if node.sector_hint:
                self.sector, self.sector_listable = node.sector_hint, node.hint_listable
        elif node.sector_like:
            self.sector, self.sector_listable = node.text, node.listable
        self.company, self.context = found, None
        if found:
            self.mention(found, "heading")

    def rows(self):
        self.end_blockquote()
        for kind, items in (("company", self.companies.values()), ("quote", self.quotes), ("mention", self.mentions.values())):
            for n, x in enumerate(items):
                if kind != "company" or x["id"] in self.mentions:
                    yield {"url": self.url, "edition_id": self.edition, "kind": kind, "ord": n, **x}


PARSED = {"url": "string", "edition_id": "string", "kind": "string", "ord": "int", "id": "string", "name": "string", "listing_url": "string", "company_id": "string", "sector": "string", "mention_type": "string", "text": "string", "context": "string", "speaker": "string"}


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their pages, in batches that may end within a page, to the rows of the pages; one page's blocks are held at a time."""
    schema = pa.schema([(k, {"string": pa.string(), "int": pa.int32()}[v]) for k, v in PARSED.items()])
    made: list[dict] = []
    nodes = (node for batch in batches for node in map(Node._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)))
    for key, blocks in groupby(nodes, key=lambda n: (n.url, n.edition_id)):
        reader = PageReader(*key)
        for node in sorted(blocks, key=lambda n: n.ord):
            reader.read(node)
        made += reader.rows()
        if len(made) >= 2000:
            yield pa.RecordBatch.from_pylist(made, schema)
            made = []
    yield pa.RecordBatch.from_pylist(made, schema)


def parse_posts(posts: DataFrame, site: SiteRules, names: NameRules) -> DataFrame:
    """Companies, quotes and mentions of each edition in one table, told apart by `kind`."""
    schema = ", ".join(f"{k} {v}" for k, v in PARSED.items())
    # Pages that share an address are read as one, so they have to be neighbours; their blocks, which are made afterwards, then are.
    posts = dealt(posts.select("url", "edition_id", "article"), "url", "edition_id").sortWithinPartitions("url", "edition_id", "article")
    return prepared_nodes(posts, site, names).mapInArrow(read_pages, schema)


def merged_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Across posts, in the order of their URLs: the first company of an id wins, quotes and mentions add up (DED2, SET2)."""
    parsed = checkpointed(parsed)  # read by three tables, parsed once
    first = Window.partitionBy("id").orderBy("url", "ord")
    companies = parsed.where("kind = 'company'").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    quotes = parsed.where("kind = 'quote'").select("id", "edition_id", "company_id", "sector", "text", "context", "speaker", F.col("url").alias("source_url"))
    mentions = parsed.where("kind = 'mention'").select("id", "edition_id", "company_id", "sector", F.col("url").alias("source_url"), "mention_type")
    return {"companies": companies.select("id", "name", F.col("listing_url").alias("url")), "quotes": quotes, "mentions": mentions}


# Stories (DOC13-DOC16)


def phrase(x: str) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", x.lower().replace("&", " and ")).split())


def heading_score(a: str, b: str) -> float:
    """Equal 1, one inside the other 0.92, else the similarity ratio (SIM2)."""
    a, b = phrase(a), phrase(b)
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.92 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


_MARKER = re.compile("in today['’]s edition", re.IGNORECASE)


def _breaks(x: str) -> bool:
    key = phrase(x)
    return key in V.HARD_BREAKS or key.startswith((*V.PROMO_PREFIXES, "thank you for reading"))


def _is_story(x: str, post_title: str) -> bool:
    key = phrase(x)
    return bool(key) and key != phrase(post_title) and key not in V.NON_STORY_HEADINGS and not _breaks(x)


def intro_titles(nodes: list[dict]) -> list[str]:
    """List items behind the marker paragraph up to the list's end, each key once."""
    at = next((i for i, n in enumerate(nodes) if n["tag"] == "p" and _MARKER.search(n["text"])), None)
    found: dict[str, str] = {}
    begun = False
    for n in nodes[at + 1 :] if at is not None else ():
        if n["tag"] == "p" and n["in_list_item"]:
            begun = True
            title = " ".join(n["text"].strip().strip("-• ").split())
            if phrase(title):
                found.setdefault(phrase(title), title)
        elif begun:
            break
    return list(found.values())


def story_heads(nodes: list[dict], post_title: str) -> list[tuple[str, int | None, str]]:
    """(title, anchor, source) by anchor: intro titles with their best headings, else all first-level headings, else the first of the second level."""
    good = [(i, n["text"], n["tag"]) for i, n in enumerate(nodes) if n["tag"] != "p" and _is_story(n["text"], post_title)]
    tops, used, heads = [(i, t) for i, t, tag in good if tag == "h1"], set(), []
    for title in intro_titles(nodes):
        free = [(heading_score(title, t), -i, t) for i, t, _ in good if i not in used]
        score, at, text_ = max(free, default=(0.0, 0, ""), key=lambda x: x[:2])
        if score >= 0.55:
            used.add(-at)
            heads.append((text_, -at, "intro_list+heading"))
        else:
            heads.append((title, None, "intro_list"))
    if not heads:
        second = [(t, i, "h2_fallback") for i, t, tag in good if tag == "h2"][:1]
        heads = [(t, i, "h1") for i, t in tops] or second
    spare = iter([i for i, _ in tops if i not in used])
    placed = []
    for title, at, source in heads:
        if at is None and (other := next(spare, None)) is not None:
            at, source = other, "intro_list+h1_fallback"
        placed.append((title, at, source))
    once: dict[str, tuple] = {}
    for head in placed:
        if phrase(head[0]):
            once.setdefault(phrase(head[0]), head)
    return sorted(once.values(), key=lambda h: (10**9 if h[1] is None else h[1], phrase(h[0])))


def stories(nodes: list[dict], post_title: str, path: str) -> list[dict]:
    def text_of(title: str, some: list[dict]) -> str:
        return "\n".join([title, *[n["text"].strip() for n in some if n["tag"] == "p"]]).strip()

    heads = story_heads(nodes, post_title)
    if not heads:
        title = post_title.strip() or "Story"
        return [{"story_id": slug(f"{path}-{title}"), "title": title, "position": 1, "source": "single_fallback", "text": text_of(title, nodes)}]
    out, anchors = [], [h[1] for h in heads if h[1] is not None]
    for position, (title, at, source) in enumerate(heads, 1):
        value = text_of(title, nodes)
        if at is not None:
            end = next((x for x in anchors if x > at), len(nodes)) if at != anchors[-1] else len(nodes)
            end = next((i for i in range(at + 1, end) if nodes[i]["tag"] != "p" and _breaks(nodes[i]["text"])), end)
            part = text_of(title, nodes[at + 1 : end])
            value = part if len(part.split()) >= 30 else value
        out.append({"story_id": slug(f"{path}-{position}-{title}"), "title": title, "position": position, "source": source, "text": value})
    return out


@sliced_udf("array<struct<story_id:string,title:string,position:int,source:string,text:string>>")
def page_stories(nodes: list[dict] | None, title: str | None, path: str | None) -> list[dict]:
    return stories(nodes or [], title or "", path or "")


def parse_story_posts(pages: DataFrame) -> DataFrame:
    """pages (url, html, lastmod) -> url, title, date, content_hash and a row for each story."""
    h, payload = F.col("html"), html.preload(F.col("html"))

    def some(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(x, F.lit("")) for x in options], F.lit(""))

    made = pages.withColumn("_title", some(F.trim(payload["title"]), html.meta_title(h), text.title_from_path(urls.url_path(F.col("url")))))
    made = made.withColumn("_date", some(dates.iso_date(payload["post_date"]), dates.iso_date(html.meta(h, "article:published_time")), html.json_ld_date(h), F.col("lastmod")))
    made = made.withColumn("_body", some(payload["body_html"], html.article(h, fallback=False)))
    made = made.select("url", F.col("_title").alias("post_title"), F.col("_date").alias("date"), text.content_hash(F.col("_body")).alias("content_hash"), html.story_nodes("_body").alias("nodes"))
    made = made.select("url", "post_title", "date", "content_hash", F.inline(page_stories("nodes", "post_title", urls.url_path(F.col("url")))))
    return made.withColumn("text", F.trim("text")).withColumn("word_count", text.word_count(F.col("text")))


def story_rows(posts: DataFrame, default_title: str = "Story") -> DataFrame:
    """posts (url, title, date, stories) -> a row for each story with text; missing titles and ids are made up from what there is (JSN1)."""
    rows = posts.select("url", F.col("title").alias("post_title"), F.col("date").alias("story_date"), F.inline("stories"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("post_title"), F.lit("")), F.lit(default_title))
    rows = rows.withColumn("story_title", title)
    made_up = text.slugify(F.concat_ws("-", "url", F.coalesce("position", F.lit(0)).cast("string"), "story_title"))
    rows = rows.withColumn("story_id", F.coalesce(F.nullif(F.trim("story_id"), F.lit("")), made_up))
    return rows.where(F.coalesce(F.trim("text"), F.lit("")) != "").select("url", "post_title", "story_date", "story_id", "story_title", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("source", F.lit("")).alias("source"), F.trim("text").alias("text"))


# Editions of the coverage feeds (DOC17), transcripts (DOC6)


def feed_editions(pages: DataFrame, headings, keep_empty: bool) -> DataFrame:
    """url, title, date, companies: one row for each edition of a feed."""
    # A generated column, as in `editions`: else the filter would read every page once more, before pages are dealt out.
    made = pages.select("url", F.coalesce(html.tag_text(F.col("html"), "title"), F.lit("")).alias("title"), html.tracker_date(F.col("html")).alias("date"), F.explode(F.array(headings(F.col("html")))).alias("companies"))
    return made if keep_empty else made.where(F.size("companies") > 0)


def transcript_dates(pages: DataFrame) -> DataFrame:
    """Each transcript link takes the month named last before it: url, date."""
    month = r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{4})\b"
    events = pages.select("url", F.inline(html.text_events("html")))
    found = F.regexp_extract_all("text", F.lit(month), F.lit(0))
    events = events.withColumn("month", F.when(~F.col("is_link") & (F.size(found) > 0), dates.month_start(F.regexp_replace(F.element_at(found, -1), r"\s+", " "))))
    seen = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("date", F.last("month", ignorenulls=True).over(seen))
    return events.where(F.col("is_link") & F.col("text").rlike("(?i)transcript") & F.col("date").isNotNull()).select("url", "ord", "date")
