"""Search records, featured list, search, timelines and pages (AGG1, AGG2, AGG14, AGG16, FLT9, SRT2-SRT7, SRT9, DT3, DT7, SNK2, SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from .relational import globally_ranked, top_n


def company_records(companies: DataFrame, quotes: DataFrame, mentions: DataFrame, stories: DataFrame) -> DataFrame:
    """slug, name, quote_count, story_mentions_count, edition_count of companies with any coverage.

    One aggregate over all events of a company: its quotes, mentions and stories.
    """
    def events(df, kind):
        edition = F.col("edition_id") if "edition_id" in df.columns else F.lit(None)
        return df.select("company_id", F.lit(kind).alias("kind"), edition.cast("string").alias("edition_id"))

    seen = events(quotes, "q").union(events(mentions, "m")).union(events(stories, "s"))
    n = seen.groupBy("company_id").agg(F.count_if(F.col("kind") == "q").alias("quote_count"), F.count_if(F.col("kind") == "s").alias("story_mentions_count"), F.count_distinct("edition_id").alias("edition_count"))
    return companies.join(n, companies["id"] == n["company_id"]).select(F.col("id").alias("slug"), "name", "quote_count", "story_mentions_count", "edition_count")


def featured(records: DataFrame, curated: list, k: int = 5) -> DataFrame:
    """Curated slugs in their order; only if they are fewer than k, the most covered others behind them."""
    order = [F.desc(F.col("quote_count") + F.col("story_mentions_count")), F.desc("quote_count"), F.desc("story_mentions_count"), F.lower("name"), F.col("slug")]
    place = F.array_position(F.array(*[F.lit(x) for x in curated]), F.col("slug")) if curated else F.lit(0)
    first = records.where(F.col("slug").isin(curated)).withColumn("featured_rank", F.row_number().over(Window.orderBy(place)))
    missing = k - first.count()
    if missing <= 0:
        return first
    rest = top_n(records.where(~F.col("slug").isin(curated)), order, missing, "featured_rank")
    return first.unionByName(rest.withColumn("featured_rank", (F.col("featured_rank") + (k - missing)).cast("int")))


def search(records: DataFrame, query: str, k: int = 10, exclude: str | None = None, curated: list | None = None) -> DataFrame:
    """Names that contain the query: equal ones, then those that begin with it, then in the order of the language. A blank query gives the featured list."""
    q, low = query.strip().lower(), F.lower("name")
    if not q:
        return featured(records, curated or []).withColumnRenamed("featured_rank", "search_rank")
    hits = records.where(low.contains(q)) if exclude is None else records.where(low.contains(q) & (F.col("slug") != exclude))
    return top_n(hits, [low != q, ~low.startswith(q), F.collate(low, "UNICODE"), F.col("slug")], k, "search_rank")


def timeline(quotes: DataFrame, editions: DataFrame, visible: int = 2) -> DataFrame:
    """Per company, newest edition first, quotes by id as text; running number and the first few visible."""
    rows = quotes.join(editions.select(F.col("id").alias("edition_id"), F.col("date").alias("edition_date")), "edition_id")
    order = Window.partitionBy("company_id").orderBy(F.desc("edition_date"), F.desc("edition_id"), F.col("quote_id"))
    return rows.withColumn("quote_no", F.row_number().over(order)).withColumn("visible", F.col("quote_no") <= visible)


def timeline_spans(quotes: DataFrame, editions: DataFrame) -> DataFrame:
    rows = quotes.join(editions.select(F.col("id").alias("edition_id"), F.col("date").alias("edition_date")), "edition_id")
    g = rows.groupBy("company_id").agg(F.min("edition_date").alias("first"), F.max("edition_date").alias("last"), F.count_distinct("edition_id").alias("editions"), F.count("*").alias("quotes"))
    return g.withColumn("span", dates.span_label(F.col("first"), F.col("last")))


def nested_timeline(quotes: DataFrame, editions: DataFrame) -> DataFrame:
    """company -> editions -> quotes, nested; each list sorted."""
    rows = timeline(quotes, editions)
    per = rows.groupBy("company_id", "edition_id", "edition_date").agg(F.array_sort(F.collect_list(F.struct("quote_no", "quote_id"))).alias("quotes"))
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("edition_date", "edition_id", "quotes"))))
    return per.groupBy("company_id").agg(newest.alias("editions"))


def latest_update(days: list[DataFrame], today: str) -> DataFrame:
    """Latest date of several tables (day), and its distance from `today` in words."""
    every = days[0].select("day")
    for d in days[1:]:
        every = every.union(d.select("day"))
    t = F.lit(today).cast("date")
    return every.agg(F.coalesce(F.max("day"), t).alias("updated")).withColumn("relative", dates.relative_label(F.col("updated"), t))


QUOTE_CARD = '<article class="quote" data-no="{{ no }}"><p>{{ text }}</p><footer>{{ speaker }}</footer></article>'
PAGE = "<!doctype html><title>{{ name }}</title><h1>{{ name }}</h1>{{ quotes }}"


def quote_card(no: Column, value: Column, speaker: Column) -> Column:
    return text.fill_template(F.lit(QUOTE_CARD), {"no": F.format_string("%02d", no), "text": text.html_escape(value), "speaker": text.html_escape(F.coalesce(speaker, F.lit("")))})


def company_pages(companies: DataFrame, quotes: DataFrame, editions: DataFrame) -> DataFrame:
    """(slug, html): one page for each company with quotes, cards in timeline order."""
    rows = timeline(quotes, editions).withColumn("card", quote_card(F.col("quote_no"), F.col("text"), F.col("speaker")))
    cards = rows.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("quote_no", "card"))), lambda x: x["card"]), "").alias("cards"))
    made = companies.join(cards, companies["id"] == cards["company_id"])
    return made.select(F.col("id").alias("slug"), text.fill_template(F.lit(PAGE), {"name": text.html_escape(F.col("name")), "quotes": F.col("cards")}).alias("html"))


STORY_ITEM = '<li><a href="{{ url }}">{{ title }}</a><p>{{ date }} · {{ mentions }}</p></li>'


def story_item(title: Column, url: Column, date: Column, mentions: Column) -> Column:
    n = F.when(mentions == 1, F.lit("1 mention")).otherwise(F.concat(mentions.cast("string"), F.lit(" mentions")))
    return text.fill_template(F.lit(STORY_ITEM), {"url": text.html_escape(F.coalesce(url, F.lit(""))), "title": text.html_escape(F.coalesce(title, F.lit("Story"))), "date": text.html_escape(dates.story_label(date)), "mentions": n})


def story_sections(ranked: DataFrame, by: str = "company_id") -> DataFrame:
    """(company, stories, html): its first stories in view, the others behind a fold (SNK3, SRT3).

    ranked: the rows of `mentions.ranked_stories`, with story_url. A company's section is one row, as it is one page.
    """
    item = story_item(F.col("story_title"), F.col("story_url"), F.col("story_date"), F.col("mention_count"))

    def items(shown: Column) -> Column:
        chosen = F.array_sort(F.collect_list(F.when(shown, F.struct("story_rank", item.alias("item")))))
        return F.array_join(F.transform(chosen, lambda x: x["item"]), "")

    g = ranked.groupBy(by).agg(F.count_distinct("story_id").alias("stories"), F.count_if(~F.col("visible")).alias("_more"), items(F.col("visible")).alias("_first"), items(~F.col("visible")).alias("_rest"))
    fold = F.when(F.col("_more") > 0, F.concat(F.lit("<details><summary>Show "), F.col("_more").cast("string"), F.lit(" more stories</summary><ol>"), "_rest", F.lit("</ol></details>"))).otherwise(F.lit(""))
    return g.select(by, "stories", F.concat(F.lit("<section><p>"), F.col("stories").cast("string"), F.lit(" story mentions</p><ol>"), "_first", F.lit("</ol>"), fold, F.lit("</section>")).alias("html"))


def matched_stories(mentions: DataFrame) -> DataFrame:
    """How many different stories have a mention, and of how many companies (AGG16)."""
    return mentions.agg(F.count_distinct("story_id").alias("stories"), F.count_distinct("company_id").alias("companies"))


def index_page(records: DataFrame, curated: list, k: int = 5) -> DataFrame:
    """One row of html: the number of companies and the featured ones with their counts (SNK2)."""
    line = F.concat(F.lit('<li><a href="/company/'), F.col("slug").cast("string"), F.lit('/">'), text.html_escape(F.col("name")), F.lit("</a> "), F.col("quote_count").cast("string"), F.lit(" quotes</li>"))
    chosen = featured(records, curated, k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("featured_rank", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    n = records.agg(F.count("*").alias("n"))
    # One row each.
    return n.join(chosen).select(F.concat(F.lit("<h1>"), F.col("n").cast("string"), F.lit(" companies</h1><ol>"), "lines", F.lit("</ol>")).alias("html"))


def companies_by_name(records: DataFrame) -> DataFrame:
    """Numbered by name, whatever the case (SRT6)."""
    return globally_ranked(records, [F.lower("name"), F.col("slug")], "place")


def newest_posts_first(posts: DataFrame) -> DataFrame:
    """Numbered by date, then address, both descending (SRT7)."""
    return globally_ranked(posts, [F.desc("date"), F.desc("url")], "place")


def universe_by_symbol(universe: DataFrame) -> DataFrame:
    return globally_ranked(universe, [F.col("symbol")], "place")


def script_json(value: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))
