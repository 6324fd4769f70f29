"""Queries of scalar functions: names, headings, quotes, URLs, pages, dates, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, html, predicates, text, urls
from ..functions import similarity as S
from ..functions import vocabulary as V
from ..operators import serve
from ..sources import web
from .tables import HOSTS, table

#: A spelling of each part's name, by its key; both engines read it.
NAME = "p_name || CASE p_partkey % 10 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' & Co.' WHEN 2 THEN ' AMC' WHEN 3 THEN ' (Q3)' WHEN 4 THEN ' | Mid Cap | Metals' WHEN 5 THEN ' - notes' WHEN 6 THEN ' Technologies Inc' WHEN 7 THEN ' L''Oréal' WHEN 8 THEN ' Company Limited' ELSE '' END"
QUOTE = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' grew – Ravi Kumar, CFO' WHEN 1 THEN ' grew 10 - 12% next year' WHEN 2 THEN ' \"well\" — Management' WHEN 3 THEN ' fell - one two three four five six seven' WHEN 4 THEN ' rose - Anna Smith' ELSE ' stays' END"
URL = "CASE p_partkey % 7 WHEN 0 THEN 'https://www.market.example/markets/stocks/nse/' || replace(p_brand, '#', '') || '/?x=1' WHEN 1 THEN 'https://market.example/markets/stocks/search' WHEN 2 THEN 'https://market.example/markets/stocks/NYSE/X/' WHEN 3 THEN 'https://market.example/markets/stocks/' || replace(p_name, ' ', '-') WHEN 4 THEN 'https://other.example/markets/stocks/NSE/X/' WHEN 5 THEN 'http://market.example/markets/stocks/BSE/' || replace(p_type, ' ', '_') || '#top' END"
TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'Banking and Financial Services' WHEN 1 THEN 'Edition # ' || p_size WHEN 2 THEN 'Telecom Minister on ' || p_name WHEN 3 THEN 'We think this ' || p_name || ' grows' ELSE p_name END"

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


SLUG = "coalesce(nullif(trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"
#: Key of a company name in DuckDB.
TOKENS = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.TOKEN_EQUIVALENTS.items()) + " ELSE t END)"
COMPANY_KEY = f"regexp_replace(regexp_replace(array_to_string({TOKENS}, ' '), '(^| )amc$', '\\1asset management company'), '(?:(?:^| )(?:{'|'.join(V.LEGAL_SUFFIXES)}))+$', '')"


@query("q01_slugify", f"SELECT p_partkey, {SLUG.format(f'({NAME})')} AS slug FROM part UNION ALL SELECT -1 - c_custkey, {SLUG.format('c_name')} FROM customer")
def q01(spark, d):
    p = table(spark, d, "part").select("p_partkey", text.slugify(F.expr(NAME)).alias("slug"))
    return p.union(table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("p_partkey"), text.slugify(F.col("c_name")).alias("slug")))


@query("q02_name_key_variants", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS name_key, md5(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))) AS phrase_key FROM documents")
def q02(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.name_key(F.col("text"))).alias("name_key"), F.md5(text.phrase_key(F.col("text"))).alias("phrase_key"))


@query("q03_strip_suffix_tokens", f"SELECT p_partkey, {COMPANY_KEY.format(f'({NAME})')} AS company_key, regexp_replace(array_to_string(regexp_extract_all(lower({NAME}), '[a-z0-9&]+'), ' '), '(?:(?:^| )(?:{'|'.join(V.TRACKER_SUFFIXES)}))+$', '') AS tracker_key FROM part")
def q03(spark, d):
    n = F.expr(NAME)
    return table(spark, d, "part").select("p_partkey", text.company_key(n).alias("company_key"), text.tracker_key(n).alias("tracker_key"))


@query(
    "q04_heading_split",
    f"""WITH n AS (SELECT p_partkey, {NAME} AS x FROM part), s AS (SELECT *, list_filter(list_transform(string_split(x, '|'), lambda p: trim(p)), lambda p: p <> '') AS parts, contains(x, '|') AS barred FROM n),
    b AS (SELECT p_partkey, CASE WHEN barred THEN parts[1] ELSE x END AS y, CASE WHEN barred AND len(parts) >= 2 THEN parts[-1] END AS hint FROM s)
    SELECT p_partkey, trim(regexp_replace(trim(split_part(split_part(split_part(y, ' — ', 1), ' - ', 1), ' | ', 1)), '\\s*\\([^)]*\\)\\s*$', '')) AS name, hint FROM b""",
)
def q04(spark, d):
    p = text.heading_parts(F.expr(NAME))
    return table(spark, d, "part").select("p_partkey", p["name"].alias("name"), p["hint"].alias("hint"))


@query(
    "q05_quote_speaker_split",
    f"""WITH n AS (SELECT p_partkey, {QUOTE} AS x FROM part),
    s AS (SELECT *, trim(trim(trim(regexp_extract(x, '^(.+?)\\s+[–—-]\\s+(.+)$', 1)), '"“”')) AS q, trim(trim(trim(regexp_extract(x, '^(.+?)\\s+[–—-]\\s+(.+)$', 2)), '"“”')) AS p FROM n),
    k AS (SELECT *, q <> '' AND length(p) BETWEEN 3 AND 90 AND NOT contains(p, '%') AND regexp_matches(p, '[A-Za-z]') AND length(regexp_replace(p, '[^0-9]', '', 'g')) <= 1
      AND (regexp_matches(lower(p), '^(management|ceo|cfo|md|chairman|analyst)') OR contains(p, ',') OR (len(regexp_extract_all(p, '[A-Za-z][A-Za-z.&'']*')) BETWEEN 1 AND 6 AND len(list_filter(regexp_extract_all(p, '[A-Za-z][A-Za-z.&'']*'), lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0)) AS ok FROM s)
    SELECT p_partkey, CASE WHEN ok THEN q ELSE trim(x, '"“”') END AS quote, CASE WHEN ok THEN p END AS speaker FROM k""",
)
def q05(spark, d):
    p = text.quote_and_speaker(F.expr(QUOTE))
    return table(spark, d, "part").select("p_partkey", p["quote"].alias("quote"), p["speaker"].alias("speaker"))


@query(
    "q06_initialism",
    """WITH w AS (SELECT DISTINCT p_name AS long FROM part), l AS (SELECT long, string_split(long, ' ') AS t, array_to_string(list_transform(string_split(long, ' '), lambda x: x[1]), '') AS ini FROM w),
    s AS (SELECT DISTINCT lower(substr(n_name, 1, 1)) || lower(substr(p_type, 1, 1)) AS short FROM nation CROSS JOIN part UNION SELECT DISTINCT ini FROM l)
    SELECT short, long, short = ini AS is_initialism FROM s CROSS JOIN l""",
)
def q06(spark, d):
    long = table(spark, d, "part").select(F.col("p_name").alias("long")).distinct()
    n = table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 1)).alias("a")).distinct()
    t = table(spark, d, "part").select(F.lower(F.substring("p_type", 1, 1)).alias("b")).distinct()
    short = n.crossJoin(F.broadcast(t)).select(F.concat("a", "b").alias("short")).union(long.select(text.initials(F.split("long", " ")))).distinct()
    # Few distinct values on both sides: every pair is the result.
    return short.crossJoin(F.broadcast(long)).select("short", "long", text.full_initialism(F.array("short"), F.split("long", " ")).alias("is_initialism"))


@query("q07_links", "SELECT page_id, len(l)::INTEGER AS n_links, array_to_string(list_sort(list_distinct(list_transform(l, lambda x: CASE WHEN starts_with(x, '/') THEN 'https://news.example' || x ELSE x END))), '|') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1) AS l FROM pages)")
def q07(spark, d):
    l = urls.links(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(l).alias("n_links"), F.array_join(F.array_sort(F.array_distinct(F.transform(l, lambda x: urls.absolute(x, "https://news.example")))), "|").alias("links"))


@query("q07b_sitemap_posts", "SELECT DISTINCT 'https://news.example' || x AS url FROM (SELECT unnest(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1)) AS x FROM pages) WHERE starts_with(x, '/th')")
def q07b(spark, d):
    return web.sitemap_posts(table(spark, d, "pages"), "https://news.example", "/th")


@query("q08_article_slice", "SELECT page_id, md5(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)) AS article FROM pages")
def q08(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(html.article(F.col("html"), fallback=False)).alias("article"))


@query("q09_title_cascade", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ''), trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))) AS title FROM pages")
def q09(spark, d):
    return table(spark, d, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query(
    "q10_canonical_url",
    rf"""WITH u AS (SELECT p_partkey, {URL} AS url FROM part),
    h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS p FROM u),
    k AS (SELECT *, host = 'market.example' AND len(p) >= 3 AS ok FROM h)
    SELECT p_partkey, CASE WHEN ok AND len(p) = 3 AND NOT regexp_matches(lower(p[3]), '^(search$|http|www)') AND regexp_matches(p[3], '^[A-Za-z0-9._-]+$') THEN 'https://market.example/markets/stocks/' || p[3] || '/'
      WHEN ok AND len(p) = 4 AND upper(p[3]) IN ('NSE', 'BSE') AND regexp_matches(upper(p[4]), '^[A-Z0-9._&-]+$') THEN 'https://market.example/markets/stocks/' || upper(p[3]) || '/' || upper(p[4]) || '/' END AS canonical,
      CASE WHEN ok AND len(p) = 4 AND upper(p[3]) IN ('NSE', 'BSE') AND regexp_matches(upper(p[4]), '^[A-Z0-9._&-]+$') THEN upper(p[3]) || ':' || upper(p[4]) END AS market_key FROM k""",
)
def q10(spark, d):
    u = F.expr(URL)
    return table(spark, d, "part").select("p_partkey", urls.canonical_listing(u, HOSTS).alias("canonical"), urls.market_key(u, HOSTS).alias("market_key"))


@query("q10b_page_urls", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def q10b(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"))


@query("q11_date_labels", "SELECT o_orderkey, strftime(o_orderdate, '%b''%y') AS month_label, strftime(o_orderdate, '%d %b %Y') AS story_label FROM orders")
def q11(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", dates.month_label(day).alias("month_label"), dates.story_label(day).alias("story_label"))


@query("q12_latest_update", "WITH u AS (SELECT greatest((SELECT max(o_orderdate) FROM orders)::DATE, (SELECT max(ts) FROM events)::DATE) AS updated) SELECT updated, CASE WHEN date_diff('day', updated, DATE '2024-02-10') <= 0 THEN 'today' WHEN date_diff('day', updated, DATE '2024-02-10') = 1 THEN '1 day ago' ELSE date_diff('day', updated, DATE '2024-02-10') || ' days ago' END AS relative FROM u")
def q12(spark, d):
    return serve.latest_update([table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), table(spark, d, "events").select(F.col("ts").cast("date").alias("day"))], "2024-02-10")


@query("q13_edition_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ') AND NOT contains(lower(text), '%%%') AND NOT contains(lower(text), '!!')")
def q13(spark, d):
    return table(spark, d, "documents").where(predicates.is_target_title(F.col("text"), "the ", ["%%%", "!!"])).select("doc_id")


@query(
    "q14_topic_filter",
    f"""WITH n AS (SELECT p_partkey, {TITLE} AS x FROM part), w AS (SELECT *, list_transform(regexp_extract_all(x, '[A-Za-z0-9&''.-]+'), lambda t: lower(t)) AS t, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS k FROM n),
    e AS (SELECT *, regexp_matches(k, '^edition\\s*\\d+$') OR (list_contains(string_split(k, ' '), 'edition') AND len(string_split(k, ' ')) <= 4) AS edition FROM w)
    SELECT p_partkey, (k IN {_list(V.SECTOR_HEADINGS)} OR edition OR len(list_filter(string_split(k, ' '), lambda z: z <> 'and' AND z NOT IN {_list(V.SECTOR_WORDS)})) = 0) AS sector_like,
      (coalesce(t[1], '') IN {_list(V.SENTENCE_STARTS)} AND len(t) > 4) OR regexp_matches(array_to_string(t, ' '), '\\bcomments?\\s+on\\b')
      OR (list_contains(t, 'on') AND len(t) >= 4 AND NOT list_has_any(t, [{', '.join("'" + x + "'" for x in V.COMPANY_HINTS)}])) OR (list_contains(t, 'on') AND list_has_any(t, ['minister', 'secretary'])) AS topic FROM e""",
)
def q14(spark, d):
    t = F.expr(TITLE)
    return table(spark, d, "part").select("p_partkey", predicates.is_sector_like(t).alias("sector_like"), predicates.is_topic_or_sentence(t).alias("topic"))


@query("q14b_non_company", f"SELECT p_partkey, (trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) = 'banking and financial services' OR regexp_matches(x, '(?i)^we\\b') OR regexp_matches(x, '(?i)\\bminister\\b.*\\bon\\b')) AND NOT regexp_matches(x, '^Telecom Minister on red widget$') AS non_company FROM (SELECT p_partkey, {TITLE} AS x FROM part)")
def q14b(spark, d):
    made = predicates.matches_rules(F.expr(TITLE), ["banking and financial services"], [r"^we\b", r"\bminister\b.*\bon\b"], ["telecom minister on red widget"])
    return table(spark, d, "part").select("p_partkey", made.alias("non_company"))


@query("q41_content_hash", r"SELECT doc_id, sha1(text) AS content_hash, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS word_count FROM documents")
def q41(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.word_count(F.col("text")).alias("word_count"))


@query("q42_json_props", "SELECT event_type, (props->>'$.k')::INTEGER % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def q42(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_type", (k % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("q42b_html_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM documents")
def q42b(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.html_escape(F.col("text"))).alias("escaped"))


@query("q53_name_compat")
def q53(spark, d):
    """Pairs of spellings of part names that are compatible, and by which rule."""
    from ..operators import resolution
    from .tables import companies

    rows = companies(spark, d).withColumn("name", F.initcap("name")).select("name").distinct()
    pairs = resolution.block_pairs(resolution.with_blocks(rows, "name"), ["name"], "name").toDF("l", "r")
    a, b = text.company_key(F.col("l")), text.company_key(F.col("r"))
    # The similarity is computed only where the lengths leave it a chance.
    near = F.when(S.quick_bound(a, b) >= S.SAME_NAME, a)
    made = pairs.where((a != "") & (b != "")).select("l", "r", S.decided_compatible(F.col("l"), F.col("r")).alias("by_rule"), F.coalesce(S.ratio(near, b) >= S.SAME_NAME, F.lit(False)).alias("by_similarity"))
    return made.where("by_rule OR by_similarity")
