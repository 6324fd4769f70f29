"""Queries of links, aliases, state, refresh, order, pages and gates over companies that are made from customers; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, gates, linking, mentions, refresh, serve
from ..sources.rules import NameRules, alias_rules
from .content import customers, filled
from .relations import COVERAGE, records
from .scalars import query
from .tables import HOSTS, editions, quotes, table

STOCKS = "https://market.example/markets/stocks/"
#: A name of letters only, different for each customer.
WORD = "translate(CAST(c_custkey * 7919 + 100000 AS VARCHAR(20)), '0123456789', 'bdfgklmnrs')"


def words(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr(WORD).alias("id"))


LINKS_SQL = f"""w AS (SELECT c_custkey AS k, {WORD} AS id FROM customer), l AS (SELECT k, id, upper(id[1]) || substr(id, 2) AS name,
    CASE WHEN k % 5 = 0 THEN '{STOCKS}NSE/K' || k || '/' WHEN k % 5 = 1 AND k % 10 = 1 THEN '{STOCKS}NSE/T' || k || '/' WHEN k % 5 = 2 THEN '{STOCKS}NSE/O' || k || '/' WHEN k % 5 = 3 THEN '{STOCKS}NSE/M' || k || '/' END AS url,
    CASE WHEN k % 5 = 0 THEN 'existing' WHEN k % 5 = 1 AND k % 10 = 1 THEN 'converted' WHEN k % 5 = 2 THEN 'override' WHEN k % 5 = 3 THEN 'matched' END AS link_source FROM w)"""


def _linked(spark, d):
    w, k = words(spark, d), F.col("k")
    url = F.when(k % 5 == 0, filled(STOCKS + "nse/k{k}?x=1", k=k)).when(k % 5 == 1, filled(STOCKS + "BSE/B{k}/", k=k)).when(k % 5 == 2, filled(STOCKS + "NSE/OLD{k}", k=k))
    companies = w.select("id", F.initcap("id").alias("name"), url.alias("url"))
    m = filled("M{k}", k=k)
    candidates = w.where("k % 5 = 3").select(F.col("k").alias("ord"), F.concat(F.initcap("id"), F.lit(" Limited")).alias("display_name"), F.lit("NSE").alias("exchange"), m.alias("symbol"), F.lit("").alias("slug"), F.concat(F.lit(STOCKS + "NSE/"), m, F.lit("/")).alias("listing_url"))
    ghost = w.where("k % 50 = 2").select(F.concat(F.lit("ghost"), "id").alias("company_key"), F.lit(STOCKS + "NSE/G/").alias("url"))
    overrides = w.where("k % 5 = 2").select(F.col("id").alias("company_key"), filled(STOCKS + "NSE/o{k}", k=k).alias("url")).union(ghost)
    index = w.where("k % 10 = 1").select(filled("B{k}", k=k).alias("symbol"), filled(STOCKS + "NSE/T{k}/", k=k).alias("listing_url"))
    return w, overrides, linking.linked_companies(companies, candidates, overrides, index, HOSTS)


@query("q84_linked_companies", f"WITH {LINKS_SQL} SELECT id, name, url, link_source FROM l")
def q84(spark, d):
    return _linked(spark, d)[2]


@query("q85_link_audit", f"WITH {LINKS_SQL} SELECT 'override_without_company' AS finding, 'ghost' || id AS id, '{STOCKS}NSE/G/' AS detail FROM w WHERE k % 50 = 2 UNION ALL SELECT 'mandatory_missing', 'no' || id, 'x' FROM w WHERE k % 20 = 3 UNION ALL SELECT 'mandatory_mismatch', id, url FROM l WHERE k % 20 IN (4, 13)")
def q85(spark, d):
    w, overrides, linked = _linked(spark, d)
    k = F.col("k")
    expected = F.when(k % 20 == 8, filled(STOCKS + "NSE/M{k}/", k=k)).otherwise(F.lit("x"))
    mandatory = w.where("k % 20 IN (3, 4, 8, 13)").select(F.when(k % 20 == 3, F.concat(F.lit("no"), "id")).otherwise(F.col("id")).alias("company_key"), expected.alias("expected_url"))
    return linking.link_audit(linked, overrides, mandatory)


@query("q86_link_counts", f"WITH {LINKS_SQL} SELECT count(*) AS companies, count(url) AS linked, count(*) FILTER (link_source = 'existing') AS existing, count(*) FILTER (link_source = 'converted') AS converted, count(*) FILTER (link_source = 'override') AS override, count(*) FILTER (link_source = 'matched') AS matched FROM l")
def q86(spark, d):
    return linking.link_counts(_linked(spark, d)[2])


@query("q87_nested_timeline", "WITH r AS (SELECT l_partkey AS company_id, l_orderkey AS edition_id, o_orderdate::DATE AS day, string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY l_orderkey || '-' || l_linenumber) AS quotes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) SELECT company_id, (row_number() OVER (PARTITION BY company_id ORDER BY day DESC, edition_id DESC) - 1)::INTEGER AS place, edition_id, day, quotes FROM r")
def q87(spark, d):
    nested = serve.nested_timeline(quotes(spark, d), editions(spark, d))
    return nested.select("company_id", F.posexplode("editions").alias("place", "e")).select("company_id", "place", "e.edition_id", F.col("e.edition_date").alias("day"), F.array_join(F.transform("e.quotes", lambda x: x["quote_id"]), ",").alias("quotes"))


STORIES = "SELECT doc_id % 97 AS company_id, doc_id AS story_id, 'Story <' || doc_id || '>' AS story_title, '/s/' || doc_id || '?a&b' AS story_url, '2024-01-1' || (doc_id % 9) AS story_date, n_chars % 4 AS mention_count FROM documents"


def _stories(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("_documents")
    return mentions.ranked_stories(spark.sql(STORIES.replace("FROM documents", "FROM _documents")))


@query(
    "q88_story_sections",
    f"""WITH m AS ({STORIES}), r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY mention_count DESC, story_date DESC, lower(story_title), story_id) AS n,
    '<li><a href="/s/' || story_id || '?a&amp;b">Story &lt;' || story_id || '&gt;</a><p>1' || (story_id % 9) || ' Jan 2024 · ' || mention_count || CASE WHEN mention_count = 1 THEN ' mention' ELSE ' mentions' END || '</p></li>' AS item FROM m)
    SELECT company_id, count(*) AS stories, md5('<section><p>' || count(*) || ' story mentions</p><ol>' || string_agg(item, '' ORDER BY n) FILTER (n <= 3) || '</ol>' || CASE WHEN count(*) > 3 THEN '<details><summary>Show ' || (count(*) - 3) || ' more stories</summary><ol>' || string_agg(item, '' ORDER BY n) FILTER (n > 3) || '</ol></details>' ELSE '' END || '</section>') AS html FROM r GROUP BY company_id""",
)
def q88(spark, d):
    return serve.story_sections(_stories(spark, d)).withColumn("html", F.md5("html"))


@query("q89_orders", "SELECT 'companies' AS kind, p_partkey::VARCHAR AS key, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part UNION ALL SELECT 'posts', 'u' || o_orderkey, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, 'u' || o_orderkey DESC) FROM orders UNION ALL SELECT 'universe', 'S' || c_custkey, row_number() OVER (ORDER BY 'S' || c_custkey) FROM customer")
def q89(spark, d):
    c = serve.companies_by_name(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("slug")))
    p = serve.newest_posts_first(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url")))
    u = serve.universe_by_symbol(customers(spark, d).select(filled("S{k}", k=F.col("k")).alias("symbol")))
    of = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "place")
    return of(c, "companies", "slug").union(of(p, "posts", "url")).union(of(u, "universe", "symbol"))


@query("q90_matched_stories", "SELECT count(DISTINCT doc_id) AS stories, count(DISTINCT doc_id % 97) AS companies FROM documents WHERE n_chars % 4 > 0")
def q90(spark, d):
    m = _stories(spark, d).where("mention_count > 0")
    return serve.matched_stories(m.union(m))


@query("q91_read_state", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Q1' ELSE 'Q4' END AS quarter, 'S' || c_custkey AS symbol, CASE WHEN c_custkey % 2 = 0 THEN '2026-01-10' END AS transcript_since, CASE WHEN c_custkey % 5 = 0 THEN '2026-02-11' END AS presentation_since FROM customer WHERE c_custkey % 3 <> 2")
def q91(spark, d):
    k = F.col("k")
    since = lambda c, day: F.when(c, F.struct(F.lit(day).alias("eligible_since")))
    company = F.array(F.struct(filled("S{k}", k=k).alias("symbol"), since(k % 2 == 0, "2026-01-10").alias("transcript"), since(k % 5 == 0, "2026-02-11").alias("presentation")))
    old = F.to_json(F.struct(F.lit("Q1").alias("active_quarter"), company.alias("companies")))
    new = F.to_json(F.struct(F.array(F.struct(F.lit("Q4").alias("name"), company.alias("companies"))).alias("quarters")))
    return refresh.read_state(customers(spark, d).select(F.when(k % 3 == 0, old).when(k % 3 == 1, new).otherwise(F.lit("{}")).alias("json")))


@query("q92_carried_eligibility", "SELECT 'Q' || (c_custkey % 3) AS quarter, 'S' || c_custkey AS symbol, CASE WHEN c_custkey % 3 = 1 THEN 'old' ELSE 'new' END AS transcript_since FROM customer WHERE CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 2 = 0 ELSE true END")
def q92(spark, d):
    k = F.col("k")
    rows = lambda some, value: customers(spark, d).where(some).select(filled("Q{q}", q=k % 3).alias("quarter"), filled("S{k}", k=k).alias("symbol"), F.lit(value).alias("transcript_since"))
    ended = spark.createDataFrame([("Q1",), ("Q7",)], "quarter string")
    return refresh.carried_eligibility(rows("k % 2 = 0", "old"), ended, rows("k >= 0", "new"))


@query("q93_refreshed", "SELECT 'u' || c_custkey AS url, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 AND c_custkey % 5 = 0 THEN '1' ELSE '2' END AS lastmod, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 AND c_custkey % 5 = 0 THEN 'old' ELSE 'new' END AS body FROM customer WHERE c_custkey % 4 < 2 OR c_custkey % 4 = 2 AND c_custkey % 5 <> 0")
def q93(spark, d):
    """k % 4: 0 unchanged, 1 changed, 2 new, 3 gone from the source; what divides by 5 cannot be parsed."""
    k, c = F.col("k"), customers(spark, d).withColumn("url", filled("u{k}", k=F.col("k")))
    source = c.where("k % 4 < 3").select("url", F.when(k % 4 == 0, "1").otherwise("2").alias("lastmod"))
    cached = c.where("k % 4 <> 2").select("url", F.lit("1").alias("lastmod"), F.lit("old").alias("body"))
    plan = refresh.plan_refresh(source, cached)
    failed = k % 5 == 0
    parsed = c.join(plan.where("action = 'parse'"), "url").select("url", F.lit("2").alias("lastmod"), F.when(~failed, "new").alias("body"), F.when(failed, "failed").alias("error"))
    return refresh.refreshed(plan, cached, parsed)


@query("q94_page_cache", "SELECT 'new' AS kind, 'u' || c_custkey AS url, NULL::BIGINT AS n FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'hits', NULL, count(*) FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'misses', NULL, count(*) FROM customer WHERE c_custkey % 3 = 0")
def q94(spark, d):
    c = customers(spark, d).select("k", filled("u{k}", k=F.col("k")).alias("url"))
    cached = c.where("k % 3 > 0").union(c.where("k % 3 = 1")).select("url")
    new = refresh.new_rows(c.select("url"), cached).select(F.lit("new").alias("kind"), "url", F.lit(None).cast("long").alias("n"))
    counts = refresh.cache_hits(c, cached).select(F.inline(F.array(F.struct(F.lit("hits").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("hits").alias("n")), F.struct(F.lit("misses").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("misses").alias("n")))))
    return new.union(counts)


@query("q95_failures_apart", "SELECT p_partkey, p_partkey % 7 > 0 AS good, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS result, CASE WHEN p_partkey % 7 = 0 THEN 'no number: x' || p_size END AS error FROM part")
def q95(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(""), F.col("p_size").cast("string")).alias("raw"))
    number = F.expr("try_cast(raw AS INT)")
    good, bad = refresh.with_failures_apart(p, number, F.when(number.isNull(), F.concat(F.lit("no number: "), "raw")))
    none = F.lit(None)
    return good.select("p_partkey", F.lit(True).alias("good"), F.col("_result").cast("long").alias("result"), none.cast("string").alias("error")).union(bad.select("p_partkey", F.lit(False).alias("good"), none.cast("long").alias("result"), F.col("_error").alias("error")))


@query("q96_stale_counts", "SELECT 'parts' AS metric, 1::BIGINT AS stored, count(*) AS computed FROM part UNION ALL SELECT 'lost', 5, NULL UNION ALL SELECT 'orders', NULL, count(*) FROM orders")
def q96(spark, d):
    n = lambda t, name: table(spark, d, t).agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    stored = n("customer", "customers").union(spark.createDataFrame([("parts", 1), ("lost", 5)], "metric string, value long"))
    return gates.stale_counts(stored, n("customer", "customers").union(n("part", "parts")).union(n("orders", "orders")))


@query("q97_shown_names", "WITH s AS (SELECT DISTINCT p_name AS name FROM part), p(l, r) AS (VALUES ('red widget', 'small ring'), ('red widget', 'nobody')) SELECT 'together' AS finding, l || ' / ' || r AS name FROM p JOIN s a ON a.name = l JOIN s b ON b.name = r UNION ALL SELECT 'excluded', name FROM s WHERE name IN ('red bolt', 'blue ring')")
def q97(spark, d):
    shown = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = spark.createDataFrame([("red widget", "small ring"), ("red widget", "nobody")], "left string, right string")
    excluded = spark.createDataFrame([("Red Bolt Ltd",), ("Blue Ring",), ("No One",)], "name string")
    return gates.coexisting(pairs, shown).select(F.lit("together").alias("finding"), F.concat_ws(" / ", "left", "right").alias("name")).union(gates.excluded_shown(excluded, shown).select(F.lit("excluded").alias("finding"), "name"))


@query("q98_suspicious_names", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 < 3 AND c_custkey % 2 = 0")
def q98(spark, d):
    k = F.col("k")
    name = F.when(k % 5 == 0, F.lit("Minister on the new budget")).when(k % 5 == 1, F.lit("Not A Company")).when(k % 5 == 2, filled("Comments on {k}", k=k)).otherwise(filled("Fine Works {k}", k=k))
    rows = customers(spark, d).select(F.col("k").alias("id"), name.alias("name"), F.when(k % 2 == 1, "u").alias("url"))
    return gates.suspicious_names(rows, NameRules.parse({"exact_names": ["Not A Company", "Fine Works 3"], "name_patterns": [r"^comments?\s+on\b", "^fine works 8$"], "allow_names": ["Fine Works 3", "Fine works 8"]})).select("id")


@query("q99_expectations", "WITH c AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT 'few' AS finding, '' || p_partkey AS name, coalesce(n, 0) AS editions FROM part LEFT JOIN c ON id = p_partkey WHERE coalesce(n, 0) < 25 UNION ALL SELECT 'missing', '' || o_orderkey, 0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = o_orderkey % 10)")
def q99(spark, d):
    shown = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), F.col("l_orderkey").alias("edition_id"))
    expected = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.lit(25).alias("least_editions"))
    required = table(spark, d, "orders").select((F.col("o_orderkey") % 10).cast("string").alias("name"), F.col("o_orderkey").alias("edition_id"))
    few = gates.unmet_expectations(expected, shown).select(F.lit("few").alias("finding"), "name", "editions")
    return few.union(gates.missing_editions(required, shown).select(F.lit("missing").alias("finding"), F.col("edition_id").cast("string").alias("name"), F.lit(0).cast("long").alias("editions")))


@query(
    "q100_company_aliases",
    """WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS id, c_nationkey AS n FROM customer), o AS (SELECT * FROM c WHERE k <> 5),
    f AS (SELECT id, 'acme ' || k || ' and co ltd' AS alias FROM o UNION SELECT id, 'acme ' || k FROM o UNION SELECT id, 'nation ' || n FROM o UNION SELECT id, 'sym' || k FROM o WHERE k % 4 = 0 UNION SELECT id, 'third and co' FROM o WHERE k = 3 UNION SELECT 'c5', 'only five' UNION SELECT id, 'nation 2' FROM o WHERE k = 9),
    a AS (SELECT * FROM f WHERE alias <> 'sym4' AND NOT (id = 'c8' AND alias = 'sym8')), u AS (SELECT *, count(*) OVER (PARTITION BY alias) AS owners FROM a)
    SELECT id AS company_id, alias, CASE WHEN alias = 'nation 2' THEN id = 'c9' ELSE owners = 1 END AS is_unique FROM u""",
)
def q100(spark, d):
    k, c = F.col("k"), customers(spark, d).withColumn("id", filled("c{k}", k=F.col("k")))
    companies = c.select("id", filled("Acme {k} & Co Ltd", k=k).alias("name"), F.when(k % 4 == 0, filled(STOCKS + "NSE/SYM{k}/", k=k)).alias("url"))
    members = c.select("id", filled("Nation-{n}", n=F.col("n")).alias("member_name")).union(c.select("id", filled("{k}", k=k).alias("member_name")))
    rules = alias_rules(spark, {"company_aliases": {"c3": ["Third & Co"], "c5": ["Only Five"], "lost": ["x y"]}, "alias_overrides": {"nation 2": "c9"}, "blocked_aliases": ["SYM4"], "strict_companies": ["c5"], "company_blocked_aliases": {"c8": ["sym8"]}})
    found = mentions.company_aliases(companies, members, rules, HOSTS).select("company_id", "alias")
    unique = mentions.unique_aliases(found, rules["alias_overrides"]).withColumn("is_unique", F.lit(True))
    return found.join(unique, ["company_id", "alias"], "left").select("company_id", "alias", F.coalesce("is_unique", F.lit(False)).alias("is_unique"))


@query(
    "q101_search_blank",
    f"""WITH {COVERAGE}, o AS (SELECT *, row_number() OVER (ORDER BY quote_count + story_mentions_count DESC, quote_count DESC, story_mentions_count DESC, lower(name), slug) + 1 AS search_rank FROM r WHERE slug <> 3)
    SELECT slug, name, search_rank::INTEGER AS search_rank FROM (SELECT slug, name, 1 AS search_rank FROM r WHERE slug = 3 UNION ALL SELECT slug, name, search_rank FROM o) WHERE search_rank <= 5""",
)
def q101(spark, d):
    return serve.search(records(spark, d), "  ", curated=[3]).select("slug", "name", "search_rank")


@query("q102_window_coverage", "SELECT l_partkey AS symbol, min(l_orderkey) AS edition FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate::DATE BETWEEN '1996-01-01' AND '1996-06-30' GROUP BY 1")
def q102(spark, d):
    es = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edition"), F.col("l_partkey").alias("symbol"))
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("edition"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return coverage.window_coverage(es, e, "1996-01-01", "1996-06-30")


@query("q103_index_page", f"WITH {COVERAGE}, f AS (SELECT name, slug, quote_count, CASE WHEN slug = 3 THEN 0 ELSE 1 END AS g, row_number() OVER (ORDER BY slug <> 3, quote_count + story_mentions_count DESC, quote_count DESC, story_mentions_count DESC, lower(name), slug) AS n FROM r) SELECT '<h1>' || (SELECT count(*) FROM r) || ' companies</h1><ol>' || string_agg('<li><a href=\"/company/' || slug || '/\">' || name || '</a> ' || quote_count || ' quotes</li>', '' ORDER BY n) || '</ol>' AS html FROM f WHERE n <= 5")
def q103(spark, d):
    return serve.index_page(records(spark, d), [3])
