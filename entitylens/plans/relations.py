"""Queries of joins, aggregates, de-duplication, ranking, coverage and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coverage, gates, graph, linking, mentions, refresh, relational, resolution, serve
from ..operators import extract as X
from ..operators.folders import shared_folder
from ..sources.rules import NameRules, rule_pairs
from ..streaming import refresh as stream
from . import scalars
from .scalars import COMPANY_KEY, query
from .tables import HOSTS, NAMES, SITE, companies, editions, quotes, table
from .tables import mentions as part_mentions

COVERAGE = """q AS (SELECT l_partkey AS c, count(*) AS quote_count FROM lineitem GROUP BY 1), s AS (SELECT l_partkey AS c, count(*) AS story_mentions_count FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
e AS (SELECT l_partkey AS c, count(DISTINCT l_orderkey) AS edition_count FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey AS slug, p_name AS name, coalesce(quote_count, 0) AS quote_count, coalesce(story_mentions_count, 0) AS story_mentions_count, coalesce(edition_count, 0) AS edition_count FROM part LEFT JOIN q ON q.c = p_partkey LEFT JOIN s ON s.c = p_partkey LEFT JOIN e ON e.c = p_partkey WHERE coalesce(edition_count, 0) > 0)"""


def records(spark, d):
    stories = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_partkey").alias("company_id"))
    return serve.company_records(companies(spark, d).select("id", "name"), quotes(spark, d), part_mentions(spark, d), stories)


@query("q15_coverage_counts", f"WITH {COVERAGE} SELECT * FROM r")
def q15(spark, d):
    return records(spark, d)


@query(
    "q16_featured_topk",
    f"""WITH {COVERAGE}, f AS (SELECT *, row_number() OVER (ORDER BY list_position([7, 3], slug)) AS featured_rank FROM r WHERE slug IN (7, 3)),
    o AS (SELECT *, row_number() OVER (ORDER BY quote_count + story_mentions_count DESC, quote_count DESC, story_mentions_count DESC, lower(name), slug) + (SELECT count(*) FROM f) AS featured_rank FROM r WHERE slug NOT IN (7, 3))
    SELECT slug, name, quote_count, story_mentions_count, edition_count, featured_rank::INTEGER AS featured_rank FROM (SELECT * FROM f UNION ALL SELECT * FROM o) WHERE featured_rank <= 5""",
)
def q16(spark, d):
    return serve.featured(records(spark, d), [7, 3])


@query("q17_search_ranked", "SELECT p_partkey AS slug, p_name AS name, row_number() OVER (ORDER BY p_name <> 'red widget', NOT starts_with(p_name, 'red widget'), p_name, p_partkey)::INTEGER AS search_rank FROM part WHERE contains(p_name, 'red widget') AND p_partkey <> 1 QUALIFY search_rank <= 10")
def q17(spark, d):
    return serve.search(companies(spark, d).select(F.col("id").alias("slug"), "name"), "Red Widget", exclude=1)


@query("q18_company_timeline", "SELECT l_partkey AS company_id, l_orderkey || '-' || l_linenumber AS quote_id, o_orderdate::DATE AS edition_date, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_orderkey || '-' || l_linenumber)::INTEGER AS quote_no, quote_no <= 2 AS visible FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q18(spark, d):
    # Line numbers may repeat within an order: equal quote ids get numbers in any order, which leaves the same rows.
    return serve.timeline(quotes(spark, d), editions(spark, d)).select("company_id", "quote_id", "edition_date", "quote_no", "visible")


@query("q18b_timeline_spans", "WITH g AS (SELECT l_partkey AS company_id, min(o_orderdate) AS a, max(o_orderdate) AS b, count(DISTINCT o_orderkey) AS editions, count(*) AS quotes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT company_id, editions, quotes, CASE WHEN strftime(a, '%b''%y') = strftime(b, '%b''%y') THEN strftime(a, '%b''%y') ELSE strftime(a, '%b''%y') || ' – ' || strftime(b, '%b''%y') END AS span FROM g")
def q18b(spark, d):
    e = editions(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return serve.timeline_spans(quotes(spark, d), e).select("company_id", "editions", "quotes", "span")


@query("q19_story_ranking", "WITH m AS (SELECT source AS company_id, doc_id AS story_id, n_chars % 7 AS mention_count, lang AS story_date, text AS story_title FROM documents) SELECT company_id, story_id, row_number() OVER (PARTITION BY company_id ORDER BY mention_count DESC, story_date DESC, lower(story_title), story_id)::INTEGER AS story_rank, story_rank <= 3 AS visible FROM m")
def q19(spark, d):
    m = table(spark, d, "documents").select(F.col("source").alias("company_id"), F.col("doc_id").alias("story_id"), (F.col("n_chars") % 7).alias("mention_count"), F.col("lang").alias("story_date"), F.col("text").alias("story_title"))
    return mentions.ranked_stories(m).select("company_id", "story_id", "story_rank", "visible")


def _keep(order: str) -> str:
    return f"SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {order}) = 1"


@query("q20_keep_first", _keep("l_orderkey, l_linenumber, l_extendedprice"))
def q20(spark, d):
    return relational.keep_best(table(spark, d, "lineitem"), ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("q21_keep_last", _keep("l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC"))
def q21(spark, d):
    return relational.keep_best(table(spark, d, "lineitem"), ["l_partkey"], [F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("q22_keep_longest", "SELECT p_brand, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) = 1")
def q22(spark, d):
    return relational.longest_name(table(spark, d, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", "p_name", "p_partkey")


@query("q23_mention_upsert", "WITH r AS (SELECT l_partkey AS company_id, l_orderkey AS edition_id, l_linestatus = 'F' AS h, l_linenumber AS ord, CASE WHEN l_linenumber % 3 > 0 THEN 'S' || l_linenumber END AS sector FROM lineitem WHERE l_returnflag = 'R') SELECT company_id, edition_id, CASE WHEN bool_or(h) THEN 'heading' ELSE 'list' END AS mention_type, coalesce(arg_max(sector, ord) FILTER (h AND sector IS NOT NULL), arg_min(sector, ord) FILTER (sector IS NOT NULL)) AS sector, count(*) AS n FROM r GROUP BY 1, 2")
def q23(spark, d):
    m = part_mentions(spark, d).withColumn("sector", F.when(F.col("ord") % 3 > 0, F.concat(F.lit("S"), F.col("ord").cast("string"))))
    return relational.upserted_mentions(m)


@query("q24_alias_remap", "WITH v AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name) AS canonical_id FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(v.canonical_id, l_partkey) AS company_id, count(*) AS n FROM lineitem LEFT JOIN v ON v.id = l_partkey GROUP BY 1")
def q24(spark, d):
    v = companies(spark, d).where("id % 4 <> 0").select("id", F.min("id").over(Window.partitionBy("name")).alias("canonical_id"))
    return relational.remap(quotes(spark, d), v).groupBy("company_id").agg(F.count("*").alias("n"))


@query("q25_quarantine_anti", "WITH g AS (SELECT p_partkey AS id FROM part WHERE contains(p_name, 'red')) SELECT 'kept' AS side, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM g) UNION ALL SELECT 'dropped', count(*) FROM lineitem WHERE l_partkey IN (SELECT id FROM g)")
def q25(spark, d):
    kept, gone = relational.without(quotes(spark, d), companies(spark, d).where(F.col("name").contains("red")))
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(kept, "kept").union(n(gone, "dropped"))


@query("q26_alias_uniqueness", "WITH a AS (SELECT DISTINCT p_brand AS company_id, p_name AS alias FROM part WHERE length(p_name) >= 2 AND p_name <> 'red widget'), n AS (SELECT *, count(*) OVER (PARTITION BY alias) AS n FROM a) SELECT company_id, alias FROM n WHERE CASE WHEN alias = 'small ring' THEN company_id = 'Brand#2' ELSE n = 1 END")
def q26(spark, d):
    a = table(spark, d, "part").select(F.col("p_brand").alias("company_id"), F.col("p_name").alias("alias")).distinct().where("length(alias) >= 2 AND alias <> 'red widget'")
    return mentions.unique_aliases(a, spark.createDataFrame([("Brand#2", "small ring")], "company_id string, alias string"))


def _alias_words(spark):
    return spark.createDataFrame([(1, "the"), (1, "on"), (2, "la"), (3, "die"), (4, "que")], "company_id int, alias string")


@query("q27_story_mentions", r"WITH a(company_id, alias) AS (VALUES (1, 'the'), (1, 'on'), (2, 'la'), (3, 'die'), (4, 'que')), t AS (SELECT doc_id AS story_id, string_split(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), c AS (SELECT story_id, company_id, len(list_filter(w, lambda x: x = alias)) AS n FROM t CROSS JOIN a) SELECT story_id, company_id, sum(n)::INTEGER AS mention_count FROM c GROUP BY 1, 2 HAVING sum(n) > 0")
def q27(spark, d):
    return mentions.plain_mentions(table(spark, d, "documents").select(F.col("doc_id").alias("story_id"), "text"), _alias_words(spark))


#: Of aliases that end in one word, the longer ones take their places first: what is left adds up to that word's places.
@query("q28_story_mentions_greedy", r"WITH a(company_id, alias) AS (VALUES (1, 'the'), (2, 'la'), (3, 'die')), t AS (SELECT doc_id AS story_id, string_split(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), c AS (SELECT story_id, company_id, len(list_filter(w, lambda x: x = alias))::INTEGER AS mention_count FROM t CROSS JOIN a) SELECT * FROM c WHERE mention_count > 0")
def q28(spark, d):
    a = spark.createDataFrame([(1, "the"), (1, "and the"), (1, "of the"), (2, "de la"), (2, "la"), (3, "die")], "company_id int, alias string")
    return mentions.story_mentions(table(spark, d, "documents").select(F.col("doc_id").alias("story_id"), "text"), a)


@query("q29_auto_acronym", "WITH t AS (SELECT p_partkey AS symbol, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+'), lambda x: x NOT IN ('the', 'a', 'an', 'of', 'and', '&', 'india')) AS w FROM part), a AS (SELECT symbol, upper(array_to_string(list_transform(w, lambda x: x[1]), '')) AS acronym FROM t WHERE len(w) >= 2) SELECT acronym, min(symbol) AS symbol FROM a GROUP BY 1 HAVING count(*) = 1")
def q29(spark, d):
    u = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    return coverage.auto_acronyms(u)


UNIVERSE = "SELECT min(p_partkey) AS ord, 'S' || min(p_partkey) AS symbol, p_name || ' Works Limited' AS name FROM part GROUP BY p_name"
#: Names to look up: symbols, aliases, acronyms, equal and partial names, and some that hit nothing.
LOOKUPS = "SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 's' || p_partkey WHEN 1 THEN p_name || ' works' WHEN 2 THEN 'brand ' || split_part(p_name, ' ', 1) WHEN 3 THEN upper(substr(p_name, 1, 1)) || 'W' ELSE split_part(p_name, ' ', 2) || ' work' END AS name FROM part"


def _universe(spark, d):
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    return p.select("ord", F.concat(F.lit("S"), F.col("ord").cast("string")).alias("symbol"), F.concat("p_name", F.lit(" Works Limited")).alias("name"))


def _lookups(spark, d):
    table(spark, d, "part").createOrReplaceTempView("_part")
    return spark.sql(LOOKUPS.replace("FROM part", "FROM _part"))


TRACKER_KEY = "regexp_replace(array_to_string(regexp_extract_all(lower({0}), '[a-z0-9&]+'), ' '), '(?:(?:^| )(?:limited|ltd|inc|corp|corporation|company|co|private|pvt|plc|sa|nv|ag))+$', '')"
PARTIAL = """pt AS (SELECT name, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9&]+'), lambda t: t NOT IN ('the','a','an','of','and','&','limited','ltd','inc','corp','corporation','company','co','private','pvt','plc','sa','nv','ag'))) AS t FROM n),
pu AS (SELECT symbol, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9&]+'), lambda t: t NOT IN ('the','a','an','of','and','&','limited','ltd','inc','corp','corporation','company','co','private','pvt','plc','sa','nv','ag'))) AS u FROM u),
pp AS (SELECT pt.name, pu.symbol, len(u) - len(t) AS extra FROM pt, pu WHERE len(t) >= 2 AND len(list_filter(t, lambda x: len(list_filter(u, lambda y: x = y OR (length(x) >= 3 AND starts_with(y, x)) OR (length(y) >= 3 AND starts_with(x, y)))) > 0)) = len(t)),
pm AS (SELECT name, min(symbol) AS symbol FROM (SELECT *, min(extra) OVER (PARTITION BY name) AS least FROM pp) WHERE extra = least GROUP BY name HAVING count(*) = 1)"""


@query(
    "q30_cascade_lookup",
    f"""WITH u AS ({UNIVERSE}), n AS ({LOOKUPS}), k AS (SELECT {TRACKER_KEY.format('name')} AS key, arg_min(symbol, ord) AS symbol FROM u GROUP BY 1), aw AS (SELECT symbol, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: x NOT IN ('the', 'a', 'an', 'of', 'and', '&', 'india')) AS w FROM u),
    au AS (SELECT upper(array_to_string(list_transform(w, lambda x: x[1]), '')) AS acronym, min(symbol) AS symbol FROM aw WHERE len(w) >= 2 GROUP BY 1 HAVING count(*) = 1), {PARTIAL},
    h AS (SELECT n.name, u.symbol, 1 AS layer FROM n JOIN u ON upper(n.name) = u.symbol UNION ALL SELECT n.name, u.symbol, 2 FROM n JOIN u ON lower(n.name) = 'brand red' AND u.symbol = 'S1' UNION ALL SELECT n.name, k.symbol, 3 FROM n JOIN k ON upper(n.name) = 'RW' AND k.key = {TRACKER_KEY.format("'red widget works'")}
      UNION ALL SELECT n.name, k.symbol, 4 FROM n JOIN k ON {TRACKER_KEY.format('n.name')} = k.key UNION ALL SELECT n.name, au.symbol, 5 FROM n JOIN au ON upper(n.name) = au.acronym UNION ALL SELECT name, symbol, 6 FROM pm)
    SELECT name, arg_min(symbol, layer) AS symbol, min(layer)::INTEGER AS layer FROM h GROUP BY name""",
)
def q30(spark, d):
    aliases = spark.createDataFrame([("brand red", "S1"), ("brand lost", "S-9")], "alias string, symbol string")
    acronyms = spark.createDataFrame([("RW", "Red Widget Works")], "acronym string, full_name string")
    return coverage.resolve_symbols(_lookups(spark, d), _universe(spark, d), aliases, acronyms)


@query("q31_token_partial", f"WITH u AS ({UNIVERSE}), n AS ({LOOKUPS}), {PARTIAL} SELECT name, symbol FROM pm")
def q31(spark, d):
    return coverage.partial_matches(_lookups(spark, d), _universe(spark, d))


QUARTERS = [(1, "Q1", "1995-01-01", "1996-12-31", "1997-06-30"), (2, "Q2", "1997-01-01", "1998-12-31", "1999-06-30"), (3, "Q3", "1999-01-01", "2001-12-31", "2002-06-30")]
QUARTERS_SQL = "qs(quarter_ord, name, begin_, end_, deadline) AS (VALUES " + ", ".join(f"({o}, '{n}', '{a}', '{b}', '{c}')" for o, n, a, b, c in QUARTERS) + ")"


def _quarters(spark):
    return spark.createDataFrame(QUARTERS, "quarter_ord int, name string, begin string, end string, deadline string")


@query("q32_active_windows", f"WITH {QUARTERS_SQL}, a AS (SELECT * FROM qs WHERE '1999-03-01' BETWEEN begin_ AND end_ OR (end_ < '1999-03-01' AND '1999-03-01' <= deadline)) SELECT a.name AS quarter, count(*) AS n FROM a JOIN orders ON strftime(o_orderdate, '%Y-%m-%d') BETWEEN begin_ AND end_ GROUP BY 1")
def q32(spark, d):
    a = coverage.active_quarters(_quarters(spark), "1999-03-01")
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.join(F.broadcast(a), F.col("day").between(F.col("begin"), F.col("end"))).groupBy(F.col("name").alias("quarter")).agg(F.count("*").alias("n"))


@query("q33_min_date_by_category", "SELECT user_id AS code, min(ts::DATE) FILTER (event_type IN ('view', 'signup')) AS presentation_date, min(ts::DATE) FILTER (event_type = 'purchase') AS transcript_date FROM events GROUP BY 1 HAVING min(ts) FILTER (event_type IN ('view', 'signup', 'purchase')) IS NOT NULL")
def q33(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("code"), F.col("event_type").alias("category"), F.col("ts").cast("date").alias("day"))
    return coverage.first_filings(f, "view|SIGNUP", "purchase")


ELIGIBLE_SQL = "el AS (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' ELSE 'Q3' END AS quarter, (o_custkey % 3 + 1)::INTEGER AS quarter_ord, l_partkey AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), es AS (SELECT l_orderkey AS edition, min(l_linenumber) AS ord, l_partkey AS symbol FROM lineitem GROUP BY 1, 3), v AS (SELECT edition, quarter, quarter_ord, count(*) AS votes, min(ord) AS first FROM es JOIN el USING (symbol) GROUP BY ALL), w AS (SELECT edition, quarter, votes FROM v QUALIFY row_number() OVER (PARTITION BY edition ORDER BY votes DESC, first, quarter_ord) = 1)"


def _votes(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    el = l.where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("Q"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("quarter"), (F.col("o_custkey") % 3 + 1).cast("int").alias("quarter_ord"), F.col("l_partkey").alias("symbol")).distinct()
    es = relational.dealt(l.select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", times=8).groupBy(F.col("l_orderkey").alias("edition"), F.col("l_partkey").alias("symbol")).agg(F.min("l_linenumber").alias("ord"))
    return es, el


@query("q34_edition_vote", f"WITH {ELIGIBLE_SQL} SELECT * FROM w")
def q34(spark, d):
    return coverage.edition_quarters(*_votes(spark, d))


@query("q35_first_coverage", f"WITH {ELIGIBLE_SQL} SELECT w.quarter, es.symbol, min(es.edition) AS edition FROM es JOIN w USING (edition) WHERE EXISTS (SELECT 1 FROM el WHERE el.quarter = w.quarter AND el.symbol = es.symbol) GROUP BY 1, 2")
def q35(spark, d):
    return coverage.first_coverage(*_votes(spark, d))


STATE_SQL = "st AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Q1' ELSE 'Q2' END AS quarter, c_custkey AS symbol, c_name AS name, coalesce(n.since, p.since) AS since, c.day FROM customer LEFT JOIN (SELECT user_id AS symbol, min(ts::DATE) AS since FROM events WHERE event_type = 'purchase' GROUP BY 1) n ON n.symbol = c_custkey LEFT JOIN (SELECT user_id AS symbol, min(ts::DATE) AS since FROM events WHERE event_type = 'error' AND ts < '2024-01-15' GROUP BY 1) p ON p.symbol = c_custkey LEFT JOIN (SELECT user_id AS symbol, min(ts::DATE) AS day FROM events WHERE event_type = 'signup' GROUP BY 1) c ON c.symbol = c_custkey)"


def _state(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("symbol"), "event_type", "ts", F.col("ts").cast("date").alias("day"))

    def least(cond, name):
        return e.where(cond).groupBy("symbol").agg(F.min("day").alias(name))

    u = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"))
    covered = least("event_type = 'signup'", "day").withColumn("edition", F.col("day").cast("string"))
    return coverage.quarter_state(u, least("event_type = 'purchase'", "since"), covered, least("event_type = 'error' AND ts < '2024-01-15'", "since"), "transcript")


@query("q36_quarter_state", f"WITH {STATE_SQL} SELECT symbol, name, since IS NOT NULL AS transcript_eligible, since AS transcript_since, day IS NOT NULL AS transcript_covered, day AS transcript_day FROM st")
def q36(spark, d):
    return _state(spark, d).drop("transcript_edition")


@query("q37_summary_counts", f"WITH {STATE_SQL}, s AS (SELECT quarter, count(*) AS total_companies, count(since) AS transcript_eligible, count(day) AS transcript_covered FROM st GROUP BY 1), p AS (SELECT *, quarter = 'Q1' AND transcript_eligible > transcript_covered AS pending FROM s) SELECT quarter, total_companies, transcript_eligible, transcript_covered, pending OR (NOT (SELECT bool_or(pending) FROM p) AND quarter = 'Q2') AS is_primary FROM p")
def q37(spark, d):
    st = _state(spark, d).withColumn("quarter", F.when(F.col("symbol") % 2 == 0, "Q1").otherwise("Q2"))
    s = coverage.state_summary(st, ["transcript"]).withColumn("presentation_eligible", F.lit(0)).withColumn("presentation_covered", F.lit(0))
    q = spark.createDataFrame([("Q1", "2024-01-10"), ("Q2", "2024-12-31")], "name string, end string")
    return coverage.primary_quarters(s, q, "2024-02-01").drop("presentation_eligible", "presentation_covered")


@query("q38_incremental_refresh", "WITH s AS (SELECT user_id AS url, max(event_id) AS lastmod FROM events WHERE ts >= '2024-01-10' GROUP BY 1), c AS (SELECT user_id AS url, max(event_id) AS lastmod FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT coalesce(s.url, c.url) AS url, CASE WHEN s.url IS NULL THEN 'drop' WHEN s.lastmod = c.lastmod THEN 'reuse' ELSE 'parse' END AS action FROM s FULL JOIN c ON s.url = c.url")
def q38(spark, d):
    e = table(spark, d, "events")
    def latest(df):
        return df.groupBy(F.col("user_id").alias("url")).agg(F.max("event_id").alias("lastmod"))

    return refresh.plan_refresh(latest(e.where("ts >= '2024-01-10'")), latest(e.where("event_type <> 'click'")))


@query("q39_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def q39(spark, d):
    c = table(spark, d, "conversations")
    return relational.carry_forward(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@query("q40_segments", "WITH a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS anchor FROM conversations) SELECT conv_id, anchor, count(*) AS n_turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS segment FROM a WHERE anchor IS NOT NULL GROUP BY 1, 2")
def q40(spark, d):
    c = relational.carry_forward(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "anchor").where("anchor IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("conv_id", "anchor").agg(F.count("*").alias("n_turns"), F.md5(joined).alias("segment"))


@query("q43_repeat_keys", f"SELECT {COMPANY_KEY.format(f'({scalars.NAME})')} AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def q43(spark, d):
    return gates.repeated_name_keys(table(spark, d, "part").select(F.expr(scalars.NAME).alias("name")))


@query("q44_leakage", "SELECT l_orderkey || '-' || l_linenumber AS id, count(DISTINCT l_partkey) AS companies FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def q44(spark, d):
    return gates.leaking_quotes(quotes(spark, d).withColumnRenamed("quote_id", "id"))


@query("q45_thresholds", "WITH m(metric, value) AS (SELECT 'companies', count(*) FROM part UNION ALL SELECT 'quotes', count(*) FROM lineitem UNION ALL SELECT 'editions', count(*) FROM orders), l(metric, most) AS (VALUES ('companies', 100), ('quotes', 10), ('editions', 1000000000)) SELECT metric, value, most::BIGINT AS most FROM m JOIN l USING (metric) WHERE value > most")
def q45(spark, d):
    n = lambda t, name: table(spark, d, t).agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    limits = spark.createDataFrame([("companies", 100), ("quotes", 10), ("editions", 10**9)], "metric string, value long")
    return gates.over_limits(n("part", "companies").union(n("lineitem", "quotes")).union(n("orders", "editions")), limits)


PAIRS = [("Red Widget Ltd", "red widget"), ("small ring", "red widget"), ("small ring", "no such name")]


@query("q46_pairs", "WITH v AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), p(l, r) AS (VALUES ('Red Widget Ltd', 'red widget'), ('small ring', 'red widget'), ('small ring', 'no such name')) SELECT p.l AS \"left\", p.r AS \"right\", a.id = b.id AS merged FROM p JOIN v a ON a.name = replace(lower(p.l), ' ltd', '') JOIN v b ON b.name = p.r")
def q46(spark, d):
    v = companies(spark, d).select("name", F.min("id").over(Window.partitionBy("name")).alias("canonical_id"))
    return gates.pair_states(spark.createDataFrame(PAIRS, "left string, right string"), v)


@query("q47_canonical_record", "WITH c AS (SELECT p_partkey AS id, p_partkey AS place, p_name AS cluster, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Ltd' ELSE '' END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'https://market.example/markets/stocks/NSE/' || replace(p_brand, '#', '') || '/' END AS url, p_size AS q FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (url IS NOT NULL) DESC, q DESC, name LIKE '% Ltd', length(name), place) AS a, row_number() OVER (PARTITION BY cluster ORDER BY name LIKE '% Ltd', length(string_split(name, ' ')), length(name), lower(name), place) AS b FROM c) SELECT cluster, max(id) FILTER (a = 1) AS id, max(name) FILTER (b = 1) AS name, arg_min(url, place) FILTER (url IS NOT NULL) AS url, count(*) AS n FROM r GROUP BY cluster")
def q47(spark, d):
    c = companies(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("n_quotes")), "id")
    c = c.withColumn("cluster", F.col("name")).withColumn("name", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" Ltd"))).otherwise(F.col("name")))
    from ..functions.urls import market_key

    key = market_key(F.col("url"), HOSTS)
    rows = c.withColumns({"n_mentions": F.lit(0), "market_key": key, "url_key": key, "place": F.col("ord")})
    return resolution.canonical_records(rows).select("cluster", "id", "name", "url", "n")


@query("q48_components", "WITH RECURSIVE e AS (SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM part a JOIN part b ON a.p_name = b.p_name GROUP BY 1 UNION SELECT a.p_partkey, min(b.p_partkey) FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size GROUP BY 1), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT p_partkey AS id, p_partkey AS c FROM part UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b) SELECT id, min(c) AS component FROM r GROUP BY id")
def q48(spark, d):
    p = table(spark, d, "part")
    by = lambda *k: p.select(F.col("p_partkey").alias("a"), F.min("p_partkey").over(Window.partitionBy(*k)).alias("b"))
    return graph.components(p.select(F.col("p_partkey").alias("id")), by("p_name").union(by("p_brand", "p_size")))


@query("q49_market_conflict", "WITH c AS (SELECT p_brand AS k, p_name AS component, sum(q) AS q, sum(m) AS m, count(*) AS n, min(p_partkey) AS first FROM (SELECT *, coalesce(qq, 0) AS q, coalesce(mm, 0) AS m FROM part LEFT JOIN (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS qq, count(*) FILTER (l_returnflag = 'R') AS mm FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) GROUP BY 1, 2), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY q * 10 + m * 3 DESC, n DESC, first) > 1) SELECT p_partkey AS id, k AS market_key, CASE WHEN q = 0 THEN 'quarantine' ELSE 'detach' END AS conflict FROM part JOIN l ON p_brand = k AND p_name = component")
def q49(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("n_quotes"), F.count_if(F.col("l_returnflag") == "R").alias("n_mentions"))
    rows = table(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").fillna(0, ["n_quotes", "n_mentions"])
    return resolution.market_conflicts(rows.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("market_key"), F.col("p_name").alias("component"), "n_quotes", "n_mentions"))


@query("q50_html_nodes")
def q50(spark, d):
    from ..functions import html

    return table(spark, d, "pages").select("page_id", F.inline(html.block_nodes(html.article(F.col("html"))))).select("page_id", "ord", "tag", "text", "in_list_item")


@query("q51_parse_post")
def q51(spark, d):
    posts = X.editions(table(spark, d, "pages").select("url", "html"), SITE)
    return X.parse_posts(posts, SITE, NAMES)


@query("q52_story_segments")
def q52(spark, d):
    return X.parse_story_posts(table(spark, d, "pages").select("url", "html", F.lit("").alias("lastmod")))


@query("q54_market_link")
def q54(spark, d):
    c = companies(spark, d).select("id", "name").dropDuplicates(["name"]).select(F.col("name").alias("id"), "name", F.lit(None).cast("string").alias("slug_url"))
    k = companies(spark, d).groupBy("name").agg(F.min("ord").alias("ord"))
    cands = k.select("ord", F.concat(F.initcap("name"), F.lit(" Limited")).alias("display_name"), F.lit("NSE").alias("exchange"), F.concat(F.lit("S"), F.col("ord").cast("string")).alias("symbol"), F.lit("").alias("slug"), F.concat(F.lit("https://market.example/markets/stocks/NSE/S"), F.col("ord").cast("string"), F.lit("/")).alias("listing_url"))
    return linking.best_listings(c, cands, HOSTS)


def _resolved(spark, d):
    c = companies(spark, d).groupBy("name").agg(F.min("ord").alias("ord"), F.min_by("url", "ord").alias("url")).select("ord", F.col("ord").alias("id"), "name", "url")
    first = companies(spark, d).select("id", F.min("id").over(Window.partitionBy("name")).alias("canonical_id"))
    q, m = relational.remap(quotes(spark, d), first), relational.remap(part_mentions(spark, d), first)
    pairs = rule_pairs(spark.createDataFrame([("red widget", "small ring")], "left string, right string"))
    none = rule_pairs(spark.createDataFrame([("big bolt", "red bolt")], "left string, right string"))
    return resolution.resolve(c, q, m, pairs, none, NameRules(exact_keys=["blue bolt"]), HOSTS)


@query("q55_resolve_full")
def q55(spark, d):
    return _resolved(spark, d).companies


@query("q56_refine_clusters")
def q56(spark, d):
    return _resolved(spark, d).variants


@query("q57_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def q57(spark, d):
    """Extension: events through a stream, each id once, counted by user and type."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    source = stream.first_events(source.withColumn("at", F.col("ts").cast("timestamp")), ["event_id"], "at").select("event_id", "user_id", "event_type")
    source.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("q58_company_pages", "WITH q AS (SELECT l_partkey AS c, l_orderkey AS e, l_orderkey || '-' || l_linenumber AS id, min(l_returnflag) AS sector, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY day DESC, e DESC, id) AS no FROM q), h AS (SELECT c, string_agg('<article class=\"quote\" data-no=\"' || CASE WHEN no < 10 THEN '0' ELSE '' END || no || '\"><p>' || id || '</p><footer>' || sector || '</footer></article>', '' ORDER BY no) AS cards FROM n GROUP BY c) SELECT p_partkey AS slug, md5('<!doctype html><title>' || p_name || '</title><h1>' || p_name || '</h1>' || cards) AS html FROM part JOIN h ON c = p_partkey")
def q58(spark, d):
    """Pages as company pages: nested timelines rendered to HTML."""
    c = companies(spark, d).select("id", "name")
    q = quotes(spark, d).groupBy("company_id", "edition_id", "quote_id").agg(F.min("sector").alias("speaker")).withColumn("text", F.col("quote_id"))
    return serve.company_pages(c, q, editions(spark, d)).withColumn("html", F.md5("html"))


_q30 = scalars.SQL["q30_cascade_lookup"]


@query("q59_unmatched_names", _q30[: _q30.rindex("SELECT name, arg_min")] + "SELECT name FROM n WHERE name NOT IN (SELECT name FROM h)")
def q59(spark, d):
    aliases = spark.createDataFrame([("brand red", "S1"), ("brand lost", "S-9")], "alias string, symbol string")
    acronyms = spark.createDataFrame([("RW", "Red Widget Works")], "acronym string, full_name string")
    return coverage.unmatched(_lookups(spark, d), coverage.resolve_symbols(_lookups(spark, d), _universe(spark, d), aliases, acronyms))


@query("q60_covered_editions", "SELECT l_partkey AS company_id, l_orderkey AS edition_id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey, l_orderkey FROM lineitem WHERE l_linestatus = 'F'")
def q60(spark, d):
    l = table(spark, d, "lineitem")
    of = lambda cond: l.where(cond).select(F.col("l_partkey").alias("company_id"), F.col("l_orderkey").alias("edition_id"))
    return relational.covered_pairs([of("l_returnflag = 'A'"), of("l_linestatus = 'F'")])


@query("q61_script_json", "SELECT p_partkey AS slug, replace('{\"slug\":' || p_partkey || ',\"name\":\"' || p_name || '</b>\"}', '</', '<\\/') AS json FROM part")
def q61(spark, d):
    one = F.struct(F.col("p_partkey").alias("slug"), F.concat("p_name", F.lit("</b>")).alias("name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("slug"), serve.script_json(one).alias("json"))


@query("q62_story_rows", "WITH s AS (SELECT doc_id, source, lang, n_chars, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {t: trim(x), i: i}), lambda z: z.t <> '')) AS z FROM documents) SELECT source || '/' || doc_id AS url, CASE WHEN z.i % 2 = 0 THEN 'Line ' || z.i ELSE lang END AS story_title, z.i::INTEGER AS position, md5(z.t) AS text FROM s")
def q62(spark, d):
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("").alias("story_id"), F.when((i + 1) % 2 == 0, F.concat(F.lit("Line "), (i + 1).cast("string"))).alias("title"), (i + 1).cast("int").alias("position"), F.lit("").alias("source"), x.alias("text")))
    posts = table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("url"), F.col("lang").alias("title"), F.lit("").alias("date"), line.alias("stories"))
    return X.story_rows(posts).select("url", "story_title", "position", F.md5("text").alias("text"))


@query("q63_eligibility", "WITH f AS (SELECT user_id AS code, min(ts::DATE) FILTER (event_type = 'view') AS p, min(ts::DATE) FILTER (event_type = 'purchase') AS t FROM events GROUP BY 1 HAVING p IS NOT NULL OR t IS NOT NULL), w AS (SELECT user_id AS symbol, min(ts::DATE) AS first_day FROM events WHERE event_type = 'error' AND ts::DATE BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1) SELECT c_custkey AS symbol, coalesce(first_day, t) AS transcript_since, p AS presentation_since FROM customer LEFT JOIN f ON f.code = c_custkey LEFT JOIN w ON w.symbol = c_custkey WHERE coalesce(first_day, t, p) IS NOT NULL")
def q63(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    filings = coverage.first_filings(e.select(F.col("user_id").alias("code"), F.col("event_type").alias("category"), "day"), "view", "purchase")
    pages = coverage.first_in_window(e.where("event_type = 'error'").withColumnRenamed("user_id", "symbol"), "symbol", "day", "2024-01-05", "2024-01-20")
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_custkey").alias("code"))
    return coverage.eligibility(u, filings, pages)


def all_queries():
    from . import checks, content  # noqa: F401  these register their queries

    return dict(scalars.QUERIES), dict(scalars.SQL)
