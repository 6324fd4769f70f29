"""What a review on larger tables found (FINDINGS_r03): work on few bytes is spread, pairs are not all made, memory is bounded."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from entitylens.functions import html, similarity, udfs
from entitylens.operators import coverage, extract, linking, mentions
from entitylens.plans import content
from entitylens.sources.rules import NameRules, SiteRules

SITE = SiteRules(base_url="https://news.example", listing_hosts=["market.example"], title_include="digest", title_exclude=[])
NAMES = NameRules.parse({})
PAGE = '<meta property="og:title" content="Digest {0}"><article><h3>Alpha Works {0}</h3><p>Context {0}.</p><blockquote><p>“Growth is steady {0}” – Ravi Kumar</p></blockquote><h3>Beta Mills {0}</h3></article>'


def posts(spark, n):
    rows = [(f"https://news.example/p/c{i}", PAGE.format(i)) for i in range(n)]
    return extract.editions(spark.createDataFrame(rows, "url string, html string").coalesce(1), SITE)


def test_posts_of_one_small_file_are_read_by_all_cores(spark):
    made = extract.parse_posts(posts(spark, 50), SITE, NAMES)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.groupBy("kind").count().collect() and {r.kind: r["count"] for r in made.groupBy("kind").count().collect()} == {"company": 100, "quote": 50, "mention": 100}


def test_a_page_may_span_batches_and_have_a_twin(spark):
    twice = posts(spark, 7).union(posts(spark, 2))
    whole = sorted(map(str, extract.parse_posts(twice, SITE, NAMES).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, extract.parse_posts(twice, SITE, NAMES).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = extract.parse_posts(twice, SITE, NAMES).where("kind = 'company'").groupBy("url").count().collect()
    assert len(found) == 7 and {r["count"] for r in found} == {2}


def test_merged_tables_parse_posts_once(spark):
    t = extract.merged_tables(extract.parse_posts(posts(spark, 3), SITE, NAMES))
    assert all("Arrow" not in x._jdf.queryExecution().toString() and "Pandas" not in x._jdf.queryExecution().toString() for x in t.values())
    assert [t[x].count() for x in ("companies", "quotes", "mentions")] == [6, 3, 6]


@pytest.mark.parametrize("least", [0.88, 0.95])
def test_near_names_share_a_part(least):
    r, near = random.Random(5), 0
    for _ in range(30000):
        a = "".join(r.choice("abcd") for _ in range(r.randint(1, 45)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = r.choice(["", "a", "x"])
        b = "".join(b)
        if b and SequenceMatcher(None, a, b).ratio() >= least:
            near += 1
            assert set(similarity.place_keys(a, least)) & set(similarity.part_keys(b, least)), (a, b)
    assert near > 5000


def test_pairs_of_names_with_equal_first_letters_grow_with_the_names(spark):
    made = lambda n: ["al" + "".join("bcdfghklmn"[int(x)] for x in f"{(i + 1) * 104729 * 7919 % 10**9:09}") for i in range(n)]
    n = 300
    hints = linking.name_hints(spark.createDataFrame([(x, x, None) for x in made(n)], "id string, name string, slug_url string"), ["market.example"])
    cands = spark.createDataFrame([(i, x.title() + ("s" if i % 2 else "") + " Limited", "NSE", f"S{i}", "", x) for i, x in enumerate(made(n))], "ord int, display_name string, exchange string, symbol string, slug string, listing_url string")
    pairs = linking.candidate_pairs(hints, cands).select("id", "listing_url").distinct().where("id = listing_url").count()
    assert pairs == n and linking.candidate_pairs(hints, cands).count() < 10 * n


def test_codes_of_seven_digits_are_found_as_the_sql_says(spark, tmp_path):
    part = spark.range(399_990, 400_020).select(F.col("id").alias("p_partkey"), F.concat(F.lit("red ring "), "id").alias("p_name"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    found = {tuple(r) for r in entry.queries()["q74_codes"](spark, str(tmp_path)).select("symbol", "code").collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        assert found == set(con.execute(f"SELECT symbol, code FROM ({entry.oracle_sql()['q74_codes']})").fetchall())


def test_votes_are_summed_by_many_tasks_after_they_are_dealt_out(spark):
    el = spark.range(30).selectExpr("concat('Q', id % 3) AS quarter", "CAST(id % 3 AS INT) AS quarter_ord", "id % 10 AS symbol").coalesce(1)
    es = spark.range(200).selectExpr("id % 40 AS edition", "CAST(id AS INT) AS ord", "id % 10 AS symbol").coalesce(1)
    made = coverage.edition_quarters(es, el)
    assert made.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert {(r.edition, r.quarter, r.votes) for r in made.collect()} == {(e, "Q0", 5) for e in range(40)}


def test_quotes_are_split_and_sectors_asked_only_where_they_are_read(spark):
    long = "Plain words of a paragraph that nobody asks about. " * 3
    page = PAGE.format(1).replace("<p>Context", f"<p>{long}</p><ul><li><p>Gamma Foods</p></li></ul><p>Context")
    df = extract.editions(spark.createDataFrame([("u", page)], "url string, html string"), SITE)
    found = extract.prepared_nodes(df, SITE, NAMES).orderBy("ord").collect()
    assert [(n.tag, n.name, n.sector_like is None) for n in found if not n.in_blockquote] == [("h3", "Alpha Works 1", False), ("p", None, True), ("p", "Gamma Foods", True), ("p", None, True), ("h3", "Beta Mills 1", False)]


def test_udf_slices_join_to_whole_batches(spark):
    df = spark.range(1, 200).select("id", F.expr("CASE WHEN id % 50 <> 0 THEN repeat('<p>a</p>', CAST(id AS INT)) END").alias("html"))
    found = df.select("id", F.size(html.block_nodes("html")).alias("n")).collect()
    assert {(r.id, r.n) for r in found} == {(i, i if i % 50 else 0) for i in range(1, 200)}
    assert udfs.SLICE < 200


def test_only_places_of_first_words_become_rows(spark, monkeypatch):
    stories = spark.createDataFrame([(1, "The red bank of the bank & the river"), (2, None), (3, "")], "story_id int, text string")
    a = spark.createDataFrame([("a", "the bank"), ("a", "bank"), ("b", "and the river")], "company_id string, alias string")
    few = mentions.phrase_hits(stories, a)
    assert "array_contains" in few._jdf.queryExecution().optimizedPlan().toString()
    whole = {tuple(r) for r in few.collect()}
    monkeypatch.setattr(mentions, "MOST_FIRST_WORDS", 0)
    assert whole == {tuple(r) for r in mentions.phrase_hits(stories, a).collect()} and len(whole) == 4


def test_feeds_read_a_page_once(spark):
    pages = spark.createDataFrame([("u", "<title>T</title><article><h2>A | B</h2></article>"), ("v", "<article></article>")], "url string, html string")
    made = extract.feed_editions(pages, html.barred_headings, keep_empty=False)
    assert [(r.url, r.companies) for r in made.collect()] == [("u", ["A | B"])]
    assert made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ArrowEvalPython [") == 1


def test_keys_of_one_small_file_are_dealt_out_before_pages_are_made(spark):
    assert content.customers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
