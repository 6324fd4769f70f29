"""Relational, graph, extraction and coverage operators on hand-written cases."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from entitylens.functions import html
from entitylens.functions.similarity import SAME_NAME, decided_compatible, ratio
from entitylens.functions.text import company_key
from entitylens.operators import coverage, extract, gates, graph, linking, mentions, refresh, resolution, serve
from entitylens.sources import web
from entitylens.sources.rules import NameRules, SiteRules, alias_rules, rule_pairs
from entitylens.streaming import refresh as stream

SITE = SiteRules(base_url="https://news.example", listing_hosts=["market.example"], title_include="the digest", title_exclude=["charts only"])
NAMES = NameRules.parse({"exact_names": ["Not A Company"], "name_patterns": [r"\bcomments?\s+on\b"], "allow_names": []})
HEAD = '<html><head><meta property="og:title" content="The Digest: {0}"></head><article>{1}</article></html>'


def rows(df):
    return [tuple(r) for r in df.collect()]


def parsed(spark, **pages):
    df = spark.createDataFrame([(f"https://news.example/p/{k}", HEAD.format(k, v)) for k, v in pages.items()], "url string, html string")
    tables = extract.merged_tables(extract.parse_posts(extract.editions(df, SITE), SITE, NAMES))
    return {k: sorted(v.collect()) for k, v in tables.items()}


def test_post_merges_blockquotes_and_carries_sector(spark):
    t = parsed(spark, f1="""<h1>Banking and Financial Services</h1>
<h3><a href="https://market.example/markets/stocks/NSE/hdfcbank/?x=1">Alpha Bank (Q3)</a></h3><p>Context line.</p>
<blockquote><p>“Growth is steady” – Ravi Kumar, CFO</p></blockquote>
<blockquote><p>Second</p></blockquote>""")
    assert [tuple(c) for c in t["companies"]] == [("alpha-bank", "Alpha Bank", "https://market.example/markets/stocks/NSE/HDFCBANK/")]
    (q,) = t["quotes"]
    assert (q.id, q.text, q.speaker, q.context, q.sector) == ("p-f1-alpha-bank-0", "Growth is steady", "Ravi Kumar, CFO Second", "Context line.", "Banking and Financial Services")
    assert [m.mention_type for m in t["mentions"]] == ["heading"]


def test_post_lists_and_upgrades(spark):
    t = parsed(spark, f2="""<h2>Cement and Construction Materials</h2><ul><li><p>Beta Cement</p></li><li><p>Gamma Ltd</p></li></ul>
<h2>Beta Cement | Mid Cap | Metals</h2><p>Plain.</p>""")
    assert [c.id for c in t["companies"]] == ["beta-cement", "gamma-ltd"] and not t["quotes"]
    found = {m.company_id: (m.id, m.mention_type, m.sector) for m in t["mentions"]}
    assert found == {"beta-cement": ("p-f2-beta-cement-list-0", "heading", "Metals"), "gamma-ltd": ("p-f2-gamma-ltd-list-1", "list", "Cement and Construction Materials")}


def test_post_late_speaker_and_other_titles(spark):
    t = parsed(spark, f3="<h3>Delta Foods</h3><p>“We will double capacity by next year”</p><p>- Management</p><p>Note.</p>")
    (q,) = t["quotes"]
    assert (q.text, q.speaker, q.context) == ("We will double capacity by next year", "Management", None)
    other = spark.createDataFrame([("https://news.example/p/x", "<title>Charts only: the digest</title>"), ("u", None)], "url string, html string")
    assert extract.editions(other, SITE).count() == 0


def test_stories(spark):
    long = "word " * 30
    page = f"""<html><meta property="og:title" content="Day"><article><p>In today’s edition</p><ul><li><p>First story</p></li><li><p>Second story</p></li></ul>
<h1>First story</h1><p>{long}</p><h1>Second story</h1><p>{long}</p><h2>Tidbits</h2><p>left out</p></article></html>"""
    df = spark.createDataFrame([("https://news.example/p/day", page, "2026-01-02"), ("https://news.example/p/none", "<article><p>alone</p></article>", "")], "url string, html string, lastmod string")
    found = {(r.url[-4:], r.position): r for r in extract.parse_story_posts(df).collect()}
    one, two = found["/day", 1], found["/day", 2]
    assert (one.source, two.source, one.date) == ("intro_list+heading", "intro_list+heading", "2026-01-02") and "left out" not in two.text
    assert found["none", 1].source == "single_fallback" and found["none", 1].post_title == "None"


def test_page_parts(spark):
    ld = '<script type="application/ld+json">{"datePublished": "2026-02-03T01:02:03Z"}</script>'
    many = '<script type="application/ld+json">[{"x": 1}, {"dateCreated": "2026-02-04"}]</script>'
    pre = 'window._preloads = JSON.parse("{\\"post\\":{\\"title\\":\\"T\\",\\"post_date\\":\\"2026-01-01\\",\\"body_html\\":\\"<p>x</p>\\"}}")'
    df = spark.createDataFrame([(1, ld), (2, many), (3, "<script>bad</script>"), (4, pre)], "id int, html string")
    got = {r.id: r for r in df.select("id", html.published_date(F.col("html")).alias("d"), html.preload(F.col("html"))["title"].alias("t")).collect()}
    assert (got[1].d, got[2].d, got[3].d, got[4].t) == ("2026-02-03", "2026-02-04", None, "T")
    concall = "<p>Jan 2026</p><a>Transcript</a><p>Apr 2026</p><a>Notes</a><a>transcript</a>"
    t = extract.transcript_dates(spark.createDataFrame([("u", concall)], "url string, html string"))
    assert sorted(r.date for r in t.collect()) == ["2026-01-01", "2026-04-01"]
    heads = spark.createDataFrame([("<article><h2>A | B</h2><h3>C</h3></article><h2>out | side</h2>",)], "html string")
    assert rows(heads.select(html.presentation_headings(F.col("html")), html.barred_headings(F.col("html")))) == [(["A | B", "C"], ["A | B"])]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)]
    above = {i: i for i in range(120)}
    for a, b in edges:
        low, high = sorted((above[a], above[b]))
        above = {k: low if v == high else v for k, v in above.items()}
    nodes = spark.createDataFrame([(i,) for i in above], "id int")
    assert dict(rows(graph.components(nodes, spark.createDataFrame(edges, "a int, b int")))) == above
    assert dict(rows(graph.components(nodes, spark.createDataFrame([], "a int, b int")))) == {i: i for i in above}


def test_blocking_loses_no_compatible_pair(spark):
    r = random.Random(7)
    words = ["tata", "motors", "motor", "steel", "state", "bank", "of", "india", "sbi", "global", "technologies", "tech", "amc", "asset", "management", "company", "ltd", "ts"]
    names = sorted({" ".join(r.sample(words, r.randint(1, 4))) for _ in range(160)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    pairs = df.select(F.col("n").alias("l")).crossJoin(df.select(F.col("n").alias("r"))).where("l < r")
    key = lambda c: company_key(F.col(c))
    good = pairs.where((key("l") != "") & (key("r") != "") & (decided_compatible(F.col("l"), F.col("r")) | (ratio(key("l"), key("r")) >= SAME_NAME)))
    near = resolution.block_pairs(resolution.with_blocks(df.select(F.col("n").alias("name")), "name"), ["name"], "name").toDF("l", "r")
    assert good.count() > 50 and good.join(near, ["l", "r"], "left_anti").count() == 0
    assert near.count() == near.distinct().count()


def test_rare_strings_lose_no_similar_pair(spark):
    """Misspelt long names, which only their three-letter strings bring together."""
    r = random.Random(11)

    def misspelt(x):
        for _ in range(r.randint(1, 4)):
            i = r.randrange(len(x))
            x = r.choice([x[:i] + x[i + 1 :], x[:i] + r.choice("abn ") + x[i:], x[:i] + r.choice("abn") + x[i + 1 :]])
        return x

    plain = ["".join(r.choice("abnk") for _ in range(r.randint(4, 60))) for _ in range(40)]
    names = sorted({m.strip() for x in plain for m in [x, *(misspelt(x) for _ in range(5))] if m.strip()})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    keys = [x.k for x in df.select(company_key(F.col("name")).alias("k"), "name").orderBy("name").collect()]
    near = {(x.l_name, x.r_name) for x in resolution.block_pairs(resolution.with_blocks(df, "name"), ["name"], "name").collect()}
    similar = {(a, b) for (a, x), (b, y) in itertools.combinations(zip(names, keys, strict=True), 2) if x and y and max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()) >= SAME_NAME}
    assert len(similar) > 100 and not similar - near


def resolved(spark, companies, quotes=(), mentions_=(), aliases=(), blocks=()):
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(companies)], "ord int, id string, name string, url string")
    q = spark.createDataFrame([(f"q{i}", x, "e1") for i, x in enumerate(quotes)], "id string, company_id string, edition_id string")
    m = spark.createDataFrame([(f"m{i}", x, "e1") for i, x in enumerate(mentions_)], "id string, company_id string, edition_id string")
    pairs = lambda xs: rule_pairs(spark.createDataFrame(list(xs), "left string, right string"))
    return resolution.resolve(c, q, m, pairs(aliases), pairs(blocks), NAMES, ["market.example"])


def test_resolution(spark):
    listing = "https://market.example/markets/stocks/NSE/{}/"
    got = resolved(
        spark,
        [("sbi", "SBI", None), ("state-bank-of-india", "State Bank of India", listing.format("SBIN")), ("iex", "IEX", None), ("indian-energy-exchange", "Indian Energy Exchange Ltd", None), ("adani-cement", "Adani Cement", None), ("ambuja-cement", "Ambuja Cement", None), ("not-a-company", "Not A Company", None), ("x-one", "Xylo One", listing.format("XX")), ("y-two", "Other Two", listing.format("XX")), ("z-three", "Third Thing", listing.format("XX"))],
        quotes=["sbi", "state-bank-of-india", "state-bank-of-india", "not-a-company", "x-one", "x-one", "y-two"],
        mentions_=["z-three", "iex"],
        aliases=[("IEX", "Indian Energy Exchange")],
        blocks=[("Adani Cement", "Ambuja Cement")],
    )
    variants = dict(rows(got.variants))
    assert variants["sbi"] == variants["state-bank-of-india"] == "state-bank-of-india"
    assert variants["iex"] == variants["indian-energy-exchange"] and variants["adani-cement"] != variants["ambuja-cement"]
    assert dict(rows(got.quarantined)) == {"not-a-company": "non_company_label", "z-three": "market_key_conflict_mentions_only"}
    by = {r.id: r for r in got.companies.collect()}
    bank = by["state-bank-of-india"]
    assert (bank.name, bank.market_key, bank.identity_source, bank.identity_confidence) == ("SBI", "NSE:SBIN", "market_key+name", "high")
    assert by["x-one"].market_key == "NSE:XX" and by["y-two"].market_key is None and by["y-two"].identity_source == "single"
    counts = dict(rows(got.counts))
    assert counts["dropped_quote_rows"] == 1 and counts["dropped_mention_rows"] == 1 and counts["market_conflicts"] == 1 and counts["cross_bucket_merges"] == 1
    assert got.quotes.where("company_id = 'state-bank-of-india'").count() == 3


def test_refinement_splits_what_a_bridge_joined(spark):
    got = resolved(spark, [("a", "Alpha Steel Works", None), ("b", "Beta Foods House", None), ("c", "Gamma", None)], aliases=[("Alpha Steel Works", "Gamma"), ("Gamma", "Beta Foods House")], quotes=["c"])
    v = dict(rows(got.variants))
    assert v["a"] != v["b"] and v["c"] in (v["a"], v["b"])


def test_linking(spark):
    cands = spark.createDataFrame([(0, "Netflix Nettlinx Limited", "NSE", "NETTLINX", "", "n"), (1, "LTIMindtree Limited", "NSE", "LTIM", "ltimindtree", "l"), (2, "Alpha Bank Limited", "NSE", "ALPHA", "alpha-bank", "a")], "ord int, display_name string, exchange string, symbol string, slug string, listing_url string")
    cs = spark.createDataFrame([("alpha-bank", "Alpha Bank", None), ("l-t-mindtree", "L&T Mindtree", None), ("nettlinxx", "Nettlinxx", None)], "id string, name string, slug_url string")
    got = {r.id: r.symbol for r in linking.best_listings(cs, cands, ["market.example"]).collect()}
    assert got["alpha-bank"] == "ALPHA" and got["l-t-mindtree"] == "LTIM" and "nettlinxx" not in got
    index = cands.select("symbol", "listing_url")
    u = "https://market.example/markets/stocks/"
    companies = spark.createDataFrame([("a", "A", u + "NSE/KEEP"), ("b", "B", u + "BSE/ALPHA"), ("c", "C", None), ("alpha-bank", "Alpha Bank", u + "alpha-bank")], "id string, name string, url string")
    over = spark.createDataFrame([("c", u + "BSE/C/"), ("gone", u + "NSE/G/")], "company_key string, url string")
    linked = linking.linked_companies(companies, cands, over, index, ["market.example"])
    got = {r.id: (r.url, r.link_source) for r in linked.collect()}
    assert got == {"a": (u + "NSE/KEEP/", "existing"), "b": ("a", "converted"), "c": (u + "BSE/C/", "override"), "alpha-bank": ("a", "matched")}
    must = spark.createDataFrame([("a", "x"), ("lost", "y")], "company_key string, expected_url string")
    assert {r.finding for r in linking.link_audit(linked, over, must).collect()} == {"override_without_company", "mandatory_missing", "mandatory_mismatch"}
    assert linking.link_counts(linked).first().linked == 4


def test_mentions(spark):
    stories = spark.createDataFrame([("s", "Tata Motors and Tata Steel; motors"), ("t", None), ("u", "")], "story_id string, text string")
    a = spark.createDataFrame([("tm", "tata motors"), ("tm", "motors"), ("ts", "tata steel")], "company_id string, alias string")
    assert sorted(rows(mentions.story_mentions(stories, a))) == [("s", "tm", 2), ("s", "ts", 1)]
    rules = alias_rules(spark, {"company_aliases": {"a": ["Alpha & Co"], "strict": ["Only This"]}, "alias_overrides": {"shared": "a"}, "blocked_aliases": ["the"], "strict_companies": ["strict"], "company_blocked_aliases": {"b": ["beta"]}})
    companies = spark.createDataFrame([("a", "Alpha Ltd", "https://market.example/markets/stocks/NSE/ALPHA/"), ("b", "Beta", None), ("strict", "Strict Name", None)], "id string, name string, url string")
    members = spark.createDataFrame([("b", "Shared"), ("b", "The"), ("b", "12")], "id string, member_name string")
    got = mentions.company_aliases(companies, members, rules, ["market.example"])
    assert sorted(rows(got.select("company_id", "alias"))) == [("a", "alpha"), ("a", "alpha and co"), ("a", "alpha ltd"), ("a", "shared"), ("b", "shared"), ("strict", "only this")]
    assert sorted(r.company_id for r in mentions.unique_aliases(got, rules["alias_overrides"]).where("alias = 'shared'").collect()) == ["a"]


def test_coverage(spark):
    q = spark.createDataFrame([("Q3", "2026-01-01", "2026-03-31", "2026-05-31"), ("Q4", "2026-04-01", "2026-06-30", "2026-08-31")], "name string, begin string, end string, deadline string")
    assert [sorted(r.name for r in coverage.active_quarters(q, d).collect()) for d in ("2026-05-15", "2026-06-15")] == [["Q3", "Q4"], ["Q4"]]
    el = spark.createDataFrame([("Q3", 1, "B"), ("Q4", 2, "A")], "quarter string, quarter_ord int, symbol string")
    es = spark.createDataFrame([("e", 0, "A"), ("e", 1, "B")], "edition string, ord int, symbol string")
    assert rows(coverage.edition_quarters(es, el).select("edition", "quarter")) == [("e", "Q4")]
    more = es.union(spark.createDataFrame([("a", 0, "A")], "edition string, ord int, symbol string"))
    assert sorted(rows(coverage.first_coverage(more, el))) == [("Q4", "A", "a")]
    u = spark.createDataFrame([(0, "HZ", "Hindustan Zinc Limited"), (1, "APG", "Alpha Power Grid"), (2, "APW", "Alpha Power Works"), (3, "SBIN", "State Bank of India")], "ord int, symbol string, name string")
    names = spark.createDataFrame([("Hind Zinc",), ("Alpha Power",), ("sbin",), ("The Bank",), ("SBI",), ("State Bank of India Ltd",), ("SB",), ("",)], "name string")
    aliases, acr = spark.createDataFrame([("the bank", "SBIN")], "alias string, symbol string"), spark.createDataFrame([("SBI", "State Bank of India")], "acronym string, full_name string")
    got = {r.name: (r.symbol, r.layer) for r in coverage.resolve_symbols(names, u, aliases, acr).collect()}
    assert got == {"Hind Zinc": ("HZ", 6), "sbin": ("SBIN", 1), "The Bank": ("SBIN", 2), "SBI": ("SBIN", 3), "State Bank of India Ltd": ("SBIN", 4), "SB": ("SBIN", 5)}
    f = spark.createDataFrame([("c", "Investor Presentation", "2026-01-20"), ("c", "Investor Presentation", "2026-01-18"), ("c", "Earnings Call Transcript", "2026-01-22"), ("d", "Other", "2026-01-01")], "code string, category string, day string")
    assert rows(coverage.first_filings(f)) == [("c", "2026-01-18", "2026-01-22")]


def test_refresh(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "1")], "url string, lastmod string")
    c = spark.createDataFrame([("a", "1", "A"), ("b", "1", "B"), ("gone", "1", "G")], "url string, lastmod string, body string")
    plan = refresh.plan_refresh(s, c.select("url", "lastmod"))
    assert dict(rows(plan)) == {"a": "reuse", "b": "parse", "n": "parse", "gone": "drop"}
    done = spark.createDataFrame([("b", "2", None, "failed"), ("n", "1", "N", None)], "url string, lastmod string, body string, error string")
    assert sorted(rows(refresh.refreshed(plan, c, done).select("url", "body"))) == [("a", "A"), ("b", "B"), ("n", "N")]
    v2 = '{"quarters":[{"name":"Q4","companies":[{"symbol":"A","transcript":{"eligible_since":"2026-01-10"}}]}]}'
    v1 = '{"active_quarter":"Q3","companies":[{"symbol":"B","presentation":{"eligible_since":"2026-01-11"}}]}'
    assert sorted(rows(refresh.read_state(spark.createDataFrame([(v2,), (v1,)], "json string")))) == [("Q3", "B", None, "2026-01-11"), ("Q4", "A", "2026-01-10", None)]
    new, old = spark.createDataFrame([("A", None)], "symbol string, since string"), spark.createDataFrame([("A", "2026-01-10")], "symbol string, since string")
    assert rows(refresh.monotone(new, old, ["symbol"], "since")) == [("A", "2026-01-10")]


def test_gates(spark):
    v = spark.createDataFrame([("SBI", "x"), ("State Bank of India", "x"), ("Crocs", "y")], "name string, canonical_id string")
    p = spark.createDataFrame([("SBI", "State Bank of India"), ("SBI", "Crocs"), ("SBI", "Nobody")], "left string, right string")
    assert sorted(rows(gates.pair_states(p, v))) == [("SBI", "Crocs", False), ("SBI", "State Bank of India", True)]
    gates.require_empty(gates.leaking_quotes(spark.createDataFrame([("q", "a"), ("q", "a")], "id string, company_id string")), "leaks")
    with pytest.raises(AssertionError):
        gates.require_empty(gates.leaking_quotes(spark.createDataFrame([("q", "a"), ("q", "b")], "id string, company_id string")), "leaks")
    cov = spark.createDataFrame([("A", "e1"), ("A", "e2")], "name string, edition_id string")
    assert rows(gates.unmet_expectations(spark.createDataFrame([("A", 2), ("B", 1)], "name string, least_editions int"), cov).select("name")) == [("B",)]


def test_serve(spark):
    r = spark.createDataFrame([("a", "Red Co", 1, 1), ("b", "Reddish", 5, 0), ("c", "Blue", 0, 9), ("d", "red", 0, 0)], "slug string, name string, quote_count int, story_mentions_count int")
    assert [x.slug for x in sorted(serve.featured(r, ["d"], 3).collect(), key=lambda x: x.featured_rank)] == ["d", "c", "b"]
    assert [x.slug for x in sorted(serve.search(r, "red").collect(), key=lambda x: x.search_rank)] == ["d", "a", "b"]


def test_web(spark, tmp_path):
    xml = "<urlset><url><loc>https://n.example/p/b</loc><lastmod>2026-01-02T00:00:00Z</lastmod></url><url><loc>https://n.example/p/a</loc></url><url><loc>https://n.example/x</loc></url></urlset>"
    df = spark.createDataFrame([("noise" + xml,)], "html string")
    assert rows(web.sitemap_entries(df, "https://n.example/p/")) == [("https://n.example/p/a", ""), ("https://n.example/p/b", "2026-01-02")]
    assert rows(df.select(web.trimmed_xml(F.col("html")))) == [(xml,)]
    (tmp_path / "i.csv").write_text("exchange,segment,instrument_type,tradingsymbol,name\nNSE,NSE,EQ,a,Short\nNSE,NSE,BE,A,Longer\nBSE,BSE,EQ,B,x\n")
    assert rows(web.instrument_candidates(spark, str(tmp_path / "i.csv"))) == [("A", "Longer", "NSE")]
    empty = spark.createDataFrame([], "symbol string, display_name string, exchange string")
    assert web.instrument_candidates(spark, str(tmp_path / "none.csv"), empty) is empty
    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise PermissionError
        return "ok"

    assert web.fetch_with_retry(fetch, "u", wait=waits.append) == "ok" and waits == [2, 3]

    class Two(web.PagedSource):
        columns = "item int"

        @classmethod
        def name(cls):
            return "two"

        @staticmethod
        def fetch_page(key, page):
            return [(page * 2 + i,) for i in range(2)], 4

    spark.dataSource.register(Two)
    assert spark.read.format("two").option("keys", "a,b").load().count() == 8


def test_stream_upsert(spark, tmp_path):
    schema, out = "url string, lastmod int", str(tmp_path / "out")
    for n, batch in enumerate(([("a", 1), ("b", 1), (None, 1)], [("a", 2), ("a", 1)], [("b", 0), ("c", 5)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.upsert_batches(stream.stream_table(spark, str(tmp_path / "in"), schema), out, "url", "lastmod", str(tmp_path / "check")).awaitTermination()
    known = [[("a", 1), ("b", 1), (None, 1)], [("a", 2), ("b", 1), (None, 1)], [("a", 2), ("b", 1), ("c", 5), (None, 1)]]
    assert [sorted(rows(stream.read_snapshot(spark, out, n, schema)), key=str) for n in range(3)] == [sorted(x, key=str) for x in known]
    assert len(list((tmp_path / "out/rows/1").glob("bucket=*"))) == 1  # only the bucket of the batch's key is written again


def test_story_rows_fill_gaps(spark):
    posts = spark.createDataFrame([("u", "Post", "2026-01-01", [("", "", 1, None, " text "), ("id", "Title", 2, "h1", "more"), ("x", "y", 3, "", " ")]), ("v", "", "", None)], "url string, title string, date string, stories array<struct<story_id:string,title:string,position:int,source:string,text:string>>")
    got = sorted(rows(extract.story_rows(posts).select("story_id", "story_title", "position", "source", "text")))
    assert got == [("id", "Title", 2, "h1", "more"), ("u-1-post", "Post", 1, "", "text")]


def test_eligibility_and_unmatched(spark):
    u = spark.createDataFrame([("A", "1"), ("B", "2"), ("C", "3")], "symbol string, code string")
    f = spark.createDataFrame([("1", "p", "t"), ("2", None, "t")], "code string, presentation_date string, transcript_date string")
    t = spark.createDataFrame([("A", "s")], "symbol string, first_day string")
    assert sorted(rows(coverage.eligibility(u, f, t))) == [("A", "s", "p"), ("B", "t", None)]
    names = spark.createDataFrame([("x",), ("y",), ("y",)], "name string")
    assert rows(coverage.unmatched(names, names.where("name = 'x'"))) == [("y",)]
