"""Scalar functions against cases whose values follow from the rules."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from entitylens.functions import dates, predicates, text, urls
from entitylens.functions import similarity as S

HOSTS = ["market.example", "news.market.example"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (text.slugify, "L'Oréal & Co.", "l-or-al-co"),
        (text.slugify, "!!!", "unknown"),
        (text.company_key, "HDFC AMC", "hdfc asset management"),
        (text.company_key, "HDFC AMC Ltd", "hdfc amc"),
        (text.company_key, "Limited", ""),
        (text.company_name, "Alpha Bank (Q3)", "Alpha Bank"),
        (text.company_name, "Alpha - Beta | Gamma", "Alpha"),
        (text.heading_parts, "Vedanta | Large Cap | Metals", ("Vedanta", "Metals")),
        (text.heading_parts, "Vedanta", ("Vedanta", None)),
        (text.quote_and_speaker, "“Growth is steady” – Ravi Kumar, CFO", ("Growth is steady", "Ravi Kumar, CFO")),
        (text.quote_and_speaker, "Margins of 10 - 12% next year", ("Margins of 10 - 12% next year", None)),
        (text.phrase_key, "A&B  (Ltd)", "a and b ltd"),
        (text.tracker_key, "L&T Finance Ltd", "l&t finance"),
        (text.html_escape, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"),
        (text.word_count, " a b  c ", 3),
        (text.is_speaker_line, "- Management", True),
        (text.is_direct_quote, "“We will double capacity by next year”", True),
        (urls.tracker_symbol, "https://x/markets/stocks/NSE/A.B/", "A"),
        (dates.month_label, "2025-05-13", "May'25"),
        (dates.story_label, "2025-05-13", "13 May 2025"),
        (dates.month_label, "", "Unknown"),
        (dates.month_label, "soon", "soon"),
        (dates.iso_date, "2025-05-13T10:00:00Z", "2025-05-13"),
        (dates.iso_date, "2025-13-45", ""),
        (dates.month_start, "Jan 2026", "2026-01-01"),
        (predicates.is_sector_like, "Banking and Financial Services", True),
        (predicates.is_sector_like, "Edition # 7", True),
        (predicates.is_listable_sector, "Edition # 7", False),
        (predicates.is_listable_sector, "Oil and Power", True),
        (predicates.is_sector_like, "Alpha Bank", False),
        (predicates.is_topic_or_sentence, "Telecom Minister on TRAI Satellite Spectrum Auction", True),
        (predicates.is_topic_or_sentence, "Alpha Bank", False),
        (predicates.is_hard_break, "Tidbits", True),
    ],
)
def test_scalar(spark, f, value, expected):
    found = one(spark, f(F.lit(value)))
    assert (tuple(found) if hasattr(found, "asDict") else found) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://www.market.example/markets/stocks/nse/hdfcbank/?x=1", "https://market.example/markets/stocks/NSE/HDFCBANK/"),
        ("https://market.example/markets/stocks/search", None),
        ("https://market.example/markets/stocks/NYSE/X/", None),
        ("https://market.example/markets/stocks/alpha-bank", "https://market.example/markets/stocks/alpha-bank/"),
        ("https://other.example/markets/stocks/NSE/X/", None),
        (None, None),
    ],
)
def test_canonical_listing(spark, url, expected):
    assert one(spark, urls.canonical_listing(F.lit(url).cast("string"), HOSTS)) == expected


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ("SBI", "State Bank of India", True),
        ("TCS", "Tata Consultancy Services", True),
        ("HDFC AMC", "HDFC Asset Management Company", True),
        ("ABB Limited", "ABB India Limited", True),
        ("Aditya Birla Fashion", "Aditya Birla Fashion & Retail Ltd", True),
        ("IEX", "Indian Energy Exchange", False),
        ("HUDCO", "Housing and Urban Development Corporation", False),
        ("REC Ltd.", "Rural Electrification Corporation", False),
        ("Adani Cement", "Ambuja Cement", False),
        ("Reliance Consumer Products", "Reliance Industries", False),
    ],
)
def test_compatible_without_similarity(spark, left, right, expected):
    assert one(spark, S.decided_compatible(F.lit(left), F.lit(right))) is expected


def test_ratio_is_difflibs(spark):
    pairs = [("aaba", "baaa"), ("baaa", "aaba"), ("netflix", "nettlinx"), ("tata motors", "tata motor"), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.ratio("a", "b").alias("r")).collect()
    assert all(r.r == SequenceMatcher(None, r.a, r.b).ratio() for r in rows)


def test_trailing_initialism(spark):
    assert one(spark, text.trailing_initialism(F.array(F.lit("tata"), F.lit("cs")), F.array(F.lit("tata"), F.lit("consultancy"), F.lit("services"))))
    assert not one(spark, text.trailing_initialism(F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))))
