"""Quality gates (VAL1-VAL9): findings as rows; none means passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates, text
from ..sources.rules import NameRules


def stale_counts(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """metric, stored, computed where they differ."""
    s, c = stored.select("metric", F.col("value").alias("stored")), computed.select("metric", F.col("value").alias("computed"))
    return s.join(c, "metric", "full").where("NOT (stored <=> computed)")


def over_limits(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    return metrics.join(limits.withColumnRenamed("value", "most"), "metric").where("value > most")


def repeated_name_keys(companies: DataFrame) -> DataFrame:
    return companies.select(text.company_key(F.col("name")).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def pair_states(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """pairs (left, right) of names -> merged, for those whose names both exist. variants: name, canonical_id."""
    v = variants.select(text.company_key(F.col("name")).alias("key"), "canonical_id").distinct()
    a, b = (v.select(F.col("key").alias(f"_{x}"), F.col("canonical_id").alias(f"{x}_id")) for x in ("a", "b"))
    p = pairs.withColumn("_a", text.company_key(F.col("left"))).withColumn("_b", text.company_key(F.col("right")))
    return p.join(a, "_a").join(b, "_b").groupBy("left", "right").agg(F.max(F.col("a_id") == F.col("b_id")).alias("merged"))


def coexisting(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """Pairs of which both names are shown."""
    names = shown.select("name").distinct()
    return pairs.join(names.withColumnRenamed("name", "left"), "left", "left_semi").join(names.withColumnRenamed("name", "right"), "right", "left_semi")


def excluded_shown(excluded: DataFrame, shown: DataFrame) -> DataFrame:
    """Names (by their keys) that must be absent but are shown. excluded, shown: name."""
    keys = excluded.select(text.company_key(F.col("name")).alias("_key")).distinct()
    return shown.join(keys, text.company_key(F.col("name")) == F.col("_key"), "left_semi")


def suspicious_names(companies: DataFrame, rules: NameRules) -> DataFrame:
    bad = predicates.matches_rules(F.col("name"), rules.exact_keys, rules.patterns, rules.allow_keys) | predicates.is_topic_or_sentence(F.col("name"))
    return companies.where(bad & F.col("url").isNull())


def unmet_expectations(expected: DataFrame, coverage: DataFrame) -> DataFrame:
    """expected (name, least_editions), coverage (name, edition_id) -> those with fewer editions."""
    n = coverage.groupBy("name").agg(F.count_distinct("edition_id").alias("editions"))
    return expected.join(n, "name", "left").fillna(0, ["editions"]).where("editions < least_editions")


def missing_editions(required: DataFrame, coverage: DataFrame) -> DataFrame:
    return required.join(coverage.select("name", "edition_id").distinct(), ["name", "edition_id"], "left_anti")


def leaking_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("id").agg(F.count_distinct("company_id").alias("companies")).where("companies > 1")


def require_empty(findings: DataFrame, what: str) -> None:
    """Raises with a few examples if there is any finding."""
    some = findings.limit(5).collect()
    if some:
        raise AssertionError(f"{what}: {[r.asDict() for r in some]}")
