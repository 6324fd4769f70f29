"""Alias tables and phrase mentions in stories (AGG11, AGG15, FLT8, JOIN5, SRT8, WND2).

Story and alias are both space-joined words, so a phrase with word boundaries is an equal
run of words: word n-grams of the stories meet the aliases in an equi-join.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates, text, urls
from ..functions.udfs import arrow_udf


def company_aliases(companies: DataFrame, members: DataFrame, rules: dict[str, DataFrame], hosts: list[str]) -> DataFrame:
    """(company_id, alias) from six sources; strict companies have their explicit aliases only.

    companies: id, name, url. members: id, member_name.
    """
    def phrases(df, column):
        return df.select("company_id", text.phrase_key(column).alias("alias"))

    c = companies.withColumn("company_id", F.col("id"))
    open_ = c.join(rules["strict"], "company_id", "left_anti")
    explicit = rules["company_aliases"].join(c.select("company_id"), "company_id", "left_semi")
    found = phrases(open_, F.col("name")).union(phrases(open_, text.company_key(F.col("name"))))
    found = found.union(phrases(members.select(F.col("id").alias("company_id"), "member_name").join(open_.select("company_id"), "company_id", "left_semi"), F.col("member_name")))
    found = found.union(open_.select("company_id", urls.symbol_alias(F.col("url"), hosts).alias("alias"))).union(explicit.select("company_id", "alias"))
    found = found.union(rules["alias_overrides"].join(open_.select("company_id"), "company_id", "left_semi").select("company_id", "alias"))
    found = found.where(predicates.is_usable_alias(F.col("alias"))).distinct()
    return found.join(rules["blocked"], "alias", "left_anti").join(rules["company_blocked"], ["company_id", "alias"], "left_anti")


def unique_aliases(aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """Aliases of one company only, or of the company that an override names."""
    owners = aliases.withColumn("_n", F.count("*").over(Window.partitionBy("alias")))
    o = overrides.select("alias", F.col("company_id").alias("_owner"))
    return owners.join(o, "alias", "left").where(F.when(F.col("_owner").isNotNull(), F.col("_owner") == F.col("company_id")).otherwise(F.col("_n") == 1)).select("company_id", "alias")


MOST_FIRST_WORDS = 64


def phrase_hits(stories: DataFrame, aliases: DataFrame, story_id: str = "story_id", column: str = "text") -> DataFrame:
    """(story, company_id, alias, at, n_words) of every place where an alias stands."""
    lengths = [r.n for r in aliases.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect()]
    # Few first words leave few places to look at; with many, every place is a row.
    firsts = [r.w for r in aliases.select(F.split_part("alias", F.lit(" "), F.lit(1)).alias("w")).distinct().limit(MOST_FIRST_WORDS + 1).collect()]
    few = F.array(*map(F.lit, firsts)) if 0 < len(firsts) <= MOST_FIRST_WORDS else None
    keyed = aliases.withColumn("n_words", F.size(F.split("alias", " ")))
    words = stories.select(story_id, F.filter(F.split(text.phrase_key(F.col(column)), " "), lambda w: w != "").alias("w"))

    def runs(n: int) -> DataFrame:
        last = F.size("w") - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        starts = starts if few is None else F.filter(starts, lambda i: F.array_contains(few, F.element_at("w", i)))
        made = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.array_join(F.slice("w", i, F.lit(n)), " ").alias("alias")))
        return words.select(story_id, F.inline(made))

    grams = reduce(DataFrame.unionByName, map(runs, sorted(lengths))) if lengths else None
    if grams is None:
        return words.select(story_id).where("false").withColumns({"alias": F.lit(""), "at": F.lit(0), "company_id": F.lit(""), "n_words": F.lit(0)})
    return grams.join(keyed, "alias").select(story_id, "company_id", "alias", "at", "n_words")


@arrow_udf("int")
def _greedy_count(spans: pd.Series) -> pd.Series:
    """Of (order, at, n_words) in their order: how many do not overlap one taken before."""

    def count(xs) -> int:
        n, taken = 0, set()  # places of words
        for x in sorted(xs, key=lambda x: (x["o"], x["a"], x["at"])):
            span = range(x["at"], x["at"] + x["n"])
            if taken.isdisjoint(span):
                taken.update(span)
                n += 1
        return n

    return spans.map(count)


def story_mentions(stories: DataFrame, aliases: DataFrame, story_id: str = "story_id", column: str = "text") -> DataFrame:
    """(story, company_id, mention_count): longest aliases first, none over a word that is taken; equally long ones in the order of the alphabet."""
    hits = phrase_hits(stories, aliases, story_id, column)
    spans = F.collect_list(F.struct((-F.length("alias")).alias("o"), F.col("alias").alias("a"), "at", F.col("n_words").alias("n")))
    # Hits of one company in one story only.
    return hits.groupBy(story_id, "company_id").agg(spans.alias("s")).select(story_id, "company_id", _greedy_count("s").alias("mention_count"))


def plain_mentions(stories: DataFrame, aliases: DataFrame, story_id: str = "story_id", column: str = "text") -> DataFrame:
    """As story_mentions for aliases that cannot overlap (one word each): a count, without Python."""
    return phrase_hits(stories, aliases, story_id, column).groupBy(story_id, "company_id").agg(F.count("*").cast("int").alias("mention_count"))


def ranked_stories(mentions: DataFrame, by: str = "company_id", visible: int = 3) -> DataFrame:
    """Per company by mentions, date, title; the first few are visible (SRT1, SRT3)."""
    order = Window.partitionBy(by).orderBy(F.desc("mention_count"), F.desc("story_date"), F.lower("story_title"), "story_id")
    return mentions.withColumn("story_rank", F.row_number().over(order)).withColumn("visible", F.col("story_rank") <= visible)
