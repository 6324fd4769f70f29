"""Entity resolution (GRF2-GRF7, JOIN2, JOIN3, JOIN7, JOIN8, AGG7-AGG10, AGG13).

companies: ord, id, name, url. Edges are found by joins on blocking keys, never by all pairs;
order matters only in ties, which `ord` breaks.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates, text, urls
from ..functions import similarity as S
from ..sources.rules import NameRules
from .graph import checkpointed, components
from .relational import keep_best, remap, without


@dataclass
class Resolved:
    companies: DataFrame  # id, name, url, market_key, canonical_company_id, identity_confidence, identity_source
    variants: DataFrame  # id, canonical_id
    quotes: DataFrame
    mentions: DataFrame
    quarantined: DataFrame  # id, reason
    counts: DataFrame  # one row


def compatible_pairs(pairs: DataFrame, left: str, right: str, aliases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Those of `pairs` whose names are compatible; pairs that need the similarity go to its UDF alone (SIM3)."""
    rows = pairs.withColumn("_l", S.name_parts(F.col(left))).withColumn("_r", S.name_parts(F.col(right)))
    rows = rows.withColumn("_x", F.least("_l.key", "_r.key")).withColumn("_y", F.greatest("_l.key", "_r.key")).where("_x <> ''")
    rows = rows.join(blocks.select(F.col("a").alias("_x"), F.col("b").alias("_y")), ["_x", "_y"], "left_anti")
    rows = rows.join(aliases.select(F.col("a").alias("_x"), F.col("b").alias("_y"), F.lit(True).alias("_alias")), ["_x", "_y"], "left")
    rows = rows.withColumn("_yes", F.coalesce("_alias", F.lit(False)) | S.compatible_parts(F.col("_l"), F.col("_r")))
    a, b = F.col("_l.key"), F.col("_r.key")
    # The similarity is asked only where nothing else has said yes, and where lengths and letters leave it a chance.
    near = F.when(F.col("_yes"), F.lit(True)).when(S.quick_bound(a, b) >= S.SAME_NAME, S.ratio(F.when(~F.col("_yes") & (S.quick_bound(a, b) >= S.SAME_NAME), a), b) >= S.SAME_NAME)
    return rows.where(near).drop("_l", "_r", "_x", "_y", "_alias", "_yes")


def word_blocks(name: Column) -> Column:
    """Keys of which names share one if a rule other than similarity makes them compatible: words, joined words, initials against a single word."""
    tokens = text.words_of(text.company_key(name))
    own = text.initialism_tokens(name)
    every = F.array_distinct(F.concat(tokens, own))
    ignored = F.array(*[F.lit(x) for x in ("and", "of", "the")])
    short = F.array(text.initials(F.filter(own, lambda t: ~F.array_contains(ignored, t))), text.initials(own))
    joined = F.array_join(tokens, "")
    return F.array_distinct(F.filter(F.concat(F.transform(every, lambda t: F.concat(F.lit("w:"), t)), F.transform(short, lambda t: F.concat(F.lit("w:"), t)), F.array(F.concat(F.lit("j:"), joined))), lambda k: F.length(k) > 2))


#: Names whose ratio is 0.93 or more differ by at most 0.07 of both lengths, so by 0.14 / 0.93 of one's length.
EDITS = 0.1506


def with_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Adds `blocks`, keys of which compatible names share one: those of their words, and a name's rarest three-letter strings. `key` is unique.

    An edit spoils at most three strings of three letters. Of names that near, sets of strings
    lack at most 3 * edits of each other, so that many and one more of each, by the same order,
    have one in common; the rarest come first, so very common strings seldom make a block.
    """
    spelled = text.company_key(F.col("name"))
    rows = checkpointed(rows.withColumn("_words", word_blocks(F.col("name"))).withColumn("_spelled", spelled))
    n = F.length("_spelled")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(F.col("_spelled"), i, F.lit(3))))
    grams = rows.where(n > 0).select(key, (3 * F.floor(n * EDITS) + 1).alias("_most"), F.explode(grams).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("_often"))
    rarest = Window.partitionBy(key).orderBy("_often", "gram")
    first = grams.join(often, "gram").withColumn("_place", F.row_number().over(rarest)).where("_place <= _most")
    first = first.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.concat(F.lit("g:"), "gram")).alias("_grams"))
    made = rows.join(first, F.col(key) == F.col("_key"), "left")
    return made.withColumn("blocks", F.concat("_words", F.coalesce("_grams", F.array().cast("array<string>")))).drop("_words", "_spelled", "_key", "_grams")


def block_pairs(blocked: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Pairs of rows (l_, r_) that share a block, l before r in `order`; a pair comes from the first block that it shares, so it comes once."""
    a, b = (blocked.select(F.explode("blocks").alias("block"), "blocks", *[F.col(c).alias(f"{p}_{c}") for c in columns]).withColumnRenamed("blocks", f"{p}_blocks") for p in ("l", "r"))
    shared = F.get(F.array_intersect("l_blocks", "r_blocks"), F.lit(0))
    return a.join(b, "block").where((F.col(f"l_{order}") < F.col(f"r_{order}")) & (F.col("block") == shared)).drop("block", "l_blocks", "r_blocks")


def with_counts(companies: DataFrame, quotes: DataFrame, mentions: DataFrame, hosts: list[str]) -> DataFrame:
    q = quotes.groupBy(F.col("company_id").alias("_q")).agg(F.count("*").alias("n_quotes"))
    m = mentions.groupBy(F.col("company_id").alias("_m")).agg(F.count("*").alias("n_mentions"))
    made = companies.join(q, F.col("id") == F.col("_q"), "left").join(m, F.col("id") == F.col("_m"), "left").drop("_q", "_m")
    return made.fillna(0, ["n_quotes", "n_mentions"]).withColumn("market_key", urls.market_key(F.col("url"), hosts))


def alias_edges(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stage A: companies whose keys an alias rule joins."""
    keyed = rows.select("id", text.company_key(F.col("name")).alias("key"))
    left = aliases.join(keyed.select(F.col("id").alias("x"), F.col("key").alias("a")), "a")
    return left.join(keyed.select(F.col("id").alias("y"), F.col("key").alias("b")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _self_pairs(rows: DataFrame, key: str) -> DataFrame:
    a, b = (rows.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "ord", "name", "market_key")]) for p in ("l", "r"))
    return a.join(b, key).where("l_ord < r_ord")


def market_edges(rows: DataFrame, aliases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Stage B: compatible names with the same listing."""
    pairs = _self_pairs(rows.where("market_key IS NOT NULL").withColumn("_k", F.col("market_key")), "_k")
    return compatible_pairs(pairs, "l_name", "r_name", aliases, blocks).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def market_conflicts(rows: DataFrame) -> DataFrame:
    """Stage C: rows (with component) -> (id, conflict): `quarantine` or `detach` for what is not in its listing's strongest component."""
    listed = rows.where("market_key IS NOT NULL")
    comp = listed.groupBy("market_key", "component").agg(F.sum("n_quotes").alias("q"), F.sum("n_mentions").alias("m"), F.count("*").alias("n"), F.min("ord").alias("first"))
    comp = comp.withColumn("n_components", F.count("*").over(Window.partitionBy("market_key")))
    order = Window.partitionBy("market_key").orderBy(F.desc(F.col("q") * 10 + F.col("m") * 3), F.desc("n"), "first")
    losers = comp.withColumn("place", F.row_number().over(order)).where("place > 1")
    return listed.join(losers.select("market_key", "component", "q"), ["market_key", "component"]).select("id", "market_key", F.when(F.col("q") == 0, "quarantine").otherwise("detach").alias("conflict"))


def name_edges(rows: DataFrame, aliases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Stage D: same name key, unless both have different listings and no alias joins them."""
    keyed = rows.withColumn("_k", F.coalesce(F.nullif(text.company_key(F.col("name")), F.lit("")), F.col("id").cast("string")))
    pairs = _self_pairs(keyed, "_k").where("l_market_key IS NULL OR r_market_key IS NULL OR l_market_key = r_market_key")
    return compatible_pairs(pairs, "l_name", "r_name", aliases, blocks).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def _strength(desc: bool = True) -> list[Column]:
    order = [F.col("n_quotes"), F.col("n_mentions"), F.col("market_key").isNotNull().cast("int"), F.lower("name")]
    return [*[F.desc(x) if desc else x for x in order], F.col("ord")]


def anchor_edges(rows: DataFrame, aliases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Stage E: compatible anchors of different components, if their listings are equal or one side has none."""
    anchors = keep_best(rows, ["component"], _strength()).select("id", "ord", "name", "component")
    keys = rows.groupBy("component").agg(F.array_sort(F.collect_set("market_key")).alias("keys"))
    anchors = anchors.join(keys, "component")
    blocked = checkpointed(with_blocks(anchors, "id"))
    pairs = block_pairs(blocked, ["id", "ord", "name", "keys"], "ord")
    pairs = pairs.where((F.size("l_keys") == 0) | (F.size("r_keys") == 0) | (F.col("l_keys") == F.col("r_keys")))
    # An alias joins names that share no block.
    return compatible_pairs(pairs, "l_name", "r_name", aliases, blocks).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def refined(rows: DataFrame, aliases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Stage F: (id, cluster). Within a component, strongest first, each joins the first cluster with which all its names are compatible.

    Compatibility is found for the pairs of a component by joins; the greedy pass itself then
    needs only those edges. Components hold a company's spellings and are small.
    """
    many = rows.withColumn("_n", F.count("*").over(Window.partitionBy("component"))).where("_n > 1").drop("_n")
    pairs = _self_pairs(many.withColumn("_k", F.col("component")), "_k")
    good = compatible_pairs(pairs, "l_name", "r_name", aliases, blocks)
    good = good.select(F.col("_k").alias("component"), "l_id", "r_id")
    order = many.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy(*_strength()))).select("component", "id", "place")

    def clusters(members: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        fits = set(zip(edges.l_id, edges.r_id, strict=True)) | set(zip(edges.r_id, edges.l_id, strict=True))
        made: list[list] = []
        for x in members.sort_values("place").id:
            home = next((c for c in made if all((x, y) in fits for y in c)), None)
            if home is None:
                made.append(home := [])
            home.append(x)
        rows_ = [(x, f"{members.component.iloc[0]}#{i}") for i, c in enumerate(made) for x in c]
        return pd.DataFrame(rows_, columns=["id", "cluster"])

    id_type = rows.schema["id"].dataType.simpleString()
    split = order.groupBy("component").cogroup(good.groupBy("component")).applyInPandas(clusters, f"id {id_type}, cluster string")
    return rows.select("id", "component").join(split, "id", "left").select("id", F.coalesce("cluster", F.col("component").cast("string")).alias("cluster"))


def canonical_records(rows: DataFrame) -> DataFrame:
    """Stage G: rows (with cluster) -> one record for each cluster (AGG7-AGG9)."""
    suffix = text.has_legal_suffix(F.col("name")).cast("int")
    listed = F.col("market_key").isNotNull().cast("int")
    has_url = (F.coalesce(F.col("url"), F.lit("")) != "").cast("int")
    one = F.struct(listed, has_url, "n_quotes", "n_mentions", 1 - suffix, -F.length("name"), -F.col("place"))
    display = F.struct(suffix, F.size(text.name_tokens(F.col("name"))), F.length("name"), F.lower("name"), "place")
    good_url = F.when(F.col("url_key").isNotNull(), F.col("url"))
    g = rows.groupBy("cluster").agg(
        F.max_by("id", one).alias("id"), F.min_by("name", display).alias("name"), F.min_by(good_url, F.when(good_url.isNotNull(), F.col("place"))).alias("url"),
        F.min_by("url_key", F.when(good_url.isNotNull(), F.col("place"))).alias("market_key"), F.count("*").alias("n"), F.count_distinct("market_key").alias("n_keys"),
    )
    source = F.when((F.col("n") > 1) & (F.col("n_keys") > 0), "market_key+name").when(F.col("n") > 1, "name").when(F.col("url").isNotNull(), "market_key").otherwise("single")
    sure = F.when((F.col("n") > 1) & (F.col("n_keys") == 1) | (F.col("n") == 1) & F.col("url").isNotNull(), "high").otherwise("medium")
    return g.select("id", "name", "url", "market_key", F.col("id").alias("canonical_company_id"), sure.alias("identity_confidence"), source.alias("identity_source"), "cluster", "n")


def resolve(companies: DataFrame, quotes: DataFrame, mentions: DataFrame, aliases: DataFrame, blocks: DataFrame, names: NameRules, hosts: list[str]) -> Resolved:
    """Merges spellings of one company, sets labels that are no companies aside, and moves quotes and mentions over."""
    rows = with_counts(companies, quotes, mentions, hosts)
    label = predicates.matches_rules(F.col("name"), names.exact_keys, names.patterns, names.allow_keys) | predicates.is_topic_or_sentence(F.col("name"))
    rows = rows.withColumn("reason", F.when((F.trim("name") != "") & label, "non_company_label"))
    rows, aliases, blocks = checkpointed(rows), checkpointed(aliases), checkpointed(blocks)
    edges = checkpointed(alias_edges(rows, aliases).union(market_edges(rows, aliases, blocks)))
    first = components(rows, edges)
    rows = rows.join(first, "id")
    conflicts = checkpointed(market_conflicts(rows))
    rows = rows.join(conflicts.select("id", "conflict"), "id", "left")
    rows = rows.withColumn("reason", F.when(F.col("conflict") == "quarantine", "market_key_conflict_mentions_only").otherwise(F.col("reason")))
    detached = F.coalesce(F.col("conflict") == "detach", F.lit(False))
    rows = rows.withColumn("url", F.when(~detached, F.col("url"))).withColumn("market_key", F.when(~detached, F.col("market_key"))).drop("component", "conflict")
    rows = checkpointed(rows)
    live = rows.where("reason IS NULL")
    edges2 = checkpointed(edges.union(name_edges(live, aliases, blocks)))
    second = components(rows, edges2)
    before = checkpointed(live.join(second, "id"))
    edges3 = checkpointed(anchor_edges(before, aliases, blocks))
    third = components(rows, edges2.union(edges3))
    grouped = checkpointed(live.join(third, "id"))
    cluster = checkpointed(refined(grouped, aliases, blocks))
    final = grouped.join(cluster, "id").withColumn("url_key", urls.market_key(F.col("url"), hosts))
    final = final.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.when(F.col("cluster").contains("#"), 0).otherwise(F.col("ord")), *_strength())))
    records = checkpointed(canonical_records(final))
    variants = final.select("id", "cluster").join(records.select("cluster", F.col("id").alias("canonical_id")), "cluster").select("id", "canonical_id")
    variants = checkpointed(variants)
    gone = rows.where("reason IS NOT NULL").select("id", "reason")
    kept_q, gone_q = without(quotes, gone)
    kept_m, gone_m = without(mentions, gone)
    n = lambda df: df.agg(F.count("*").alias("n"))
    values = [("input_companies", n(rows)), ("canonical_companies", n(records)), ("quarantined_companies", n(gone)), ("merged_groups", n(records.where("n > 1"))), ("dropped_quote_rows", n(gone_q)), ("dropped_mention_rows", n(gone_m)), ("market_conflicts", conflicts.agg(F.count_distinct("market_key").alias("n")))]
    merges = before.agg(F.count_distinct("component").alias("n")).union(grouped.agg((-F.count_distinct("component")).alias("n"))).agg(F.sum("n").alias("n"))
    counts = None
    for name, df in [*values, ("cross_bucket_merges", merges)]:
        one = df.select(F.lit(name).alias("metric"), F.col("n").cast("long").alias("value"))
        counts = one if counts is None else counts.union(one)
    return Resolved(records.drop("cluster", "n"), variants, remap(kept_q, variants), remap(kept_m, variants), gone, counts)
