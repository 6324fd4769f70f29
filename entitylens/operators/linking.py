"""Companies to listing candidates (JOIN6, JOIN13, JOIN14, SIM4-SIM6): equi-joins on blocks that cover every confident pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text, urls
from .graph import checkpointed
from .relational import dealt, keep_best

LEAST_SCORE = 120


def name_hints(companies: DataFrame, hosts: list[str]) -> DataFrame:
    """companies (id, name, url) -> (id, name, hint, hint_ord): name, id as words, and the words of a slug address; each once."""
    hints = F.array(F.col("name"), F.replace("id", F.lit("-"), F.lit(" ")), urls.slug_hint(F.col("slug_url"), hosts))
    rows = companies.where("id <> 'global'").select("id", "name", F.posexplode(hints).alias("hint_ord", "hint")).where("hint IS NOT NULL AND trim(hint) <> ''")
    rows = keep_best(rows.withColumn("_k", F.lower(F.trim("hint"))), ["id", "_k"], [F.col("hint_ord")])
    return rows.withColumn("is_name", F.col("_k") == F.lower("name")).drop("_k")


def _blocks(tokens: Column, *joined: Column) -> Column:
    """Keys of words and of joined words."""
    keyed = F.filter(F.array(*joined), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(tokens, lambda t: F.concat(F.lit("t:"), t)), F.transform(keyed, lambda x: F.concat(F.lit("e:"), x))))


def candidate_pairs(hints: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs that share a block, with the words (_t, _d, _s) and joined words (_fp, _dfp, _sfp) of both sides, which are made once a row, not once a pair.

    A confident match is exact, overlaps in a token, or is similar enough to share a part of
    its joined words (`part_keys`), so none is lost; first letters alone would make blocks that
    grow with the square of the table. A pair comes from the first word that it shares, and once
    more for each shared part.
    """
    words = text.lookup_tokens
    left = hints.withColumn("_t", words(F.col("hint"))).withColumn("_fp", F.coalesce(F.nullif(F.array_join("_t", ""), F.lit("")), F.regexp_replace(F.lower("id"), "[^a-z0-9]+", "")))
    right = candidates.withColumn("_d", words(F.col("display_name"))).withColumn("_s", words(F.coalesce(F.col("slug"), F.lit(""))))
    right = right.withColumn("_dfp", F.array_join("_d", "")).withColumn("_sfp", F.array_join("_s", ""))
    # Small files, much work on a row.
    left, right = dealt(left, "_fp"), dealt(right, "_dfp")
    by_word = left.withColumn("_lb", _blocks(F.col("_t"), F.col("_fp"))).withColumn("block", F.explode("_lb"))
    words_of = right.withColumn("_rb", _blocks(F.concat("_d", "_s"), F.col("_dfp"), F.col("_sfp"))).withColumn("block", F.explode("_rb"))
    pairs = by_word.join(words_of, "block").where(F.col("block") == F.get(F.array_intersect("_lb", "_rb"), F.lit(0))).drop("block", "_lb", "_rb")
    for some, least in ((F.size("_t") == 1, S.NEAR_WORD), (F.size("_t") >= 2, S.NEAR_WORDS)):
        places = left.where(some).withColumn("block", F.explode(S.near_keys(F.col("_fp"), least, parts=False)))
        parts = F.array_distinct(F.concat(S.near_keys(F.col("_dfp"), least, parts=True), S.near_keys(F.col("_sfp"), least, parts=True)))
        pairs = pairs.unionByName(places.join(right.withColumn("block", F.explode(parts)), "block").drop("block"))
    return pairs


def best_listings(companies: DataFrame, candidates: DataFrame, hosts: list[str]) -> DataFrame:
    """(id, symbol, listing_url, score) of the best confident candidate; ties go to the earlier hint, then the earlier candidate.

    companies: id, name, slug_url. candidates: ord, display_name, exchange, symbol, slug, listing_url.
    """
    pairs = candidate_pairs(name_hints(companies, hosts), candidates)
    pairs = pairs.withColumn("f", S.match_features(*map(F.col, ("_t", "_fp", "_d", "_s", "_dfp", "_sfp"))))
    # Cheap conditions first: the longest common length already bounds the ratio.
    bound = F.greatest(S.quick_bound(F.col("f.fp"), F.col("f.display_fp")), S.quick_bound(F.col("f.fp"), F.col("f.slug_fp")))
    pairs = pairs.where(F.col("f.exact") | ((F.col("f.overlap") >= 1) & (bound >= 0.63)) | ((F.col("f.prefix") >= 2) & (bound >= 0.88)))

    def sim(a: str, b: str) -> Column:
        return F.when((F.col(a) != "") & (F.col(b) != ""), S.ratio(F.col(a), F.col(b))).otherwise(F.lit(0.0))

    pairs = pairs.withColumn("_dsim", sim("_fp", "_dfp")).withColumn("_ssim", sim("_fp", "_sfp"))
    pairs = pairs.where(S.is_confident(F.col("f"), F.greatest("_dsim", "_ssim")))
    score = S.match_score(F.col("f"), F.col("exchange"), F.col("_dsim"), F.col("_ssim")) + F.when(F.col("is_name"), 6).otherwise(0)
    best = keep_best(pairs.withColumn("score", score.cast("int")), ["id"], [F.desc("score"), F.col("hint_ord"), F.col("ord")])
    return best.where(F.col("score") >= LEAST_SCORE).select("id", "symbol", "listing_url", "score")


def linked_companies(companies: DataFrame, candidates: DataFrame, overrides: DataFrame, index: DataFrame, hosts: list[str]) -> DataFrame:
    """(id, name, url, link_source): the existing first-exchange listing, or its twin there for the other exchange; an override wins; else the best match.

    overrides: company_key, url. index: symbol, listing_url (one row for each).
    """
    p = urls.listing_parts(F.col("url"), hosts)
    made = companies.withColumn("kind", p["kind"]).withColumn("exchange", p["exchange"]).withColumn("symbol", p["symbol"]).withColumn("clean", urls.canonical_listing(F.col("url"), hosts))
    twin = index.select(F.col("symbol").alias("_sym"), F.col("listing_url").alias("_twin"))
    made = made.join(twin, F.col("symbol") == F.col("_sym"), "left").drop("_sym")
    kept = F.when(F.col("exchange") == "NSE", F.col("clean")).when(F.col("exchange") == "BSE", F.col("_twin"))
    made = made.withColumn("kept", kept).withColumn("slug_url", F.when(F.col("kind") == "slug", F.col("clean")))
    o = overrides.select(F.col("company_key").alias("_key"), urls.canonical_listing(F.col("url"), hosts).alias("_override"))
    made = made.join(o, F.col("id") == F.col("_key"), "left").drop("_key")
    best = best_listings(made.where("kept IS NULL AND _override IS NULL"), candidates, hosts).select(F.col("id").alias("_id"), F.col("listing_url").alias("_best"))
    made = made.join(best, F.col("id") == F.col("_id"), "left")
    source = F.when(F.col("_override").isNotNull(), "override").when(F.col("kept").isNotNull(), F.when(F.col("exchange") == "NSE", "existing").otherwise("converted")).when(F.col("_best").isNotNull(), "matched")
    return made.select("id", "name", F.coalesce("_override", "kept", "_best").alias("url"), source.alias("link_source"))


def link_audit(linked: DataFrame, overrides: DataFrame, mandatory: DataFrame) -> DataFrame:
    """Findings (finding, id, detail): overrides without a company, mandatory companies that are missing or linked elsewhere."""
    linked = checkpointed(linked)  # read by three findings, linked once
    lost = overrides.join(linked, F.col("company_key") == F.col("id"), "left_anti").select(F.lit("override_without_company").alias("finding"), F.col("company_key").alias("id"), F.col("url").alias("detail"))
    m = mandatory.join(linked, F.col("company_key") == F.col("id"), "left")
    missing = m.where("id IS NULL").select(F.lit("mandatory_missing").alias("finding"), F.col("company_key").alias("id"), F.col("expected_url").alias("detail"))
    wrong = m.where("id IS NOT NULL AND NOT (url <=> expected_url)").select(F.lit("mandatory_mismatch").alias("finding"), F.col("company_key").alias("id"), F.col("url").alias("detail"))
    return lost.union(missing).union(wrong)


def link_counts(linked: DataFrame) -> DataFrame:
    return linked.agg(F.count("*").alias("companies"), F.count("url").alias("linked"), *[F.count_if(F.col("link_source") == x).alias(x) for x in ("existing", "converted", "override", "matched")])
