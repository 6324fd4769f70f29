"""Operator 3: mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent
is bisected, four halvings at a time, until the weights have the target entropy (as a share
of the greatest possible), or until no source is repeated more than the limit allows within
the budget, whichever asks for the larger exponent. Each source then gets its quota of the
budget as a stream of epochs: an epoch is a permutation of the source's blocks (documents
dealt by hash), and documents are taken until the quota is met. Sums run block by block, so
a source with most of all documents is spread over its blocks.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Null and empty texts have none; a document without
tokens is taken with its block while its source's quota lasts. A null source is a source of
its own; sources without any token get no weight. Rows of equal doc_id are documents each.
An empty table gives no rows. Other columns are left out, but kept by `mixed_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_sums, written

HALVINGS, AT_A_TIME = 32, 4
BLOCK_TOKENS = 50_000
#: Production parameters of the query.
ENTROPY_SHARE, MAX_REPEAT, BUDGET_SHARE = 0.96, 4.0, 1.0


def hash32(*parts: Column | str) -> Column:
    """Unsigned 32 bits of an md5 of the parts, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def counted(docs: DataFrame, *more: Column) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), "source", words.cast("long").alias("tokens"), *more)


def bisected_exponent(shares: DataFrame, budget: int, entropy_share: float | None, max_repeat: float | None) -> float:
    """The larger of two exponents in 0..1: the one that meets the target entropy, and the least that keeps to the repetition limit.

    `shares` has (t: tokens) of each source. Entropy and the greatest repetition fall as the
    exponent rises; where even 1 falls short, it is 1 (the natural shares).
    """
    n = shares.count()

    def too_low(x: Column, found: str) -> Column:
        weight = F.pow(F.col("t").cast("double"), x)
        if found == "entropy":  # of weights w / sum(w): ln sum(w) - sum(w ln w) / sum(w)
            return F.log(F.sum(weight)) - F.sum(weight * x * F.log(F.col("t").cast("double"))) / F.sum(weight) > F.lit(entropy_share * math.log(max(1, n)))
        return F.lit(float(budget)) * F.max(weight / F.col("t")) / F.sum(weight) > F.lit(float(max_repeat))

    best = 0.0
    for found in ["entropy"] * (entropy_share is not None) + ["repeat"] * (max_repeat is not None):
        low, step = 0.0, 1.0
        if not shares.agg(too_low(F.lit(0.0), found).alias("x")).first().x:
            continue  # flat weights are allowed
        if shares.agg(too_low(F.lit(1.0), found).alias("x")).first().x:
            return 1.0
        for _ in range(HALVINGS // AT_A_TIME):
            step /= 2**AT_A_TIME
            row = shares.agg(*[too_low(F.lit(low + i * step), found).alias(f"x{i}") for i in range(1, 2**AT_A_TIME)]).first()
            low += step * sum(map(bool, row))
        best = max(best, low + step)
    return best


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, entropy_share: float | None = ENTROPY_SHARE, max_repeat: float | None = MAX_REPEAT, seed: str = "mix", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, tokens, epoch, block and position of each document taken; position: tokens of the source's stream before it."""
    return _mix(written(counted(docs), "counted"), [], budget_share, entropy_share, max_repeat, seed, block_tokens)


def _mix(rows: DataFrame, more: list[str], budget_share: float = BUDGET_SHARE, entropy_share: float | None = ENTROPY_SHARE, max_repeat: float | None = MAX_REPEAT, seed: str = "mix", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix of `counted` rows, with the columns `more`, which break ties between rows of equal doc_id."""
    sources = written(rows.groupBy("key").agg(F.sum("tokens").alias("t")).where("t > 0"), "sources")
    total = sources.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first().t
    if not total:
        return rows.where("false").select("doc_id", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("position"), *more)
    budget = int(total * budget_share)
    exponent = bisected_exponent(sources, budget, entropy_share, max_repeat)
    weight = F.pow(F.col("t").cast("double"), F.lit(exponent))
    norm = sources.agg(F.sum(weight).alias("norm")).first().norm
    limit = F.floor(F.col("t") * F.lit(max_repeat)) if max_repeat is not None else F.lit(2**62)
    quotas = sources.withColumn("quota", F.least(F.floor(F.lit(float(budget)) * weight / F.lit(norm)), limit).cast("long"))
    quotas = quotas.select("key", "t", "quota", F.ceil(F.col("t") / F.lit(float(block_tokens))).cast("long").alias("blocks"), F.ceil(F.col("quota") / F.col("t")).cast("int").alias("epochs")).where("quota > 0")
    taken = rows.join(quotas, "key").withColumn("block", F.pmod(hash32(F.lit(seed), "doc_id"), F.col("blocks")))
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    taken = taken.withColumn("at", hash32(F.lit(seed), "key", "epoch", "block") * F.lit(2**20) + F.pmod("block", F.lit(2**20)))
    taken = taken.withColumn("h", hash32(F.lit(seed), "epoch", "doc_id"))
    taken = running_sums(taken, ["key", "epoch"], "at", ["h", "doc_id", *more], F.col("tokens"), "before", span=2**40)
    position = F.col("epoch") * F.col("t") + F.col("before")
    return taken.withColumn("position", position).where("position < quota").select("doc_id", "source", "tokens", "epoch", "block", "position", *more)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, once for each epoch in which they are taken.

    A row is known by its doc_id, a hash of id, source and text, and its number among the rows equal in these.
    """
    known = F.col("doc_id").cast("long")
    same = F.xxhash64(known, known.isNull(), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("")))
    rows = written(counted(docs, same.alias("_same")), "counted")
    taken = _mix(rows, ["_same"], **options).groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("_same").alias("_key"), "epoch").agg(F.count("*").alias("_copies"))
    # One count for each epoch. Of rows that are equal, an epoch takes as many as it counts, from the first number on.
    taken = taken.groupBy("_id", "_key").agg(F.collect_list("_copies").alias("_copies"))
    numbered = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(known, F.lit(0)).alias("_doc"), same.alias("_same"))
    # Numbered and joined by the same keys: whole rows are exchanged once.
    numbered = numbered.withColumn("_number", F.row_number().over(Window.partitionBy("_doc", "_same").orderBy("_doc")))
    met = numbered.join(taken, (F.col("_doc") == F.col("_id")) & (F.col("_same") == F.col("_key")))
    times = F.size(F.filter("_copies", lambda x: x >= F.col("_number")))
    met = met.select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return met.select(*[F.col("row")[x].alias(x) for x in docs.columns])


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE
c AS (SELECT doc_id, source, coalesce('=' || source, '') AS key,
             len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS tokens FROM documents),
s AS (SELECT key, sum(tokens)::DOUBLE AS t FROM c GROUP BY key HAVING sum(tokens) > 0),
k AS (SELECT floor(sum(t) * {BUDGET_SHARE}) AS budget, {ENTROPY_SHARE} * ln(count(*)) AS goal FROM s),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS step
      UNION ALL
      SELECT i + 1, lo + CASE WHEN (SELECT ln(sum(pow(t, b.lo + b.step / 2))) - sum(pow(t, b.lo + b.step / 2) * (b.lo + b.step / 2) * ln(t)) / sum(pow(t, b.lo + b.step / 2)) FROM s) > (SELECT goal FROM k) THEN step / 2 ELSE 0 END, step / 2
      FROM b WHERE i < {HALVINGS}),
r AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS step
      UNION ALL
      SELECT i + 1, lo + CASE WHEN (SELECT (SELECT budget FROM k) * max(pow(t, r.lo + r.step / 2) / t) / sum(pow(t, r.lo + r.step / 2)) FROM s) > {MAX_REPEAT} THEN step / 2 ELSE 0 END, step / 2
      FROM r WHERE i < {HALVINGS}),
e AS (SELECT greatest(
        CASE WHEN (SELECT ln(count(*)) FROM s) <= (SELECT goal FROM k) THEN 0
             WHEN (SELECT ln(sum(t)) - sum(t * ln(t)) / sum(t) FROM s) > (SELECT goal FROM k) THEN 1
             ELSE (SELECT lo + step FROM b WHERE i = {HALVINGS}) END,
        CASE WHEN (SELECT (SELECT budget FROM k) * max(1 / t) / count(*) FROM s) <= {MAX_REPEAT} THEN 0
             WHEN (SELECT budget FROM k) / (SELECT sum(t) FROM s) > {MAX_REPEAT} THEN 1
             ELSE (SELECT lo + step FROM r WHERE i = {HALVINGS}) END) AS x),
q AS (SELECT key, t, least(floor((SELECT budget FROM k) * pow(t, (SELECT x FROM e)) / sum(pow(t, (SELECT x FROM e))) OVER ()), floor(t * {MAX_REPEAT}))::BIGINT AS quota FROM s),
p AS (SELECT doc_id, source, c.key, tokens, q.t, quota, ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT % ceil(q.t / {BLOCK_TOKENS}.0)::BIGINT AS block,
             unnest(generate_series(0, ceil(quota / q.t)::INTEGER - 1)) AS epoch FROM c JOIN q ON c.key = q.key WHERE quota > 0),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY key, epoch ORDER BY ('0x' || substr(md5('mix:' || key || ':' || epoch || ':' || block), 1, 8))::BIGINT, block % 1048576, ('0x' || substr(md5('mix:' || epoch || ':' || doc_id), 1, 8))::BIGINT, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p)
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch::INTEGER AS epoch, block::BIGINT AS block, (epoch * t + before)::BIGINT AS position
FROM o WHERE epoch * t + before < quota
"""
