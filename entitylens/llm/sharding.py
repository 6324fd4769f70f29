"""Operator 5: sharding by balanced label propagation.

Documents that share a link key (here: equal texts) are neighbours. Every document starts in
a shard given by a hash of its doc_id. In each round, a join with the neighbours' counts by
shard shows where most neighbours are, and documents move there as far as quotas allow:
moves in opposite directions are exchanged, and more come in while a shard has room. Links
are never expanded into pairs: documents of one key that stand in one shard are a unit,
counted once, and a large key is dealt over several units. At the end, shards are evened
out with documents that have no neighbours.

The law is `rows`: counts of any two shards differ by one at most, and slots are gapless
from 0. Null texts count as empty texts of size 1, linked to empty ones. A null doc_id is
placed like any other; rows of equal doc_id and text keep a place each. An empty table
gives no rows. Other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, running_sums, written

KEY = ["text_hash", "text_crc32", "size"]
#: Rounds of label propagation at most; it ends earlier once nothing moves.
ROUNDS = 10
BUCKETS = 1024
#: A key of more documents than this share of a shard is dealt over several units.
UNIT_SHARE = 1 / 16


def link_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size and what equal texts share."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.xxhash64(raw).alias("text_hash"))


def _cases(values: list, of: Column, default) -> Column:
    """values[of] as an expression; `values` has an entry for each shard."""
    return reduce(lambda made, x: made.when(of == x[0], F.lit(x[1])), enumerate(values), F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))


def propagate(units: DataFrame, quotas: list[int], unit: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Moves units (KEY, chunk, home, n) towards their neighbours; adds `shard`. A shard with room for less than `unit` documents counts as full."""
    shards = len(quotas)
    units = units.withColumn("shard", F.col("home"))
    still = 0
    for number in range(rounds):
        # Eight numbers each: what stands in the shards, and what would go from one to another.
        loads = {r.shard: r.n for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [x if (x := quotas[s] - loads.get(s, 0)) >= unit else 0 for s in range(shards)]
        counts = units.groupBy(*KEY).agg(*[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"c{s}") for s in range(shards)])
        # Most neighbours first; a key's own order of shards breaks ties, so that its units agree.
        order = F.array(*[F.struct(F.col(f"c{s}").alias("c"), F.xxhash64(*KEY, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)])
        counts = counts.select(*KEY, F.reverse(F.array_sort(order)).alias("best"))
        seen = units.join(counts, KEY)
        has_room = F.array(*[F.lit(x > 0) for x in room])
        with_room = F.filter("best", lambda x: F.element_at(has_room, x["s"] + 1) | (x["s"] == F.col("shard")))[0]["s"]
        # The best shard if it has room or can exchange, else the best with room that is better than the own.
        seen = seen.withColumn("first", F.col("best")[0]["s"]).withColumn("second", F.coalesce(with_room, F.col("shard")))
        wanted = {(r.shard, r.first): r.n for r in seen.where("first <> shard").groupBy("shard", "first").agg(F.sum("n").alias("n")).collect()}
        # Every other round leaves exchanges with full shards out: what cannot get in there gathers in the next best one.
        swaps = number % 2 == 0
        target = F.when(_pair_case({p: swaps and wanted.get((p[1], p[0]), 0) > 0 or room[p[1]] > 0 for p in wanted}, F.col("shard"), F.col("first"), False), F.col("first")).otherwise(F.col("second"))
        moves = seen.withColumn("to", target).where("to <> shard").drop("best", "first", "second")
        flows = {(r.shard, r.to): r.n for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        still = 0 if flows else still + 1
        if still == 2:
            break
        if not flows:
            continue
        allowed = _allowances(flows, room)
        ranked = running_sums(moves.withColumn("at", bucket(F.struct(*KEY), BUCKETS)), ["shard", "to"], "at", [*KEY, "chunk", "home"], F.col("n"), "before")
        taken = ranked.where(F.col("before") + F.col("n") <= _pair_case(allowed, F.col("shard"), F.col("to"), 0)).select(*KEY, "chunk", "home", "to")
        units = written(units.join(taken, [*KEY, "chunk", "home"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "units")
    return units


def _pair_case(values: dict, a: Column, b: Column, default) -> Column:
    made = F.when(F.lit(False), F.lit(default))
    for (x, y), v in values.items():
        made = made.when((a == x) & (b == y), F.lit(v))
    return made.otherwise(F.lit(default))


def _allowances(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Documents that may go from one shard to another: as many as come back, and, for the largest flows first, what there is room for."""
    out, left = {}, list(room)
    for (a, b), n in sorted(flows.items(), key=lambda x: (-x[1], x[0])):
        swap = min(n, flows.get((b, a), 0))
        extra = min(n - swap, left[b])
        left[b] -= extra
        out[a, b] = swap + extra
    return out


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot."""
    rows = written(link_keys(docs), "sizes")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(1, int(total / shards * UNIT_SHARE))
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("members"))
    home = bucket(F.struct("doc_id", F.lit("home")), shards)
    chunks = F.ceil(F.col("members") / F.lit(most * 1.0)).cast("int")
    seen = rows.join(groups.where("members > 1"), KEY, "left").withColumn("home", home)
    seen = seen.withColumn("chunk", F.when(F.col("members").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("chunk")), chunks)).cast("int")).drop("members")
    seen = written(seen, "linked")
    linked = seen.where("chunk IS NOT NULL")
    units = written(linked.groupBy(*KEY, "chunk", "home").agg(F.count("*").alias("n")), "units")
    settled = propagate(units, quotas, most)
    placed = linked.join(settled.select(*KEY, "chunk", "home", "shard"), [*KEY, "chunk", "home"])
    # Documents of one key stand close together in the order of a shard, a large key in several buckets.
    near = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)) * 16 + F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(16))
    ranked = running_sums(placed.withColumn("at", near), ["shard"], "at", [*KEY, "doc_id"], F.lit(1), "rank")
    ranked = written(ranked.select("doc_id", "size", "text_crc32", "text_hash", "shard", "rank"), "placed")
    fits = F.col("rank") < _cases(quotas, F.col("shard"), 0)
    inside = ranked.where(fits)
    filled = {r.shard: r.n for r in inside.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # What has no neighbours, or no place where its neighbours are, fills the shards up.
    loose = seen.where("chunk IS NULL").select("doc_id", "size", "text_crc32", "text_hash").unionByName(ranked.where(~fits).select("doc_id", "size", "text_crc32", "text_hash"))
    loose = running_sums(loose.withColumn("at", bucket(F.col("doc_id"), BUCKETS)), [], "at", ["doc_id", "text_hash"], F.lit(1), "rank")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        free = quotas[s] - filled.get(s, 0)
        here = (F.col("rank") >= begin) & (F.col("rank") < begin + free)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("rank") - begin + filled.get(s, 0)).otherwise(slot)
        begin += free
    out = inside.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("rank").alias("slot"))
    return out.unionByName(loose.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot")))


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
