"""Incremental refresh (INC1-INC4, SET4, TRK1, JSN3): keyed comparison of a snapshot with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_refresh(source: DataFrame, cached: DataFrame) -> DataFrame:
    """source, cached (url, lastmod) -> (url, action): `reuse`, `parse` for new and changed ones, `drop` for what the source lost."""
    s, c = source.select("url", F.col("lastmod").alias("_s"), F.lit(True).alias("_in")), cached.select("url", F.col("lastmod").alias("_c"), F.lit(True).alias("_had"))
    both = s.join(c, "url", "full")
    same = F.coalesce(F.col("_in") & F.col("_had") & (F.col("_s") == F.col("_c")), F.lit(False))
    return both.select("url", F.when(F.col("_in").isNull(), "drop").when(same, "reuse").otherwise("parse").alias("action"))


def refreshed(plan: DataFrame, cached: DataFrame, parsed: DataFrame) -> DataFrame:
    """Cached rows that are reused, and those whose parse failed; new rows for the rest. parsed: as cached, with `error`."""
    ok = parsed.where("error IS NULL").drop("error")
    stay = cached.join(plan.where("action = 'reuse'").select("url"), "url", "left_semi")
    failed = parsed.where("error IS NOT NULL").select("url")
    return stay.unionByName(cached.join(failed, "url", "left_semi")).unionByName(ok)


def with_failures_apart(df: DataFrame, result: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad): one bad item does not stop the rest."""
    made = df.withColumn("_result", result).withColumn("_error", error)
    return made.where("_error IS NULL").drop("_error"), made.where("_error IS NOT NULL").drop("_result")


def new_rows(source: DataFrame, cached: DataFrame, key: str = "url") -> DataFrame:
    """Append only: what the cache has not."""
    return source.join(cached.select(key), key, "left_anti")


def cache_hits(source: DataFrame, cached: DataFrame, key: str = "url") -> DataFrame:
    """(hits, misses): how many of the source's rows the cache has (INC2)."""
    known = cached.select(F.col(key).alias("_k")).distinct()
    met = source.join(known, F.col(key) == F.col("_k"), "left")
    return met.agg(F.count("_k").alias("hits"), F.count_if(F.col("_k").isNull()).alias("misses"))


def monotone(new: DataFrame, old: DataFrame, key: list[str], value: str) -> DataFrame:
    """A value once known is never overwritten by null."""
    o = old.select(*key, F.col(value).alias("_old"))
    return new.join(o, key, "full").withColumn(value, F.coalesce(value, "_old")).drop("_old")


STATE_V2 = "quarters array<struct<name:string,companies:array<struct<symbol:string,transcript:struct<eligible_since:string>,presentation:struct<eligible_since:string>>>>>"
STATE_V1 = "active_quarter string, companies array<struct<symbol:string,transcript:struct<eligible_since:string>,presentation:struct<eligible_since:string>>>"


def read_state(raw: DataFrame, column: str = "json") -> DataFrame:
    """(quarter, symbol, transcript_since, presentation_since) of either version of the state."""
    v2, v1 = F.from_json(column, STATE_V2), F.from_json(column, STATE_V1)
    one = F.array(F.struct(v1["active_quarter"].alias("name"), v1["companies"].alias("companies")))
    quarters = raw.select(F.explode(F.coalesce(v2["quarters"], one)).alias("q")).where("coalesce(q.name, '') <> ''")
    rows = quarters.select(F.col("q.name").alias("quarter"), F.explode("q.companies").alias("c"))
    return rows.select("quarter", F.col("c.symbol").alias("symbol"), F.col("c.transcript.eligible_since").alias("transcript_since"), F.col("c.presentation.eligible_since").alias("presentation_since"))


def carried_eligibility(state: DataFrame, ended: DataFrame, scanned: DataFrame) -> DataFrame:
    """Quarters that have ended and are in the state keep their dates; the others come from a scan."""
    kept = state.join(ended.select("quarter"), "quarter", "left_semi")
    return kept.unionByName(scanned.join(kept.select("quarter").distinct(), "quarter", "left_anti"))
