"""Keep-first, keep-last and argmax patterns with explicit order (AGG, DED, SRT, SET): small helpers that other operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

def keep_best(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in a total order; never an arbitrary winner. Spark limits each partition before the shuffle."""
    made = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n)
    return made.withColumnRenamed("_rank", rank) if rank else made.drop("_rank")


def dealt(df: DataFrame, *by: str, times: int = 4) -> DataFrame:
    """Rows dealt out by a key, to so many tasks for every core. By number, as a few small files would else be read, and few bytes be exchanged, by few tasks, however slow the work on each row."""
    spark = df.sparkSession
    return df.repartition(max(times * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def top_n(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n of all rows, numbered: a distributed top-k, then a rank over n rows."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def globally_ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """All rows numbered from 1 in a total order: each task sorts a range, and the ranges' counts (a row for each partition) tell where it begins."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_n", within).join(F.broadcast(base), "_part").withColumn(rank, F.col("_base") + F.col("_n")).drop("_part", "_base", "_n")


def longest_name(df: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """One row for each key: the longest name, the earliest of equals (DED4)."""
    return df.groupBy(by).agg(F.max_by(F.struct(*[c for c in df.columns if c != by]), F.struct(F.length(name), -F.col(order))).alias("r")).select(by, "r.*")


def repeated_keys(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def remap(df: DataFrame, variants: DataFrame, column: str = "company_id") -> DataFrame:
    """Variant ids become canonical ones; unknown ids pass (JOIN2). variants: (id, canonical_id)."""
    v = variants.select(F.col("id").alias("_id"), F.col("canonical_id").alias("_to"))
    return df.join(v, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


def without(df: DataFrame, gone: DataFrame, column: str = "company_id", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go) by an anti and a semi join (JOIN3)."""
    keys = gone.select(F.col(key).alias("_gone"))
    on = F.col(column) == F.col("_gone")
    return df.join(keys, on, "left_anti"), df.join(keys, on, "left_semi")


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def upserted_mentions(mentions: DataFrame) -> DataFrame:
    """One mention for each company and edition (DED6): a heading outranks a list; the sector is that of the last heading with one, else the first known.

    mentions: company_id, edition_id, mention_type, sector, ord.
    """
    heading, known = F.col("mention_type") == "heading", F.col("sector").isNotNull()
    last = F.max_by("sector", F.when(heading & known, F.struct("ord", "sector")))
    first = F.min_by("sector", F.when(known, F.struct("ord", "sector")))
    g = mentions.groupBy("company_id", "edition_id").agg(F.bool_or(heading).alias("_h"), last.alias("_last"), first.alias("_first"), F.count("*").alias("n"))
    return g.select("company_id", "edition_id", F.when(F.col("_h"), "heading").otherwise("list").alias("mention_type"), F.coalesce("_last", "_first").alias("sector"), "n")


def covered_pairs(events: list[DataFrame], columns: tuple[str, ...] = ("company_id", "edition_id")) -> DataFrame:
    """Set union of the pairs of several tables (SET1)."""
    made = events[0].select(*columns)
    for e in events[1:]:
        made = made.union(e.select(*columns))
    return made.distinct()
