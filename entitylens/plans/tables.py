"""The driver's tables seen as this engine's relations: parts are companies, orders editions, line items quotes, pages posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rules import NameRules, SiteRules

HOSTS = ["market.example"]
SITE = SiteRules(title_include="", title_exclude=[], generic_titles=[], own_titles=[])
NAMES = NameRules(exact_keys=["global"], patterns=[r"^we(?:'ve|\s+have)\b", r"\bcomments?\s+on\b"])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def companies(spark: SparkSession, d: str) -> DataFrame:
    """ord, id, name, url: a listing URL for every part whose key divides by 3."""
    p = table(spark, d, "part")
    listed = F.concat(F.lit("https://market.example/markets/stocks/NSE/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"))
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, listed).alias("url"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("company_id"), F.col("l_orderkey").alias("edition_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("quote_id"), F.col("l_returnflag").alias("sector"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("company_id"), F.col("l_orderkey").alias("edition_id"), F.when(F.col("l_linestatus") == "F", "heading").otherwise("list").alias("mention_type"), F.col("l_linenumber").alias("ord"))


def editions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"))
