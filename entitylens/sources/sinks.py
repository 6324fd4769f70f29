"""Writers (SNK1, SNK2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, a file for each partition."""
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """One indented JSON array in one text file, for results that people read; one task writes it, row by row."""
    options = {"pretty": "true", "ignoreNullFields": "false"}
    rows = df.select(F.to_json(F.struct(*df.columns), options).alias("value")).coalesce(1)
    numbered = rows.select(F.when(F.monotonically_increasing_id() == 0, F.lit("")).otherwise(F.lit(",\n")).alias("gap"), "value")
    begin, end = df.sparkSession.range(1).select(F.lit("[").alias("value")), df.sparkSession.range(1).select(F.lit("]").alias("value"))
    begin.union(numbered.select(F.concat("gap", "value").alias("value"))).union(end).coalesce(1).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_pages(pages: DataFrame, path: str, buckets: int = 16) -> None:
    """(slug, html) as Parquet, a folder for each bucket of slugs; rows are whole pages."""
    pages.withColumn("bucket", F.pmod(F.xxhash64("slug"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)
