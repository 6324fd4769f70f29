"""What the operators share: the shared folder, written tables, and sums over many buckets."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.folders import shared_folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; the driver's JVM deletes it when it ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(buckets)).cast("int")


def running_sums(df: DataFrame, by: list[str], at: str, order: list[str], value: Column, name: str, span: int | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same `by` that come before, ordered by `at` (a bucket) and `order`.

    Only rows of one bucket meet in a task; a hot `by` is spread over its buckets, whose
    sums make a table of one row for each. With `span`, buckets of the same `at / span` are
    summed up apart, so that no task sorts all buckets of a `by`. `value` is taken as long.
    """
    v = df.withColumn("_value", value.cast("long"))
    totals = v.groupBy(*by, at).agg(F.sum("_value").alias("_total"))

    def before(keys: list[str], ordered: str, summed: str) -> Column:
        return F.coalesce(F.sum(summed).over(Window.partitionBy(*keys).orderBy(ordered).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if span is None:
        totals = totals.select(*by, at, before(by, at, "_total").alias("_base"))
    else:
        totals = totals.withColumn("_span", F.floor(F.col(at) / span))
        spans = totals.groupBy(*by, "_span").agg(F.sum("_total").alias("_total"))
        spans = spans.select(*by, "_span", before(by, "_span", "_total").alias("_start"))
        totals = totals.join(spans, [*by, "_span"]).select(*by, at, (F.col("_start") + before([*by, "_span"], at, "_total")).alias("_base"))
    within = Window.partitionBy(*by, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = v.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return out.join(totals, [*by, at]).withColumn(name, F.col("_base") + F.col("_within")).drop("_value", "_within", "_base")


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(batch)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made

    return df.mapInArrow(over, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (a, b), for nodes that have an edge.

    Alternates large-star and small-star steps, each a minimum by key joined back, until
    nothing changes. Every round is a written table; nothing goes to the driver but counts.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    seen = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
