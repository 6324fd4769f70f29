"""Operator 4: token ids as Parquet list columns.

Documents are dealt out by ranges of doc_id and encoded in that order. Each file holds the
ids as a list column with dictionary pages, doc_id and offsets delta-encoded, in row groups
and pages of bounded size; the Parquet writer adds column and offset indexes by page. So a
reader can take metadata columns alone, or the pages of a few documents.

Null texts count as empty (they have the end id only); documents of equal doc_id stand next
to each other in the order of their texts, those without doc_id before all others; an empty
table gives files without rows. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, new_path, partitions
from .encoding import encoder

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def range_bounds(rows: DataFrame, column: str, n: int) -> list[int]:
    """Some n - 1 ascending values that cut the column into ranges of about equal counts; the scan reads this column only."""
    if n < 2:
        return []
    found = rows.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 100 * n).alias("x")).first().x
    return sorted(set(found or []))


def range_number(column: str, bounds: list[int]) -> Column:
    """How many bounds are not above the value: found among every r-th bound first, then among r, with r the root of their number."""
    if not bounds:
        return F.lit(0)
    r = math.isqrt(len(bounds)) + 1
    chunks = [bounds[at : at + r] for at in range(0, len(bounds), r)]

    def reached(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col(column)))

    chunk = reached(F.array(*[F.lit(c[0]) for c in chunks]))
    inside = reached(F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), F.greatest(chunk, F.lit(1))))
    return F.when(chunk > 0, (chunk - 1) * r + inside).otherwise(F.lit(0)).cast("int")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, row_group_bytes: int = 16 << 20, page_rows: int = 500, ids_encoding: str = "dictionary") -> None:
    """Encodes `docs` (doc_id, text) and writes them to `path` in ascending doc_id order, file by file.

    ids_encoding: "dictionary", or "delta" for DELTA_BINARY_PACKED pages.
    """
    from pyspark import TaskContext

    def encode(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                flat, offsets = encoder(vocabulary).encode_column(some.column("text"), end_id)
                sizes, ends = np.diff(offsets), offsets[1:]
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), ids], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                start += int(ends[-1])

    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionById(n, range_number("doc_id", range_bounds(rows, "doc_id", n))).sortWithinPartitions("doc_id", "text")
    writer = dealt.mapInArrow(encode, FILE_SCHEMA).write
    for k, v in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#start_in_part": "false",
        "parquet.enable.dictionary#ids.list.element": str(ids_encoding == "dictionary").lower(),
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": 1,
    }.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`, the ids of all documents before; a query that leaves `ids` out reads no ids."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row for each file; there are as many files as shuffle partitions were set.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("start_in_part")).drop("_base")


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        at = ids.offsets.to_numpy() * 4
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(rows.select("doc_id", "start", "n_tokens", "ids"), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_digests(read_token_files(spark, path))
