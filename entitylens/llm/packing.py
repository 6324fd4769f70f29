"""Operator 8: bounded-space online best-fit packing.

A packer keeps a fixed number of open sequences; a bitset has a bit for each amount of free
space that some open sequence has. A piece goes where the least space is left after it (the
lowest set bit at or above its length). If none has room, a new sequence is opened, and if
that makes too many, the fullest is closed. Packers run side by side over parts of the
pieces; what each leaves open at its end is packed once more, fullest first and with more places, by
the same rule, in a table whose size is the number of packers times that of open sequences.

Null texts count as empty; every text has its end id at least. Equal doc_ids, and rows
without doc_id, are packed as separate documents of their own. An empty table gives no rows.
Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, partitions, written
from .encoding import encoder, slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(batch: pa.RecordBatch, vocabulary: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch of (doc_id, text); texts are encoded some MB at a time, however many rows that is."""
    for some in slices(batch):
        out = ([], [], [], [], [])
        flat, offsets = encoder(vocabulary).encode_column(some.column("text"), end_id)
        view, at4 = memoryview(flat).cast("B"), (4 * offsets).tolist()
        for doc, begin, end in zip(some.column("doc_id").to_pylist(), at4[:-1], at4[1:], strict=True):
            for n, k in enumerate(range(0, end - begin, 4 * size)):
                part = view[begin + k : min(begin + k + 4 * size, end)]
                for column, x in zip(out, (doc, n, k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest slice took


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Encodes whole texts and cuts those longer than `size` ids into pieces; a digest stands for the ids."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda batch: cut(batch, vocabulary, end_id, size), PIECE_SCHEMA)


class BestFit:
    """Open sequences by free space. `put` gives (sequence, offset); `closed` has those that were closed."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.spaces, self.by_space, self.used = 0, defaultdict(list), {}
        self.made, self.closed = 0, set()

    def _take(self, space: int) -> int:
        sequence = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces &= ~(1 << space)
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            sequence, space = self.made, self.size
            self.made += 1
            self.used[sequence] = 0
        offset = self.used[sequence]
        self.used[sequence] += length
        if length == space:
            self.closed.add(sequence)
            del self.used[sequence]
        else:
            self.spaces |= 1 << (space - length)
            self.by_space[space - length].append(sequence)
            if len(self.used) > self.most_open:
                fullest = self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.closed.add(fullest)
                del self.used[fullest]
        return sequence, offset


def pack(found: DataFrame, size: int, most_open: int = 256) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `size`."""
    n = partitions(found.sparkSession)

    def first(batches):
        from pyspark import TaskContext

        packer, part = BestFit(size, most_open), TaskContext.get().partitionId()
        for batch in batches:
            put = [packer.put(x) for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([(part << 40) + s for s, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())], [*batch.schema.names, "first_id", "first_offset"])

    # The whole row is the key, so that rows of one doc_id, or of none, are spread, and a task that runs again packs alike.
    own = ("doc_id", "piece", "length", "ids_crc32")
    dealt = found.repartition(n, F.xxhash64(*own)).sortWithinPartitions(F.xxhash64(*own, F.lit("order")), *own)
    schema = f"{PIECE_SCHEMA}, first_id long, first_offset long"
    once = written(dealt.mapInArrow(first, schema), "packed")
    fill = once.groupBy("first_id").agg(F.sum("length").alias("filled"))
    # Sequences less than full, at most `most_open` of the last ones of each packer and those closed early: the latter are nearly full.
    loose = fill.where(F.col("filled") <= size * 15 // 16)

    def again(batches):
        from pyspark import TaskContext

        packer, part = BestFit(size, most_open * 16), TaskContext.get().partitionId()
        for batch in batches:
            put = [packer.put(x) for x in batch.column("filled").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("first_id"), pa.array([-1 - (part << 40) - s for s, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())], ["first_id", "next_id", "base"])

    # Some thousand loose sequences make a group; a few groups are as good as one.
    groups = max(1, n * most_open // 16384)
    moved = loose.repartition(groups, F.xxhash64("first_id")).sortWithinPartitions(F.desc("filled"), "first_id").mapInArrow(again, "first_id long, next_id long, base long")
    out = once.join(moved, "first_id", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("next_id", "first_id").alias("sequence_id"), (F.col("first_offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 4096, most_open: int = 256) -> DataFrame:
    return pack(pieces(docs, vocabulary, end_id, size), size, most_open)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
