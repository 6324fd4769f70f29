"""Operator 2: exact top-k inner products over norm-sorted blocks.

Candidates stand in blocks by descending length, and are taken in waves: the block of the
longest vectors, then the next four, sixteen and so on. After each wave a query's threshold
is its k-th best score so far. By Cauchy-Schwarz a query block meets only those blocks of a
wave whose longest vector, times the length of one of its queries, reaches that query's threshold.
Within a block, both sides are rotated by the candidates' right singular vectors, so a sum
over the first coordinates has most of a product; that sum plus the product of the residual
lengths is an upper bound, and only queries and candidates with a pair whose bound reaches the
threshold get exact integer scores. Bounds carry a slack for rounding, so no result is lost.

Vectors that are null, or hold null or non-finite components, take no part. Queries see only
candidates of their own number of components. Of equal vectors, those of the k + 1 smallest
vec_ids are candidates, k rows of each at most: others cannot be in a result. Ties go to the
smaller vec_id; rows of equal vec_id are candidates each, but never of a query with that id;
rows of a query that are equal in id and vector count once, and vectors of one query id share
its k places, whatever their numbers of components. An empty table gives no rows. Other
columns are left out.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions, written

#: Vectors of a block, on either side.
BLOCK = 2048
#: Each wave has this many times as many blocks of candidates as the one before.
GROWTH = 4
#: Coordinates of the partial sums, as a share of all.
HEAD = 0.375


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, dim, norm2): components floor(256 * x) as longs."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    x = x.where(F.col("vec_id").isNotNull() & (F.size("e") > 0))
    x = x.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    x = x.withColumn("v", F.transform("e", lambda c: F.floor(c * 256))).drop("e")
    return x.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("norm2"))


def narrowed(vectors: DataFrame) -> DataFrame:
    """The vectors with components of the least width that holds all of them."""
    ends = vectors.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    for bits, name in ((8, "tinyint"), (16, "smallint"), (32, "int")):
        if ends.low is None or -(2 ** (bits - 1)) <= ends.low and ends.high < 2 ** (bits - 1):
            return vectors.withColumn("v", F.col("v").cast(f"array<{name}>"))
    return vectors


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("v")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the sum of dim x dim products; strongest first."""

    def gram(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], ["cell", "x"])

    cells = vectors.select("v").mapInArrow(gram, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(dim * dim)
    for r in cells:
        total[r.cell] = r.x
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1])


def _blocks(vectors: DataFrame, size: int, parts: int) -> DataFrame:
    """(at, longest, n, ids, data): blocks of vectors by descending length, `at` in that order within a partition."""

    def over(batches):
        from pyspark import TaskContext

        part, number, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def made(ids, m):
            norm = float(_lengths(m[:1])[0])
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([norm]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["at", "longest", "n", "ids", "data"])

        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy())
            rows.append(_matrix(batch))
            while sum(map(len, ids)) >= size:
                i, m = np.concatenate(ids), np.concatenate(rows)
                yield made(i[:size], m[:size])
                ids, rows, number = [i[size:]], [m[size:]], number + 1
        if sum(map(len, ids)):
            yield made(np.concatenate(ids), np.concatenate(rows))

    dealt = vectors.select("vec_id", "v", "norm2").repartitionByRange(parts, F.desc("norm2")).sortWithinPartitions(F.desc("norm2"), "vec_id")
    return dealt.select("vec_id", "v").mapInArrow(over, "at long, longest double, n int, ids binary, data binary")


def _unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, f"i{len(data) // (len(i) * dim)}").reshape(len(i), dim).astype(np.int64)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; by floating point where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if most < 2**52 else q @ c.T


def block_best(qid, q, cid, c, threshold, turn, k):
    """(query row, vec_id, score) of each query's best k in the block that reach its threshold, and the share of pairs that were scored."""
    h = max(1, int(HEAD * q.shape[1]))
    qr, cr = q @ turn, c @ turn
    q_rest, c_rest = (np.sqrt((x[:, h:] ** 2).sum(axis=1)) for x in (qr, cr))
    bound = qr[:, :h] @ cr[:, :h].T + q_rest[:, None] * c_rest[None, :]
    bound += 1e-6 + 1e-9 * _lengths(q)[:, None] * _lengths(c)[None, :]
    open_pairs = (bound >= threshold[:, None]) & (qid[:, None] != cid[None, :])
    rows, columns = (np.flatnonzero(open_pairs.any(axis=x)) for x in (1, 0))
    out = ([], [], [])
    if len(columns):
        scores = exact_scores(q[rows], c[columns])
        for i, row in enumerate(rows):
            use = np.flatnonzero(open_pairs[row, columns] & (scores[i] >= threshold[row]))
            if len(use) > 4 * k:  # only those that reach the k-th best
                use = use[scores[i, use] >= np.partition(scores[i, use], -k)[-k]]
            best = use[np.lexsort((cid[columns[use]], -scores[i, use]))[:k]]
            out[0].extend([row] * len(best))
            out[1].extend(cid[columns[best]].tolist())
            out[2].extend(scores[i, best].tolist())
    return out, open_pairs.mean() if open_pairs.size else 0.0


def top_inner_products(rows: DataFrame, k: int = 5, query_step: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row whose vec_id is divisible by `query_step`, against all other rows."""
    vectors = usable_vectors(rows)
    vectors = narrowed(written(vectors, "vectors"))
    # Repeated rows are counted first, so that a vector that very many rows have comes to its window once for each id.
    counted = vectors.groupBy("v", "vec_id").agg(F.first("dim").alias("dim"), F.first("norm2").alias("norm2"), F.count("*").alias("n"))
    copies = Window.partitionBy("v").orderBy("vec_id")
    candidates = counted.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    candidates = candidates.withColumn("n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))).drop("n")
    queries = vectors.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id", "v"])
    parts = [_of_dim(candidates.where(F.col("dim") == d), queries.where(F.col("dim") == d), d, k) for d in sorted(r.dim for r in queries.select("dim").distinct().collect())]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _best(functools.reduce(DataFrame.union, parts), k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_dim(candidates: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query id's best k among candidates of `dim` components."""
    spark = candidates.sparkSession
    n = partitions(spark)
    turn = rotation(candidates, dim)
    blocks = written(_blocks(candidates, BLOCK, n), "blocks")
    # One row for each range of lengths, of which there are as many as partitions; ranges, and blocks within them, are numbered by descending length.
    part = F.shiftright("at", 32)
    ranges = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max("longest").alias("longest")).orderBy("part").collect()
    before = np.cumsum([0, *(r.n for r in ranges)]).tolist()
    starts = spark.createDataFrame([(r.part, base) for r, base in zip(ranges, before, strict=False)], "part long, base long")
    placed = blocks.join(starts, part == F.col("part")).withColumn("place", F.col("base") + F.col("at").bitwiseAND(2**32 - 1))
    asked = written(_blocks(queries, BLOCK, max(1, n // 4)).select(F.col("at").alias("q_at"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "asked")

    def unfold(batch):
        for at, ids, data in zip(*(batch.column(x).to_pylist() for x in ("q_at", "q_ids", "q_data")), strict=True):
            qid, q = _unpacked(ids, data, dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qid), at)), pa.array(np.arange(len(qid), dtype=np.int32)), pa.array(qid), pa.array(_lengths(q))], ["q_at", "row", "query_id", "length"])

    def score(batch):
        for i in range(batch.num_rows):
            one = {x: batch.column(x)[i].as_py() for x in ("q_ids", "q_data", "thresholds", "ids", "data")}
            (qid, q), (cid, c) = _unpacked(one["q_ids"], one["q_data"], dim), _unpacked(one["ids"], one["data"], dim)
            (row, vec, found), _ = block_best(qid, q, cid, c, np.array(one["thresholds"]), turn, k)
            yield pa.RecordBatch.from_arrays([pa.array(qid[row] if row else [], pa.int64()), pa.array(vec, pa.int64()), pa.array(found, pa.int64())], ["query_id", "vec_id", "score"])

    members = written(arrow_map(asked, unfold, "q_at long, row int, query_id long, length double"), "members")
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    none = F.lit(float("-inf"))
    low, high = 0, 1
    while low < before[-1]:
        reached = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("t")).where(F.col("n") == k).drop("n")
        t = members.join(reached, "query_id", "left").withColumn("t", F.coalesce("t", none))
        # A block matters to a query if its longest vector, times the query's length, reaches the threshold.
        least = F.when(F.col("t") <= 0, none).when(F.col("length") > 0, F.col("t") / F.col("length"))
        state = t.groupBy("q_at").agg(F.array_sort(F.collect_list(F.struct("row", "t"))).alias("thresholds"), F.min(least).alias("least"))
        state = written(state.withColumn("thresholds", F.col("thresholds")["t"]), "state")
        here = placed.where(F.col("place").between(low, high - 1))
        longest = max(r.longest for r, end in zip(ranges, before[1:], strict=True) if end > low)
        wanted = state.where(F.col("least") <= longest * (1 + 1e-9)).select("q_at", "least", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(min(high, before[-1]) - 1).cast("long"))).alias("place"))
        wanted = wanted.join(here.select("place", "longest"), "place").where(F.col("longest") * (1 + 1e-9) >= F.col("least")).select("q_at", "place")
        pairs = wanted.join(asked, "q_at").join(state.drop("least"), "q_at").join(here.select("place", "ids", "data"), "place")
        found = arrow_map(pairs.repartition(n, "q_at", "place"), score, "query_id long, vec_id long, score long")
        best = written(_best(best.union(found), k).drop("rank"), "best")
        low, high = high, high + (high - low) * GROWTH
    return best


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM (SELECT DISTINCT vec_id, v FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
