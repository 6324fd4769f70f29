"""Operator 7: removal of sentences covered by repeated spans of sentences.

A sentence ends behind . ! or ? before white space, at a line end, and before a capitalised
word that follows a word without such an end (so that a passage put into the middle of a
sentence begins one). From each sentence runs the shortest span of at least `MIN_SENTENCES`
sentences and `MIN_WORDS` words, and to each sentence the shortest such span that ends with
it; a sentence of `LONG_SENTENCE` words or more is a span by itself too. Words are compared as they are, white space is not. All spans' hashes meet by hash
range; a span counts as first in the smallest doc_id, and there in the first place. Every
sentence that any other occurrence covers is removed, judged on the input.

Null and empty texts have no sentences and stay as they are. Very long texts are taken
whole. Rows of equal doc_id are documents in the order of a hash of their texts; rows equal
in both are cut alike, as one document. A null doc_id counts as the smallest. Other columns
are kept by `cut_documents` and left out by the query.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions

MIN_SENTENCES, MIN_WORDS, LONG_SENTENCE = 2, 14, 25
_CUT = re.compile(r"(?<=[.!?])\s+|\n\s*|(?<=[^\s.!?]) (?=[^\W\d_a-zà-öø-ÿ][^\W\d_]*[a-zà-öø-ÿ])")


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each sentence; together they are the whole text, white space goes with the sentence before."""
    ends = [m.end() for m in _CUT.finditer(text)]
    begins = [0, *ends]
    return [(a, b) for a, b in zip(begins, [*ends, len(text)], strict=True) if b > a]


def spans(counts: list[int], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> list[tuple[int, int]]:
    """The shortest sufficient span from each sentence and to each sentence, and each long sentence, as (first, behind last), each once."""
    n, total = len(counts), [0]
    for c in counts:
        total.append(total[-1] + c)
    out, behind = [], 0
    for first in range(n):
        behind = max(behind, first + min_sentences)
        while behind <= n and total[behind] - total[first] < min_words:
            behind += 1
        if behind > n:
            break
        out.append((first, behind))
    forward, first = set(out), n
    for behind in range(n, 0, -1):
        first = min(first, behind - min_sentences)
        while first >= 0 and total[behind] - total[first] < min_words:
            first -= 1
        if first < 0:
            break
        if (first, behind) not in forward:
            out.append((first, behind))
    if min_sentences > 1:
        out.extend((i, i + 1) for i, c in enumerate(counts) if c >= long_sentence)
    return out


def _again(h, ids, keys, first) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash and place, and where in it an occurrence stands that is not the first of its hash."""
    order = np.lexsort((first, keys, ids, h))
    h, ids, keys, first = h[order], ids[order], keys[order], first[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    # Rows equal in id and text are one document.
    return order, (ids != ids[lead]) | (keys != keys[lead]) | (first != first[lead])


def _by_block(columns: list[np.ndarray], blocks: int):
    """(block, columns) of spans (ids, keys, first, behind), by the block of their document."""
    block = columns[1] % blocks
    order = np.argsort(block, kind="stable")
    columns = [c[order] for c in columns]
    return [(b, tuple(c[x:y] for c in columns)) for b, x, y in _slices(block[order])]


def _span_hashes(ranges: int, blocks: int, min_sentences: int, min_words: int):
    """By batch: of each hash the first occurrence, by hash range; what repeats within the batch is covered for certain and only passes on.

    So a span that stands in very many documents comes to its range once from each batch.
    """

    def over(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                some = batch.slice(at, 4000)
                hashes, rows, first, behind = [], [], [], []
                for r, text in enumerate(some.column("text")):
                    text = text.as_py()
                    if not text:
                        continue
                    parts = [text[a:b].split() for a, b in sentences(text)]
                    joined = [" ".join(x).encode("utf-8", "surrogatepass") for x in parts]
                    for a, b in spans(list(map(len, parts)), min_sentences, min_words):
                        hashes.append(xxhash.xxh64_intdigest(b" ".join(joined[a:b])))
                        rows.append(r)
                        first.append(a)
                        behind.append(b)
                if not hashes:
                    continue
                h, rows, first, behind = np.array(hashes, np.uint64), np.array(rows), np.array(first, np.int32), np.array(behind, np.int32)
                ids, keys = some.column("doc_id").fill_null(-(2**63)).to_numpy()[rows], some.column("key").to_numpy()[rows]
                order, again = _again(h, ids, keys, first)
                covered = order[again]
                made = [(b % ranges, (b, x)) for b, x in _by_block([x[covered] for x in (ids, keys, first, behind)], blocks)]
                order = order[~again]
                h, ids, keys, first, behind = (x[order] for x in (h, ids, keys, first, behind))
                number = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                made += [(p, tuple(x[a:b] for x in (h, ids, keys, first, behind))) for p, a, b in _slices(number)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([pickle.dumps(x, 5) for _, x in made], pa.binary())], ["range", "spans"])

    return over


def _repeated(blocks: int):
    """Of each hash range, one at a time: the occurrences that are not the first, by the block of their document. Rows come sorted by range."""

    def settle(held, found):
        h, ids, keys, first, behind = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        h, ids, keys, first, behind = (x[twice] for x in (h, ids, keys, first, behind))
        order, again = _again(h, ids, keys, first)
        for b, x in _by_block([c[order[again]] for c in (ids, keys, first, behind)], blocks):
            found[b].append(x)

    def over(batches):
        now, held, found = None, [], defaultdict(list)
        for batch in batches:
            for p, x in zip(batch.column("range").to_pylist(), batch.column("spans"), strict=True):
                if p != now and held:
                    settle(held, found)
                    held = []
                now, x = p, pickle.loads(x.as_buffer())
                if len(x) == 2:
                    found[x[0]].append(x[1])
                else:
                    held.append(x)
        if held:
            settle(held, found)
        numbers = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([pickle.dumps(tuple(np.concatenate(x) for x in zip(*found[b], strict=True)), 5) for b in numbers], pa.binary())], ["_block", "_spans"])

    return over


def _slices(values: np.ndarray):
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = [0, *cut.tolist(), len(values)] if len(values) else [0]
    return [(int(values[a]), a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    gone = defaultdict(set)
    for blob in right.column("_spans").to_pylist():
        for d, k, a, b in zip(*(x.tolist() for x in pickle.loads(blob)), strict=True):
            gone[d, k].update(range(a, b))
    texts, n, removed = [], [], []
    for d, k, text in zip(*(left.column(x).to_pylist() for x in ("_id", "_key", "_text")), strict=True):
        parts = sentences(text or "")
        out = gone.get((-(2**63) if d is None else d, k), ())
        texts.append("".join(text[a:b] for i, (a, b) in enumerate(parts) if i not in out) if out else text)
        n.append(len(parts))
        removed.append(len(out))
    left = left.append_column("_new", pa.array(texts, pa.string())).append_column("_n", pa.array(n, pa.int64())).append_column("_removed", pa.array(removed, pa.int64()))
    return left.select(["row", "_new", "_n", "_removed"])


def cut_documents(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """row (all columns of `docs`), _new (the text that is left), _n and _removed (sentences in all, and removed)."""
    n = partitions(docs.sparkSession)
    blocks = ranges = 8 * n
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31 - 1)).cast("int")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id"), key.alias("_key"), F.col("text").alias("_text"), F.pmod(key, F.lit(blocks)).cast("int").alias("_block"))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text").mapInArrow(_span_hashes(ranges, blocks, min_sentences, min_words), "range int, spans binary")
    repeated = hashed.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_repeated(blocks), "_block int, _spans binary")
    schema = T.StructType([keyed.schema["row"], T.StructField("_new", T.StringType()), T.StructField("_n", T.LongType()), T.StructField("_removed", T.LongType())])
    return keyed.groupBy("_block").cogroup(repeated.groupBy("_block")).applyInArrow(_cut, schema)


def remove_repeated_sentences(docs: DataFrame, **options) -> DataFrame:
    """`docs` with texts cut and n_chars, where there is one, counted anew; documents of which no word is left go."""
    made = cut_documents(docs, **options).where("_removed = 0 OR _new RLIKE '[^ \\\\t-\\\\r]'")
    column = {x: F.col("row")[x] for x in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        column["n_chars"] = F.when(F.col("_removed") > 0, F.length("_new")).otherwise(column["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return made.select(*[x.alias(name) for name, x in column.items()])


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left, of every document."""
    made = cut_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("row.doc_id", F.col("_n").alias("n_sentences"), F.col("_removed").alias("n_removed"), F.col("_new").alias("text"))
