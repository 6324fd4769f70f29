"""Operator 6: removal of byte strings that also start earlier, by a sorted exchange of suffixes.

A byte goes if a string of `WINDOW` bytes that covers it also starts earlier. Of all
positions only anchors are sorted: in each window of WINDOW bytes the K-byte string with the
least hash is its anchor, so equal windows have equal anchors at equal offsets, and one
position in some 35 is an anchor.

1. Anchors' hashes are counted by hash range; each block of documents learns which of its
   anchors have an equal elsewhere. The others cannot lie in a repeated window.
2. Each block sorts the suffixes at those anchors (WINDOW bytes right, and what lies left),
   settles those equal in full, and sends the rest as front-coded sorted runs, dealt by the
   anchor's hash: only suffixes at equal anchors can be equal, so there is no order over all
   ranges, but one sorted order within each.
3. Runs of a hash range are merged by a loser tree that keeps each loser's common prefix
   with the last winner and so never compares a known prefix again. The merged order has the
   common prefixes of neighbours; windows at the same offset are equal where these and the
   bytes to the left agree. All but the earliest of equal windows are covered.
4. Covered spans go back to their block, where texts are cut.

Null texts count as empty; matches never cross documents; rows of equal doc_id are documents
of their own, in the order of their texts; a null doc_id counts as the smallest. Very long
texts are read in overlapping segments. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, partitions

WINDOW, K = 100, 32
STARTS = WINDOW - K + 1  # places that an anchor can have in a window
LEFT = STARTS - 1
_SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_MANY = 1 << 30
#: Bytes of the table, as its files or Spark's statistics have them, that a block of documents has about, between one and eight blocks for each partition.
BLOCK_BYTES = 8 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


_POW = _powers(_SEGMENT + 2 * WINDOW, int(_BASE))
_INV = _powers(_SEGMENT + 2 * WINDOW, pow(int(_BASE), -1, 1 << 64))


def anchors(raw: np.ndarray, offsets: np.ndarray):
    """(position, first window, last window, hash) of each anchor of texts that lie end to end in `raw`."""
    n = len(raw) - WINDOW + 1
    lengths = np.diff(offsets)
    usable = np.maximum(0, lengths - WINDOW + 1)
    valid = np.repeat(np.tile([True, False], len(lengths)), np.stack([usable, lengths - usable], axis=1).ravel())
    out = []
    for s in range(0, max(0, n), _SEGMENT):
        e = min(s + _SEGMENT, n)
        at = np.flatnonzero(valid[s:e])
        if not len(at):
            continue
        count = e - s + LEFT
        x = (raw[s : s + count + K - 1].astype(np.uint64) + np.uint64(1)) * _POW[: count + K - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        h = (total[K:] - total[:-K]) * _INV[:count]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        least = (h & _HIGH) | np.arange(count, dtype=np.uint64)
        size = 1
        while 2 * size <= STARTS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = STARTS - size
        least = np.minimum(least[: e - s], least[rest : rest + e - s]) if rest else least
        a = (least[at] & ~_HIGH).astype(np.int64)
        cut = np.flatnonzero((a[1:] != a[:-1]) | (np.diff(at) > 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        out.append((a[first] + s, at[first] + s, at[last] + s, h[a[first]]))
    if not out:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """By the low half: anchors are minima of the high half, which is therefore far from uniform."""
    return ((hashes & ~_HIGH) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes end to end, and where each begins."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _slices(values: np.ndarray):
    """(value, begin, end) of each run of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = [0, *cut.tolist(), len(values)] if len(values) else [0]
    return [(int(values[a]), a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _count_anchors(ranges: int):
    """By batch: rows (range, hashes, blocks), each hash and block once."""

    def over(batches):
        for batch in batches:
            for from_row in range(0, batch.num_rows, 4000):
                some = batch.slice(from_row, 4000)
                raw, offsets = _bytes_of(some.column("text"))
                _, low, _, h = anchors(raw, offsets)
                block = some.column("block").to_numpy()[np.searchsorted(offsets, low, "right") - 1]
                order = np.lexsort((block, h))
                h, block = h[order], block[order].astype(np.int64)
                again = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
                many = again | np.concatenate([again[1:], [False]]) if len(h) else again
                keep = np.concatenate([[True], (h[1:] != h[:-1]) | (block[1:] != block[:-1])]) if len(h) else again
                h, code = h[keep], (block + _MANY * many)[keep].astype(np.int32)
                parts = _slices(_range_of(h, ranges))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in parts], pa.int32()), pa.array([h[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([code[a:b].tobytes() for _, a, b in parts], pa.binary())], ["range", "hashes", "blocks"])

    return over


def _repeated_anchors(batches):
    """For each block, its hashes that occur twice or more in this partition's ranges. Rows come sorted by range; one range is held at a time."""
    now, held, found = None, [], defaultdict(list)

    def settle():
        h, code = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, code = h[order], code[order]
        same = h[1:] == h[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (code >= _MANY)
        h, block = h[twice], code[twice] & (_MANY - 1)
        order = np.argsort(block, kind="stable")
        h, block = h[order], block[order]
        for b, x, y in _slices(block):
            found[b].append(np.unique(h[x:y]))

    for batch in batches:
        for at, h, code in zip(*(batch.column(x).to_pylist() for x in ("range", "hashes", "blocks")), strict=True):
            if at != now and held:
                settle()
                held = []
            now = at
            held.append((np.frombuffer(h, np.uint64), np.frombuffer(code, np.int32)))
    if held:
        settle()
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.concatenate(x).tobytes() for x in found.values()], pa.binary())], ["block", "hashes"])


def _block_rows(table: pa.Table):
    """The block's documents in a fixed order: ids with null as the smallest, rank among equal ids, bytes, offsets."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = pc.fill_null(table.column("doc_id").combine_chunks(), -(2**63)).to_numpy(zero_copy_only=False)
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    rank = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return table, ids, rank, *_bytes_of(table.column("text"))


def _sorted_runs(ranges: int):
    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = ([], [])
        if left.num_rows and right.num_rows:
            block = left.column("block")[0].as_py()
            _, ids, rank, raw, offsets = _block_rows(left)
            known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in right.column("hashes").to_pylist()]))
            at, low, high, h = anchors(raw, offsets)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            keep = known[place] == h
            at, low, high, h = at[keep], low[keep], high[keep], h[keep]
            if len(at):
                runs, covered = _runs(raw, offsets, ids, rank, at, low, high, h, ranges, block)
                for number, run in runs:
                    rows[0].append(number)
                    rows[1].append(_packed(block, len(run[0]), run))
                if len(covered[0]):
                    rows[0].append(block % ranges)
                    rows[1].append(_packed(block, -len(covered[0]), [x.astype(np.int64) for x in covered]))
        return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], names=["range", "run"])

    return over


def _runs(raw, offsets, ids, rank, at, low, high, h, ranges, block):
    """Front-coded sorted runs by hash range, and spans (row, begin, end) settled within the block."""
    row = np.searchsorted(offsets, low, "right") - 1
    begin = offsets[row]
    padded = np.concatenate([np.zeros(LEFT, np.uint8), raw, np.zeros(WINDOW, np.uint8)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WINDOW)[at]
    to_left, to_right = seen[:, :LEFT][:, ::-1].copy(), seen[:, LEFT:].copy()
    # Bytes that no window of this anchor reaches, in its document or beyond, count as zero.
    to_left[np.arange(LEFT)[None, :] >= (at - low)[:, None]] = 0
    to_right[np.arange(WINDOW)[None, :] >= (high + WINDOW - at)[:, None]] = 0
    least, most = (at - high).astype(np.uint8), (at - low).astype(np.uint8)
    full = np.concatenate([to_right, to_left, least[:, None], most[:, None]], axis=1)
    keys = np.ascontiguousarray(full).view(f"V{full.shape[1]}").ravel()
    order = np.argsort(keys, kind="stable")  # rows were in order of document and place: the first of equals is the earliest
    same = np.concatenate([[False], (full[order[1:]] == full[order[:-1]]).all(axis=1)])
    gone, order = order[same], order[~same]
    covered = (row[gone], low[gone] - begin[gone], high[gone] - begin[gone] + WINDOW)
    number = _range_of(h[order], ranges)
    by_range = np.argsort(number, kind="stable")
    order, number = order[by_range], number[by_range]
    runs = []
    for p, a, b in _slices(number):
        own = order[a:b]
        right = to_right[own]
        differs = right[1:] != right[:-1]
        common = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), WINDOW)]).astype(np.uint8)
        rest = right[np.arange(WINDOW)[None, :] >= common[:, None]]
        places = (rank[row[own]], row[own], at[own] - begin[own])
        runs.append((p, [common, to_left[own], ids[row[own]], *[x.astype(np.int32) for x in places], least[own], most[own], rest]))
    return runs, covered


#: What a run has of each suffix besides its bytes to the right, which follow.
_RUN = {"common": "u1", "to_left": ("u1", (LEFT,)), "ids": "<i8", "rank": "<i4", "row": "<i4", "at": "<i4", "least": "u1", "most": "u1"}


def _packed(block: int, n: int, columns: list[np.ndarray]) -> bytes:
    """Block and number of entries (below zero: of covered spans), and the columns end to end."""
    return b"".join([np.array([block, n], "<i8").tobytes(), *[np.ascontiguousarray(x).tobytes() for x in columns]])


def _unpacked(raw: pa.Buffer) -> tuple[int, bool, list]:
    """(block, whether it is a run, its columns); of a run, the last one is the bytes to the right."""
    block, n = np.frombuffer(raw, "<i8", 2).tolist()
    if n < 0:
        return block, False, list(np.frombuffer(raw, "<i8", offset=16).reshape(3, -n))
    at, columns = 16, []
    for kind in _RUN.values():
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    return block, True, [*columns, memoryview(raw)[at:].tobytes()]


def decoded(common: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for c in common.tolist():
        last = last[:c] + rest[at : at + WINDOW - c]
        at += WINDOW - c
        out.append(last)
    return out


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of strings of equal length that agree up to `known`."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]):
    """Merges sorted runs (strings of equal length, common prefix of each with the one before).

    Yields (run, common prefix with the last one yielded). Each inner place of the tree keeps
    the run that lost there and the common prefix of its string with the last winner. A new
    string comes with its own common prefix with that winner, its predecessor; whichever has
    the longer one is smaller, and only if they are equal are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (k - len(runs))
    at, ends = [0] * k, [len(s) for s in strings]
    loser, shared = [0] * k, [0] * k

    def play(node: int) -> tuple[int, int]:
        """The winner below a node and its common prefix with nothing (0); -1 as prefix marks a run at its end."""
        if node >= k:
            return node - k, 0 if ends[node - k] else -1
        (a, pa_), (b, pb) = play(2 * node), play(2 * node + 1)
        if pb < 0 or pa_ < 0:
            win, lose, p = (a, b, pb) if pb < 0 else (b, a, pa_)
        else:
            x, y = strings[a][0], strings[b][0]
            p = common_prefix(x, y, 0)
            win, lose = (a, b) if x <= y else (b, a)
        loser[node], shared[node] = lose, p
        return win, 0 if ends[win] else -1

    winner, prefix = play(1) if k > 1 else (0, 0 if ends[0] else -1)
    while prefix >= 0:
        yield winner, prefix
        at[winner] += 1
        prefix = prefixes[winner][at[winner]] if at[winner] < ends[winner] else -1
        node = (winner + k) >> 1
        while node:
            p = shared[node]
            if p > prefix:  # the loser shares more with the last winner: it is smaller
                winner, loser[node] = loser[node], winner
                shared[node], prefix = prefix, p
            elif p == prefix and p >= 0:
                other = loser[node]
                x, y = strings[winner][at[winner]], strings[other][at[other]]
                if p < WINDOW:
                    p = common_prefix(x, y, p)
                if x > y:
                    winner, loser[node] = other, winner
                shared[node] = p
            node >>= 1


def covered_windows(common, to_left, ids, rank, at, least, most):
    """For suffixes in sorted order: the least and greatest offset of a window that is not the earliest of its equals; 255 and 0 if none."""
    n = len(common)
    low, high = np.full(n, 255, np.uint8), np.zeros(n, np.uint8)
    earlier = np.empty(n, np.int64)
    earlier[np.lexsort((at, rank, ids))] = np.arange(n)
    left_class = np.zeros(n, np.int64)
    for o in range(STARTS):
        if o:  # suffixes with equal bytes to the left, up to `o` of them
            left_class = np.unique(left_class * 256 + to_left[:, o - 1], return_inverse=True)[1]
        use = np.flatnonzero((least <= o) & (o <= most))
        if len(use) < 2:
            continue
        right_class = np.cumsum(common < WINDOW - o)
        key = right_class[use] * n + left_class[use]
        order = np.lexsort((earlier[use], key))
        key = key[order]
        dup = use[order[1:][key[1:] == key[:-1]]]
        low[dup] = np.minimum(low[dup], o)
        high[dup] = np.maximum(high[dup], o)
    return low, high


def _range_spans(runs: list[tuple], passed: dict) -> None:
    """Merges the runs (block, columns) of one hash range; adds spans (row, begin, end) of covered windows to `passed`, by block."""
    strings = [(decoded(r[0], r[-1]), r[0].tolist()) for _, r in runs]
    order, common, starts = [], [], np.cumsum([0, *[len(r[0]) for _, r in runs]]).tolist()
    for run, prefix in merge_runs(strings):
        order.append(starts[run])
        starts[run] += 1
        common.append(prefix)
    del strings
    to_left, ids, rank, row, at, least, most = (np.concatenate([r[i] for _, r in runs])[order] for i in range(1, 8))
    at = at.astype(np.int64)
    blocks = np.repeat([b for b, _ in runs], [len(r[0]) for _, r in runs])[order]
    low, high = covered_windows(np.array(common), to_left, ids, rank, at, least, most)
    hit = np.flatnonzero(low <= high)
    hit = hit[np.argsort(blocks[hit], kind="stable")]
    for block, a, b in _slices(blocks[hit]):
        own = hit[a:b]
        passed[block].append((row[own].astype(np.int64), at[own] - high[own], at[own] - low[own].astype(np.int64) + WINDOW))


def _merged_spans(batches):
    """Rows come sorted by hash range; only the runs of one range are held at a time."""
    now, runs, passed = None, [], defaultdict(list)
    for batch in batches:
        for p, run in zip(batch.column("range").to_pylist(), batch.column("run"), strict=True):
            if p != now and runs:
                _range_spans(runs, passed)
                runs = []
            now, (block, is_run, columns) = p, _unpacked(run.as_buffer())
            if is_run:
                runs.append((block, columns))
            else:
                passed[block].append(tuple(columns))
    if runs:
        _range_spans(runs, passed)
    blocks = list(passed)
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([pickle.dumps([tuple(np.concatenate(x).astype(np.int64) for x in zip(*passed[b], strict=True))], 5) for b in blocks], pa.binary())], ["block", "spans"])


def joined_spans(row: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Maximal runs of the union of spans, by row."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (begin + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    return row[first], begin[first], reach[last] - shift[last]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_texts(with_text: bool):
    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        table, _, _, raw, offsets = _block_rows(left)
        found = [x for blob in right.column("spans").to_pylist() for x in pickle.loads(blob)]
        spans = joined_spans(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else [np.zeros(0, np.int64)] * 3
        of = defaultdict(list)
        for r, a, b in zip(*(x.tolist() for x in spans), strict=True):
            of[r].append((a, b))
        view, columns = memoryview(np.ascontiguousarray(raw)), ([], [], [], [], [])
        for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            kept, last, removed = [], a, 0
            for x, y in of.get(r, ()):
                kept.append(view[last : a + x])
                last, removed = a + y, removed + y - x
            kept.append(view[last:b])
            whole = b"".join(kept)
            for column, value in zip(columns, (b - a, removed, len(of.get(r, ())), hashlib.sha256(whole).hexdigest(), whole if with_text else None), strict=True):
                column.append(value)
        arrays = [table.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays, names = [*arrays, pa.array(columns[4], pa.binary())], [*names, "kept"]
        return pa.table(arrays, names=names)

    return over


def block_count(docs: DataFrame, n: int) -> int:
    """Blocks of documents, and ranges of hashes: few enough that what goes from a block to a range is worth a row."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(n, min(8 * n, size // BLOCK_BYTES))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Counts and the sha256 of what is left of each text; `with_text` adds its bytes as `kept`."""
    spark = docs.sparkSession
    n = partitions(spark)
    blocks = ranges = block_count(docs, n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", bucket(F.coalesce("doc_id", F.lit(0)), blocks))
    counted = rows.select("block", "text").mapInArrow(_count_anchors(ranges), "range int, hashes binary, blocks binary")
    repeated = counted.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_repeated_anchors, "block int, hashes binary")
    runs = rows.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_sorted_runs(ranges), "range int, run binary")
    spans = runs.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_merged_spans, "block int, spans binary")
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut_texts(with_text), RESULT + ", kept binary" * with_text)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window against every other one; for small tables.
ORACLE = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
w AS (SELECT doc_id, i, raw[i + 1:i + 100] AS k FROM (SELECT doc_id, raw, unnest(generate_series(0, octet_length(raw) - 100)) AS i FROM b)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM d),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g) GROUP BY doc_id, island),
r AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM s GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT doc_id, max(z), 9223372036854775806 FROM s GROUP BY doc_id),
h AS (SELECT k.doc_id, string_agg(CASE WHEN y > x AND octet_length(raw) > x THEN hex(raw[x + 1:least(y, octet_length(raw))]) ELSE '' END, '' ORDER BY x) AS kept FROM k JOIN b ON b.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT b.doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN h.kept IS NULL THEN sha256(raw) ELSE sha256(unhex(h.kept)) END AS kept_sha256
FROM b LEFT JOIN r ON r.doc_id = b.doc_id LEFT JOIN h ON h.doc_id = b.doc_id
"""
