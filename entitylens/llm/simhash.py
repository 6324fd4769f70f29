"""Operator 10: SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 have it.
Fingerprints (one row for each distinct value, so copies cost nothing) are dealt to groups
by bit blocks: of `blocks` blocks, two fingerprints at most `distance` bits apart agree in
`blocks - distance` at least, so each pair that may link meets in a group. Within a group,
a table of the Hamming distances to many reference fingerprints is made first; a pair whose
distances to some pivot differ by more than `distance` is discarded (triangle inequality),
and the survivors are verified by their own distance. A group yields a spanning forest of
its links, never all pairs: in a large group, members are searched from linked ones
outwards, and those already linked are not compared again. Links then make components.

Near-dedup asks for a Jaccard similarity of longer shingles. Pairs meet by bit blocks, or by
bands of minimum hashes of those shingles. Short sketches of minimum hashes
travel with the fingerprints and discard pairs that are far below it, with four standard
deviations of slack. What the rest connects is compared by whole shingle sets, chunk by chunk
of a component: all pairs that the sketches allow, but for those connected already.

Null and empty texts have no words: fingerprint zero, linked like any other. Very long texts
are taken whole, in slices. Equal doc_ids keep a row each. A row without doc_id links like
any other; its component is named by the smallest doc_id there, and has no name (null) if
none of its rows has one. Other columns are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, partitions, written

PIVOTS = 24
#: Larger groups are searched from linked members outwards, smaller ones many at a time.
SMALL_GROUP = 128
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, bytes(range(97, 123)))
SKETCH_BITS = 256
#: Standard deviations of slack of the sketches, which only discard.
DEVIATIONS = 4.0
#: Bands of minimum hashes and hashes in each: all but 0.04 % of pairs of similarity 0.8 agree in a band (1 - (1 - 0.8^5)^20).
BANDS, BAND_HASHES = 20, 5
_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, SKETCH_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a component of candidates that are compared at a time; a task holds two such chunks.
CHUNK = 512
#: Shingles that are turned into bits at a time.
_SLICE = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words if they are fewer than a shingle has."""
    k = min(shingle_words, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    view = memoryview(joined)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    return np.fromiter((digest(view[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, shingle_words: int) -> int:
    return majority(words_of(text), shingle_words)


def majority(words: list[bytes], shingle_words: int) -> int:
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle_words)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        counts += np.unpackbits(hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int(bits.view("<i8")[0])


def sketch(words: list[bytes], shingle_words: int) -> bytes:
    """One bit of each of SKETCH_BITS minimum hashes of the shingles: two sketches agree in (1 + Jaccard similarity) / 2 of their bits, on average."""
    return _bits(minima(shingle_set(words, shingle_words)))


def shingle_set(words: list[bytes], shingle_words: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingle_hashes(words, shingle_words)) if words else np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    key = xxhash.xxh64_intdigest(shingles.tobytes(), 7)
    return key - (1 << 64) if key >> 63 else key


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH_BITS, 2**64 - 1 if len(shingles) else 0, np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[at : at + 512, None] * _MULTIPLIERS[None, :]).min(axis=0))
    return least


def _bits(least: np.ndarray) -> bytes:
    return np.packbits((least >> np.uint64(20)).astype(np.uint8) & 1).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 32-bit key of each band of minimum hashes."""
    mixed = least[: BANDS * BAND_HASHES].reshape(BANDS, BAND_HASHES) * _MULTIPLIERS[None, :BAND_HASHES]
    return ((mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, sketch): fp is the fingerprint's 64 bits as a long; the sketch is empty."""

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(x.as_py(), shingle_words) for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.int64()), pa.array([b""] * len(made), pa.binary())], ["doc_id", "fp", "sketch"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batch_of, "doc_id long, fp long, sketch binary")


def signatures(docs: DataFrame, shingle_words: int, similarity_words: int) -> DataFrame:
    """(doc_id, text_hash, fp, sketch, rep, bands): the fingerprint, the sketch of shingles of `similarity_words` words, the key of their set and the keys of its bands."""

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, sketches, keys, bands = [], [], [], []
        for x in batch.column("text"):
            words = words_of(x.as_py())
            shingles = shingle_set(words, similarity_words)
            made.append(majority(words, shingle_words))
            keys.append(set_key(shingles))
            least = minima(shingles)
            sketches.append(_bits(least))
            bands.append(band_keys(least))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(made) + 1, BANDS, dtype=np.int32)), pa.array(np.concatenate(bands) if bands else [], pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(made, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.int64()), lists], ["doc_id", "text_hash", "fp", "sketch", "rep", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return arrow_map(rows, batch_of, "doc_id long, text_hash long, fp long, sketch binary, rep long, bands array<int>")


def pivots() -> np.ndarray:
    """Reference fingerprints: fixed, and far from each other."""
    return np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots()], axis=1)


def most_differing(least_similarity: float, deviations: float = 1.0) -> int:
    """Sketch bits that may differ at a similarity, with so many standard deviations of the estimate allowed for."""
    p = (1 - least_similarity) / 2
    return int(SKETCH_BITS * p + deviations * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _similar(sketches: np.ndarray | None, a, b, most: int) -> np.ndarray:
    if sketches is None:
        return np.ones(np.broadcast(a, b).shape, bool)
    return np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=-1, dtype=np.int64) <= most


def _linked(fps: np.ndarray, table: np.ndarray, one, others: np.ndarray, distance: int, sketches: np.ndarray | None = None, most: int = 0) -> np.ndarray:
    """Those of `others` within `distance` of `one`: first by the pivot table, column for column, then by the fingerprints."""
    for p in range(0, PIVOTS, 6):
        gap = np.abs(table[others, p : p + 6].astype(np.int8) - table[one, p : p + 6].astype(np.int8))
        others = others[gap.max(axis=1) <= distance]
        if not len(others):
            return others
    others = others[np.bitwise_count(fps[others] ^ fps[one]) <= distance]
    return others[_similar(sketches, others, one, most)]


def group_links(fps: np.ndarray, distance: int, sketches: np.ndarray | None = None, most: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group of distinct fingerprints."""
    table, left, links = pivot_table(fps), np.arange(len(fps)), []
    # Sorted by the first pivot's distance, what can link stands in a band.
    left = left[np.argsort(table[:, 0], kind="stable")]
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            d = int(table[one, 0])
            lo, hi = np.searchsorted(table[left, 0], [max(0, d - distance), d + distance + 1])
            near = _linked(fps, table, one, left[lo:hi], distance, sketches, most)
            if len(near):
                links.extend((int(one), int(x)) for x in near)
                front.extend(near.tolist())
                left = left[~np.isin(left, near)]
    return links


def small_group_links(fps: np.ndarray, begins: np.ndarray, sizes: np.ndarray, distance: int, sketches: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small groups at once, as rows (a, b), a spanning forest of each group.

    Each row is compared with the s-th after it, for all s below the size of its group:
    by the pivot table, a column at a time, then by the fingerprints.
    """
    rows = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    left = np.repeat(begins + sizes, sizes) - rows  # rows from this one to the end of its group
    own, pairs = fps[rows], []
    table = pivot_table(own).astype(np.int8)
    for s in range(1, int(sizes.max())):
        one = np.flatnonzero(left > s)
        for p in range(PIVOTS):
            one = one[np.abs(table[one, p] - table[one + s, p]) <= distance]
            if not len(one):
                break
        one = one[np.bitwise_count(own[one] ^ own[one + s]) <= distance]
        one = one[_similar(sketches, rows[one], rows[one + s], most)]
        if len(one):
            pairs.append(np.stack([rows[one], rows[one + s]]))
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    for a, b in np.concatenate(pairs, axis=1).T.tolist() if pairs else ():
        if (x := root(a)) != (y := root(b)):
            above[y] = x
            kept.append((a, b))
    a, b = np.array(kept, np.int64).reshape(-1, 2).T
    return a, b


def _sketch_rows(column: pa.Array, most: int | None) -> np.ndarray:
    if most is None or not len(column):
        return np.zeros((len(column), SKETCH_BITS // 64 if most is not None else 0), np.uint64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _partition_links(distance: int, most: int | None = None):
    def over(batches):
        """Rows come sorted by group; a group may go over several batches."""
        held = []

        def flush(rows, final):
            keys, fps, reps, sk = (np.concatenate([r[i] for r in rows]) for i in range(4))
            sketches = None if most is None else sk
            cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            bounds = np.concatenate([[0], cut, [len(keys)]])
            if not final:
                keep = bounds[-2]
                rest = (keys[keep:], fps[keep:], reps[keep:], sk[keep:])
                bounds = bounds[:-1]
            else:
                rest = None
            sizes, found = np.diff(bounds), []
            small = (sizes > 1) & (sizes <= SMALL_GROUP)
            if small.any():
                a, b = small_group_links(fps, bounds[:-1][small], sizes[small], distance, sketches, most or 0)
                found.append((reps[a], reps[b]))
            for at, n in zip(bounds[:-1][sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
                links = group_links(fps[at : at + n], distance, None if sketches is None else sketches[at : at + n], most or 0)
                if links:
                    a, b = np.array(links).T
                    found.append((reps[at + a], reps[at + b]))
            return found, rest

        def made(found):
            a, b = (np.concatenate([x[i] for x in found]) if found else np.array([], np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        waiting = 0
        for batch in batches:
            keys = np.stack([batch.column("band").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("key").to_numpy(zero_copy_only=False)], axis=1)
            held.append((keys, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("rep").to_numpy(zero_copy_only=False), _sketch_rows(batch.column("sketch"), most)))
            waiting += batch.num_rows
            if waiting >= 100_000:
                found, rest = flush(held, False)
                held, waiting = [rest], 0
                yield made(found)
        if held:
            yield made(flush(held, True)[0])

    return over


def _block_masks(blocks: int) -> list[int]:
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def links(distinct: DataFrame, distance: int, blocks: int, least_similarity: float | None = None) -> DataFrame:
    """Edges (a, b) between representatives of `distinct` (fp, rep, sketch), which connect what is within `distance`.

    least_similarity: pairs whose sketches are far below it are no links.
    """
    masks = _block_masks(blocks)
    keys = []
    for band, kept in enumerate(combinations(masks, blocks - distance)):
        mask = sum(kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(band).alias("band"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    dealt = distinct.select("fp", "rep", "sketch", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "sketch", "k.band", "k.key")
    dealt = dealt.repartition(partitions(distinct.sparkSession), "band", "key").sortWithinPartitions("band", "key", "rep")
    return dealt.mapInArrow(_partition_links(distance, None if least_similarity is None else most_differing(least_similarity, DEVIATIONS)), "a long, b long")


def band_links(distinct: DataFrame, least_similarity: float) -> DataFrame:
    """Edges (a, b) between representatives of `distinct` (rep, sketch, bands) that agree in a band of minimum hashes, and whose sketches are not far below the similarity."""
    dealt = distinct.select(F.lit(0).cast("long").alias("fp"), "rep", "sketch", F.posexplode("bands").alias("band", "key")).select("fp", "rep", "sketch", "band", F.col("key").cast("long").alias("key"))
    dealt = dealt.repartition(partitions(distinct.sparkSession), "band", "key").sortWithinPartitions("band", "key", "rep")
    return dealt.mapInArrow(_partition_links(64, most_differing(least_similarity, DEVIATIONS)), "a long, b long")


def simhash_groups(docs: DataFrame, shingle_words: int = 3, distance: int = 3, blocks: int | None = 5) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over links of at most `distance` bits, itself included.

    blocks: None takes as many as fit the number of fingerprints. It changes the time, not the result.
    """
    if blocks is not None and not distance < blocks <= 64:
        raise ValueError("blocks must be more than distance, and 64 at most")
    fps = written(fingerprints(docs, shingle_words), "fingerprints")
    # A fingerprint stands for itself in the links; documents without doc_id have one too.
    distinct = fps.groupBy("fp", "sketch").agg(F.min("doc_id").alias("least")).withColumn("rep", F.col("fp"))
    if blocks is None:
        distinct = written(distinct, "distinct")
        blocks = blocks_for(distinct.count(), distance)
    found = connected_components(links(distinct, distance, blocks))
    of_fp = written(distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "rep").alias("component")), "of_fingerprint")
    named = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.drop("sketch").join(of_fp.join(named, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def blocks_for(n: int, distance: int, most: int = 128) -> int:
    """The fewest blocks for which `n` fingerprints fall into groups of `most` or fewer on average; more blocks mean more groups for each."""
    for blocks in range(distance + 1, 64):
        if n <= most * 2 ** (64 * (blocks - distance) / blocks):
            return blocks
    return 64


def verified_forest(nodes: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, left: np.ndarray, most: int, least_similarity: float) -> list[tuple[int, int]]:
    """Links that connect what links of the similarity connect, by exact comparison of shingle sets.

    left: which members are compared with the others; if all are, or none is, each is compared
    with all behind it. Pairs that are far apart by sketch or size, or connected already, are passed over.
    """
    above, found, sizes = list(range(len(sets))), [], np.array([len(x) for x in sets])

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    one_side = left.all() or not left.any()
    right = np.flatnonzero(~left)
    for a in range(len(sets)) if one_side else np.flatnonzero(left).tolist():
        others = np.arange(a + 1, len(sets)) if one_side else right
        near = _similar(sketches, others, a, most) & (np.minimum(sizes[others], sizes[a]) >= least_similarity * np.maximum(sizes[others], sizes[a]) - 1e-9)
        for b in others[near].tolist():
            if (x := root(a)) == (y := root(b)) or not sizes[a]:
                continue
            small, large = (sets[a], sets[b]) if sizes[a] < sizes[b] else (sets[b], sets[a])
            shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            if shared + 1e-9 >= least_similarity * (sizes[a] + sizes[b] - shared):
                above[y] = x
                found.append((int(nodes[a]), int(nodes[b])))
    return found


def _verify(most: int, least_similarity: float):
    def over(batches):
        """Rows come sorted by group and node; one group of two chunks at most is held at a time."""
        now, held = None, []

        def links_of(rows):
            rows = [r for n, r in enumerate(rows) if not n or r[0] != rows[n - 1][0]]
            nodes, chunks = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            sets, sketches = [np.frombuffer(r[2], np.uint64) for r in rows], np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
            found = verified_forest(nodes, sets, sketches, chunks == chunks.min(), most, least_similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("component", "i", "j", "node", "chunk", "shingles", "sketch")]
            for *group, node, chunk, shingles, sketched in zip(*columns, strict=True):
                if group != now and held:
                    yield links_of(held)
                    held = []
                now = group
                held.append((node, chunk, shingles, sketched))
        if held:
            yield links_of(held)

    return over


def verified(near: DataFrame, nodes: DataFrame, docs: DataFrame, shingle_words: int, least_similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of the similarity, exact, which connect what such links connect within the components of `near` (a, b). nodes: (rep, doc_id) of a document with that set.

    Members of a component are dealt by hash to chunks of some `chunk`; each pair of chunks is
    compared in a task, so a set is sent once for each chunk of its component, not once for each pair.
    """
    held = written(connected_components(near), "held")
    chunks = held.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(chunk))).cast("int").alias("chunks"))
    members = held.join(nodes, F.col("node") == F.col("rep")).join(chunks, "component").select("node", "component", "chunks", F.col("doc_id").alias("_need"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of the texts of a doc_id, only the one that the node stands for."""
        made = [shingle_set(words_of(x.as_py()), shingle_words) for x in batch.column("text")]
        own = pa.array([set_key(x) == node for x, node in zip(made, batch.column("node").to_pylist(), strict=True)], pa.bool_())
        columns = [batch.column(x) for x in ("node", "component", "chunks", "chunk")]
        arrays = [*columns, pa.array([x.tobytes() for x in made], pa.binary()), pa.array([_bits(minima(x)) for x in made], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["node", "component", "chunks", "chunk", "shingles", "sketch"]).filter(own)

    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(members, F.col("_doc") == F.col("_need")).select("node", "component", "chunks", "chunk", "text")
    made = arrow_map(texts, sets, "node long, component long, chunks int, chunk int, shingles binary, sketch binary")
    groups = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = groups.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "chunk", "shingles", "sketch")
    # Whole components that fit a chunk, and pairs of chunks, go to tasks by hash.
    dealt = groups.repartition(partitions(docs.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    return dealt.mapInArrow(_verify(most_differing(least_similarity, DEVIATIONS), least_similarity), "a long, b long")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copy_links(docs: DataFrame, distinct: DataFrame, nodes: DataFrame, distance: int, similarity_words: int, least_similarity: float) -> DataFrame:
    """Links (a, b) between shingle sets of the similarity, exact, which connect the near copies among the candidates."""
    sets = distinct.groupBy("rep").agg(F.min("sketch").alias("sketch"), F.min("bands").alias("bands"))
    met = links(distinct, distance, blocks_for(distinct.count(), distance), least_similarity).union(band_links(sets, least_similarity))
    return verified(met, nodes, docs, similarity_words, least_similarity)


def one_of_each_group(docs: DataFrame, shingle_words: int = 3, distance: int = 8, similarity_words: int = 5, least_similarity: float = 0.8) -> DataFrame:
    """`docs` with all columns, without those whose group has a smaller doc_id.

    Fingerprints of short shingles, which an edit changes less, and minimum hashes of longer ones
    bring near copies together; the exact similarity of longer shingles decides.

    Rows of equal doc_id and different texts are documents each (of those in one group, the
    one with the smallest hash of its text stays); of rows equal in doc_id and text one stays.
    Rows without doc_id stay.
    """
    known = docs.where("doc_id IS NOT NULL")
    made = written(signatures(known, shingle_words, similarity_words), "signatures")
    distinct = written(made.groupBy("fp", "rep").agg(F.min("sketch").alias("sketch"), F.min("bands").alias("bands"), F.min("doc_id").alias("doc_id")), "distinct")
    nodes = written(distinct.groupBy("rep").agg(F.min("doc_id").alias("doc_id")), "nodes")
    found = connected_components(near_copy_links(known, distinct, nodes, distance, similarity_words, least_similarity))
    own = made.groupBy("rep").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    groups = own.join(found, F.col("rep") == F.col("node"), "left").select("rep", "first", F.coalesce("component", "rep").alias("component"))
    least = groups.groupBy("component").agg(F.min("first").alias("kept"))
    of_rep = groups.join(least, "component").select("rep", "kept")
    texts = made.groupBy("doc_id", "text_hash", "rep").agg(F.count("*").alias("n")).join(of_rep, "rep")
    texts = texts.withColumn("goes", F.struct("doc_id", "text_hash") != F.col("kept")).where("goes OR n > 1")
    texts = written(texts.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "goes"), "decided")
    # A table by itself: it is known to be small before the join, where no row is there twice.
    repeated = written(texts.where("NOT goes").select("_d", "_h"), "repeated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    # Both joins have the same left side, so that its exchange is made once; rows without doc_id go by them.
    named = rows.where("_id IS NOT NULL")
    same = (F.col("_id") == F.col("_d")) & (F.col("_hash") == F.col("_h"))
    whole = named.join(texts, same, "left_anti").select("row").union(rows.where("_id IS NULL").select("row"))
    twice = named.join(repeated, same, "left_semi").groupBy("_id", "_hash").agg(F.first("row").alias("row")).select("row")
    return whole.union(twice).select(*[F.col("row")[x].alias(x) for x in docs.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
