"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entitylens.llm import common, encoding, mixing, packing, quality, sharding, simhash, span_dedup, suffix_dedup, token_files, topk, toxicity

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, source string, n_chars long, row string, _id int, block string, fp string, epoch int, key string, h long, at string"


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delté", "ze"]) + str(r.randint(0, 300)) for _ in range(n))


def sentences(r, n):
    return " ".join(words(r, r.randint(4, 12)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    passage = sentences(r, 9)
    made = [sentences(r, r.randint(3, 14)) for _ in range(40)]
    made += [f"{words(r, 9)} {passage} {words(r, 9)}" for _ in range(4)]
    made += [passage, passage, made[0], made[0] + " more", None, "", " ", "\n\n", "a", "ab" * 300, "x" * 100, "It is. It is. It is. " * 60]
    made += [sentences(r, 2500), "Ünï <|endoftext|> don't  a\n  b\t c 1.5, ÀÉ Σας ΣΑΣ.", "AAA !!! " * 60, "# $ % " * 100]
    return [(i, t) for i, t in enumerate(made)] + [(5, made[5]), (6, "another text with the id of another one")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else f"s{min(i % 5, 2)}", None, "r", 1, "b", "f", 3, "k", 9, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(df):
    return df.collect()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(texts, path):
    library = Tokenizer.from_file(path)
    odd = ["İ, İ. x", "a<|endoftext|> b <|startoftext|>", "<|ENDOFTEXT|> c", "w$$$ x!! (y) é%%% a_b z' it's' n'", "a  b   c", "\n  x y ", "a\t b c", " lead", "x \n y", "a.\n\nb c.", "é́ Σ", "a ", "1.5, 2,000.", "It's we'll", "日本 語, b.", "İI ẞ", "a.b,c .", "x\n,y", "End.\nNext", "tail\n"]
    values = [t or "" for _, t in texts] + odd
    small = encoding.WordCachedEncoder(path, cache_entries=50)
    for _ in range(2):
        ids, at = small.encode_column(pa.array([*values, None]), 7)
        for text, a, b in zip([*values, ""], at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 7], text
        assert at[-1] == len(ids)
    for text in values:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in small.encode_column(pa.array([], pa.string()), 7)] == [0, 1]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library_on_random_texts(path):
    r, library, small = random.Random(17), Tokenizer.from_file(path), encoding.WordCachedEncoder(path, cache_entries=2000)
    signs = [*"abzABZéÉßñµªºÀÿİıΣσςÖЖж日本½²'’\".,!?;:()[]<>|$&%*#@_-+/\\^~`…–“”«»0123456789\t\n\r\x0b\xa0 ́̇‍😀    ", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "don't", "İ,", "İ.", "ẞ", " word", "Word, ", "end.\n"]
    for _ in range(20):
        made = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(500)]
        ids, at = small.encode_column(pa.array(made), 7)
        for text, want, a, b in zip(made, library.encode_batch(made, add_special_tokens=False), at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*want.ids, 7], text


def test_toxicity(spark, docs, none):
    bad, good = "zorgle", ["the", "a", "some", "that"]
    odd = lambda i: " ".join("".join(random.Random(f"{i}{k}").choices("abcdefgh", k=7)) for k in range(9))
    rows = [(i, f"{good[i % 4]} thing {i} {odd(i)}" + (f" {bad} {bad}x {i}" if i % 3 == 0 else "")) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(1, None), (9999, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(train, labels)
    made = {r.doc_id: r for r in rows_of(toxicity.score_documents(train, scorer))}
    assert all(made[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [i for i, _ in rows if made[i].held_out]
    assert np.mean([made[i].predicted == (i % 3 == 0) for i in held]) > 0.9
    s = toxicity.Scorer({}, {})
    assert s.score("you are an idiot") > s.score("idiot") > s.score("not an idiot") > s.score(None) == s.score("") == pytest.approx(toxicity.PRIOR)
    assert s.score("they said you idiot") < s.score("you idiot") and s.score("I will kill you") > s.score("kill time")
    assert s.score("idiot. " * 3) > s.score("idiot.")
    empty = toxicity.fit(none, labels.where("false"))
    assert len(rows_of(toxicity.score_documents(docs, empty))) == docs.count() and not rows_of(toxicity.score_documents(none, empty))


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("You are an idiot.", True), ('He said: "You are an idiot."', False), ('He said: "You are an idiot. Go, you idiot."', False), ('He said: "Hello." You are an idiot.', True), ("He said you are an idiot", False),
        ("You aren't an idiot.", False), ("You aren’t an idiot.", False), ("You are not an idiot.", False), ("idiot", False), ("zorgan", False), ("the zorgan of it", False), ("you zorgan", True), ("zorgan. A zorgan.", True),
        ("I will kill you", True), ("I will not kill you", False), ("I'll kill them", True), ("kill time", False), ("they said they will kill you", False), ("Tu n'es pas un connard.", False), ("Tu es un connard.", True), ("", False), (None, False),
    ],
)
def test_clauses_decide(text, toxic):
    assert (toxicity.Scorer({"zorgan": 1.0, "kill": 1.0, "not": 1.0}, {}).score(text) >= 0.5) is toxic


def test_composed_grammar_equals_its_parts_side_by_side():
    r = random.Random(2)
    for _ in range(400):
        state, states = 0, [0] * len(toxicity.PARTS)
        for tag in r.choices(toxicity.TAGS, k=30):
            steps = [p.step(s, tag) for p, s in zip(toxicity.PARTS, states, strict=True)]
            states = [x for x, _ in steps]
            state, shown = toxicity.GRAMMAR[state][toxicity._TAG[tag]]
            assert shown == toxicity.patterns({x for _, x in steps})


def test_evidence_equals_a_reading_without_shortcuts(texts):
    s = toxicity.Scorer({"alpha3": 1.0, "alpha": 0.6}, {"beta": 0.5})
    for text in [*[t for _, t in texts], "alpha beta, not alpha. You alpha!\nHe said: \"beta. alpha\" beta"]:
        want, low = [0.0] * len(toxicity.PATTERNS), toxicity.spelled(text)
        for paragraph in low.split("\n"):
            states = [0] * len(toxicity.PARTS)
            for token in toxicity._TOKEN.findall(paragraph):
                tag, own = s.tag(token)
                steps = [p.step(x, toxicity.TAGS[tag]) for p, x in zip(toxicity.PARTS, states, strict=True)]
                states = [x for x, _ in steps]
                for x in toxicity.patterns({x for _, x in steps}):
                    want[x] += own
        assert s.evidence(text) == pytest.approx(want)


def test_pattern_weights_are_fitted_between_their_bounds():
    r, names = np.random.default_rng(1), list(toxicity.PATTERNS)
    evidence = np.zeros((4000, len(names)))
    evidence[:, names.index("insult reported")] = r.integers(0, 2, 4000)
    evidence[:, names.index("insult aimed")] = r.integers(0, 2, 4000)
    true = {"insult reported": 0.07, "insult aimed": 1.4}
    toxic = (r.random(4000) < 1 - 0.99 * np.exp(-sum(evidence[:, names.index(k)] * v for k, v in true.items()))).astype(int)
    w = dict(zip(names, toxicity.fitted_weights(evidence, toxic), strict=True))
    assert w["insult reported"] < 0.15 and w["insult aimed"] > 1.2
    assert all(low <= w[k] <= high for k, (_, low, high) in toxicity.PATTERNS.items()) and w["threat willed"] == toxicity.PATTERNS["threat willed"][0]


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 12)).astype(np.float32) * r.exponential(size=(400, 1)).astype(np.float32)
    x[40:140] = x[7]  # copies
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0, None] + [0.0] * 10), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (550, [1.0, 2.0]), (551, [2.0, 2.0]), (600, [0.0] * 12), (650, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    good = {i: np.floor(np.array(v, float) * 256).astype(np.int64) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)}
    expected = set()
    for q, a in good.items():
        if q % 50 == 0:
            s = sorted((-int(a @ b), i) for i, b in good.items() if i != q and len(a) == len(b))[:5]
            expected |= {(q, n, i, -v) for n, (v, i) in enumerate(s, 1)}
    assert {tuple(x) for x in rows_of(topk.top_inner_products(df))} == expected
    assert not rows_of(topk.top_inner_products(df.where("false")))


def test_topk_of_repeated_rows(spark):
    r = np.random.default_rng(9)
    x = [(int(i), r.integers(0, 3, 2).astype(float).tolist()) for i in r.integers(0, 12, 120) * 10] + [(50, [2.0, 2.0])] * 9 + [(60, [2.0, 2.0])] * 9
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in x], "embedding": pa.array([v for _, v in x], pa.list_(pa.float32()))}))
    want = Counter(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE})").fetchall())
    brute = Counter()
    for q in {i for i, _ in x if i % 50 == 0}:
        own = {tuple(v) for i, v in x if i == q}
        s = sorted((-int(256 * 256 * np.dot(a, b)), i) for a in own for i, b in x if i != q)[:5]
        brute.update((q, n, i, -v) for n, (v, i) in enumerate(s, 1))
    assert Counter(map(tuple, rows_of(topk.top_inner_products(df)))) == brute == want


def test_topk_in_waves(spark, monkeypatch):
    """Many small blocks, so that thresholds rise over several waves; ids with vectors of several sizes; wide components."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = np.random.default_rng(5)
    x = [(int(i) * 10, (r.normal(size=int(d)) * w).tolist()) for i, d, w in zip(r.integers(0, 60, 700), r.choice([3, 6], 700), r.choice([0.05, 1.0, 900.0], 700))]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in x], "embedding": pa.array([v for _, v in x], pa.list_(pa.float64()))}))
    want = Counter(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE})").fetchall())
    whole = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in x]
    brute = Counter()
    for q in {i for i, _ in x if i % 50 == 0}:
        own = {v for i, v in whole if i == q}
        s = sorted((-sum(a * b for a, b in zip(o, v, strict=True)), i) for o in own for i, v in whole if i != q and len(v) == len(o))[:5]
        brute.update((q, n, i, -v) for n, (v, i) in enumerate(s, 1))
    assert Counter(map(tuple, rows_of(topk.top_inner_products(df)))) == brute == want


def test_topk_prunes():
    r = np.random.default_rng(1)
    q, c = (r.normal(size=(n, 16)) @ np.diag(2.0 ** -np.arange(16)) * 900 for n in (20, 3000))
    q, c = q.astype(np.int64), c.astype(np.int64)
    turn = np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1]
    scores = q @ c.T
    threshold = np.partition(scores, -5, axis=1)[:, -5].astype(float)
    (row, vec, found), share = topk.block_best(np.arange(20), q, np.arange(3000) + 100, c, threshold, turn, 5)
    assert share < 0.3 and all(scores[a, b - 100] == s for a, b, s in zip(row, vec, found, strict=True)) and len(row) >= 100


def test_running_sums(spark):
    r = random.Random(3)
    x = [(r.choice("ab"), r.randrange(1000), i, r.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(x, "k string, at long, i long, v int")
    want = {i: sum(v for k2, at2, i2, v in x if k2 == k and (at2, i2) < (at, i)) for k, at, i, _ in x}
    for span in (None, 64):
        assert {row.i: row.s for row in rows_of(common.running_sums(df, ["k"], "at", ["i"], F.col("v"), "s", span))} == want


def test_mixing(spark, docs, none, texts, tmp_path):
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "source").toPandas()
    con.register("documents", frame)
    got = sorted((tuple(str(v) for v in r) for r in mixing.mix(docs).select("doc_id", "source", "tokens", "epoch", "block", "position").collect()))
    want = sorted(tuple(str(v) for v in r) for r in con.execute(f"SELECT doc_id, source, tokens, epoch, block, position FROM ({mixing.ORACLE})").fetchall())
    # Rows of equal doc_id may change places in a stream.
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want)
    once = mixing.mixed_documents(docs, budget_share=0.8, entropy_share=None, max_repeat=1.0)
    assert once.columns == docs.columns and once.count() <= docs.count() and once.count() > 0
    flat = spark.createDataFrame([(i, " ".join(["w"] * 10), "big" if i < 90 else "small") for i in range(100)], "doc_id long, text string, source string")
    n = Counter(r.source for r in rows_of(mixing.mix(flat, entropy_share=1.0, max_repeat=3.0)))
    assert n["small"] == 30 and 60 <= n["big"] <= 70  # three epochs at most
    assert not rows_of(mixing.mix(none)) and not rows_of(mixing.mix(docs.where("text IS NULL")))


def test_mixed_documents_come_once_for_each_time_they_are_taken(spark):
    rows = [(i, f"one two three {i}", "large") for i in range(60)] + [(100, "a b c", "small")] * 3 + [(None, "d e", "small")] * 2 + [(0, "d e", "small"), (101, None, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"entropy_share": 1.0, "max_repeat": 3.0, "block_tokens": 8}
    taken = Counter((r.doc_id, r.source, r.tokens) for r in rows_of(mixing.mix(df, **options)))
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in rows_of(mixing.mixed_documents(df, **options)))
    assert got == taken and max(taken.values()) > 3


def test_mixed_documents_give_repeated_and_null_ids_once(spark):
    made = [(7, "a b c", "s"), (7, "a b c", "s"), (7, "d e f g", "s"), (7, "a b c", "t"), *[(None, f"n{i % 4} x y", "s") for i in range(8)], *[(i, "p q r", "t") for i in range(20, 30)]]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    whole = mixing.mixed_documents(df, budget_share=1.0, entropy_share=None, max_repeat=1.0)
    assert Counter(map(tuple, rows_of(whole))) == Counter(made)
    half = spark.createDataFrame([(1, f"w{i} b c", "s") for i in range(10)] + [(2, "same b c", "s")] * 10, df.schema)
    assert len(rows_of(mixing.mixed_documents(half, budget_share=0.5, entropy_share=None, max_repeat=1.0))) == 10


def test_token_files_round_trip(spark, docs, none, texts, tmp_path):
    for kind in ("dictionary", "delta"):
        path = str(tmp_path / kind)
        token_files.write_token_files(docs, path, BYTE, end_id=2, row_group_bytes=1 << 16, page_rows=10, ids_encoding=kind)
        found = sorted(rows_of(token_files.token_digests(token_files.read_token_files(spark, path))), key=lambda r: r.start)
        library = Tokenizer.from_file(BYTE)
        start, seen = 0, Counter()
        for r in found:
            assert r.start == start
            start += r.n_tokens
            seen[r.doc_id, r.ids_crc32] += 1
        assert [r.doc_id for r in found] == sorted(i for i, _ in texts)
        assert seen == Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in texts)
        meta = token_files.read_token_files(spark, path).select("doc_id", "start")
        assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    token_files.write_token_files(none, str(tmp_path / "none"), BYTE, end_id=2)
    assert not rows_of(token_files.token_digests(token_files.read_token_files(spark, str(tmp_path / "none"))))


def test_ranges(spark):
    df = spark.createDataFrame([(i * i,) for i in range(-200, 500)] + [(None,)], "doc_id long")
    for n in (1, 2, 7, 40):
        bounds = token_files.range_bounds(df, "doc_id", n)
        found = rows_of(df.select("doc_id", token_files.range_number("doc_id", bounds).alias("n")))
        assert all(r.n == (0 if r.doc_id is None else sum(b <= r.doc_id for b in bounds)) for r in found)


def _sharding_holds(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == n
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, ())) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding(spark, docs, none, texts):
    made = rows_of(sharding.balanced_shards(docs))
    _sharding_holds(made, len(texts))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in made) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    r = random.Random(1)
    groups = [f"text {r.randint(0, 60)}" for _ in range(600)] + ["hot"] * 400 + [f"single {i}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(groups)), "doc_id long, text string")
    made = rows_of(sharding.balanced_shards(df))
    _sharding_holds(made, len(groups))
    shards = defaultdict(Counter)
    for x in made:
        shards[groups[x.doc_id]][x.shard] += 1
    whole = [len(c) == 1 for t, c in shards.items() if t.startswith("text")]
    assert np.mean(whole) > 0.9  # small groups stay together
    assert len(shards["hot"]) <= 4  # 400 of 1600 need two shards of 200 at least
    cut = lambda home: sum(1 for t in {t for t in groups if t.startswith("text")} for c in [Counter(home[i] for i, x in enumerate(groups) if x == t)] for _ in range(sum(c.values()) - max(c.values())))
    start = {x.doc_id: x.s for x in rows_of(df.select("doc_id", sharding.bucket(F.struct(F.col("doc_id"), F.lit("home")), 8).alias("s")))}
    assert cut({x.doc_id: x.shard for x in made}) * 10 < cut(start)
    all_linked = spark.createDataFrame([(i, f"t{i % 40}") for i in range(400)], "doc_id long, text string")
    _sharding_holds(rows_of(sharding.balanced_shards(all_linked)), 400)
    assert not rows_of(sharding.balanced_shards(none))


def _suffix_brute(texts):
    seen, out = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0], x[1] or "")):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if mark[k] and not (k and mark[k - 1]))
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return Counter(out)


def test_suffix_dedup_equals_brute_force(docs, none, texts):
    assert Counter(tuple(r) for r in rows_of(suffix_dedup.remove_repeats(docs))) == _suffix_brute(texts)
    assert not rows_of(suffix_dedup.remove_repeats(none))


def test_suffix_dedup_bytes(spark):
    r = random.Random(8)
    base = bytes(r.choice(b"abc") for _ in range(3000)).decode()
    some = [(i, base[(a := r.randint(0, 2500)) : a + r.randint(0, 500)] + str(i) + base[(a := r.randint(0, 2500)) : a + 150]) for i in range(60)]
    some += [(100, "\0" * 250), (101, "\0" * 120 + "\1" * 100), (102, "x" * 99), (103, "x" * 100), (104, "é" * 120)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert Counter(tuple(x) for x in rows_of(suffix_dedup.remove_repeats(df))) == _suffix_brute(some)


def test_anchor_ranges_are_even():
    raw = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    *_, h = suffix_dedup.anchors(raw, np.array([0, len(raw)]))
    for ranges in (32, 408):
        n = np.bincount(suffix_dedup._range_of(h, ranges), minlength=ranges)
        assert len(n) == ranges and n.max() < 2.5 * len(h) / ranges


def test_loser_tree_gives_order_and_prefixes():
    r = random.Random(1)
    for _ in range(60):
        runs = []
        for _ in range(r.randint(1, 9)):
            s = sorted((bytes(r.choice(b"ab") for _ in range(100)) if r.random() < 0.5 else b"a" * r.randint(90, 99) + b"b").ljust(100, b"z") for _ in range(r.randint(0, 15)))
            runs.append((s, [0, *[suffix_dedup.common_prefix(a, b, 0) for a, b in zip(s, s[1:], strict=False)]] if s else []))
        at, got = [0] * len(runs), []
        for run, prefix in suffix_dedup.merge_runs(runs):
            got.append((runs[run][0][at[run]], prefix))
            at[run] += 1
        want = sorted(x for s, _ in runs for x in s)
        assert [x for x, _ in got] == want
        assert [p for _, p in got[1:]] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(want, want[1:], strict=False)]


def _span_brute(texts):
    """Of every run of sentences that is long enough, not only the shortest ones: where it stands."""
    occurrences = defaultdict(list)
    for i, t in dict.fromkeys(texts):
        split = [(t or "")[a:b].split() for a, b in span_dedup.sentences(t or "")]
        for a in range(len(split)):
            run, most = [], a + 40  # a longer run that repeats is covered by its parts
            for b in range(a + 1, min(most, len(split)) + 1):
                run = run + split[b - 1]
                if b - a >= span_dedup.MIN_SENTENCES and len(run) >= span_dedup.MIN_WORDS or len(run) >= span_dedup.LONG_SENTENCE:
                    occurrences[" ".join(run)].append((i, (i, t or ""), a, b))
    return occurrences


def test_sentence_spans(docs, none, texts):
    made = rows_of(span_dedup.cut_documents(docs))
    by_text = defaultdict(set)
    for r in made:
        by_text[r.row.doc_id, r.row.text].add((r._new, r._removed))
    assert all(len(x) == 1 for x in by_text.values()) and len(made) == len(texts)
    unique = {i: t for i, t in texts if i not in (5, 6)}
    gone = defaultdict(set)
    for places in _span_brute([(i, t) for i, t in unique.items()]).values():
        for i, _, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b))
    for i, t in unique.items():
        parts = span_dedup.sentences(t or "")
        expected = "".join(t[a:b] for n, (a, b) in enumerate(parts) if n not in gone[i]) if gone[i] else t
        ((new, removed),) = by_text[i, t]
        assert (new, removed) == (expected, len(gone[i]))
    assert by_text[45, unique[45]] == {("", len(span_dedup.sentences(unique[45])))}
    kept = span_dedup.remove_repeated_sentences(docs)
    assert kept.columns == docs.columns and all(r.text is None or r.text.split() or not (unique.get(r.doc_id) or "").split() for r in rows_of(kept))
    assert not rows_of(span_dedup.cut_documents(none))


def test_a_long_sentence_is_a_span_by_itself(spark):
    r = random.Random(21)
    long, short = (words(r, n).capitalize() + "." for n in (span_dedup.LONG_SENTENCE, span_dedup.LONG_SENTENCE - 1))
    made = [(i, f"{sentences(r, 3)} {x} {sentences(r, 3)}") for i, x in enumerate((long, long, short, short))]
    left = {x.row.doc_id: x for x in rows_of(span_dedup.cut_documents(spark.createDataFrame(made, "doc_id long, text string")))}
    assert [left[i]._removed for i in range(4)] == [0, 1, 0, 0] and long in left[0]._new and long not in left[1]._new and short in left[3]._new
    assert span_dedup.spans([30]) == [(0, 1)] and span_dedup.spans([24]) == []


def test_sentences_cover_the_text(texts):
    for _, t in texts:
        parts = span_dedup.sentences(t or "")
        assert "".join((t or "")[a:b] for a, b in parts) == (t or "")


def test_packing(spark, docs, none, texts):
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for n, k in enumerate(range(0, len(ids), 512)):
            part = ids[k : k + 512]
            want[i, n, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = rows_of(packing.pack_documents(docs, WORD, size=512))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= 1.15 * sum(r.length for r in rows) / 512 + 1
    assert not rows_of(packing.pack_documents(none, WORD))


def test_packing_encodes_some_mb_at_a_time(monkeypatch):
    r, seen, whole = random.Random(8), [], encoding.WordCachedEncoder.encode_column
    made = [(i, None if i % 9 == 0 else " ".join(r.choices(["one", "two", "three", "four"], k=1 if i % 3 else 60_000))) for i in range(90)]
    made.append((90, "five " * 1_200_000))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in made]), pa.array([t for _, t in made])], ["doc_id", "text"])

    def spy(self, texts, end_id):
        seen.append((len(texts), sum(len(t or "") for t in texts.to_pylist())))
        return whole(self, texts, end_id)

    monkeypatch.setattr(encoding.WordCachedEncoder, "encode_column", spy)
    got = [x for part in packing.cut(batch, WORD, 1, 4096) for x in part.to_pylist()]
    assert sum(n for n, _ in seen) == len(made) and len(seen) > 2
    assert all(n == 1 or size <= encoding.SLICE_BYTES for n, size in seen)
    library = Tokenizer.from_file(WORD)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in made}
    want = [(i, n, k, len(ids[i][k : k + 4096]), zlib.crc32(np.array(ids[i][k : k + 4096], "<u4").tobytes())) for i, _ in made for n, k in enumerate(range(0, len(ids[i]), 4096))]
    assert [(x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got] == want
    assert not list(packing.cut(batch.slice(0, 0), WORD, 1, 4096))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_keeps_no_long_pieces(path):
    r, library, small = random.Random(9), Tokenizer.from_file(path), encoding.WordCachedEncoder(path)
    made = ["".join(r.choices("abcdefgé,", k=3000)) + " word" for _ in range(40)]
    ids, at = small.encode_column(pa.array(made), 7)
    for text, a, b in zip(made, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 7]
    assert max(map(len, [*small.bare, *small.spaced])) <= encoding.KEPT_CHARACTERS


def test_best_fit_places_as_a_plain_list_does():
    r = random.Random(5)
    for size, most in ((10, 2), (64, 5), (512, 16)):
        p, opened, made = packing.BestFit(size, most), [], 0
        for length in (min(size, 1 + int(r.expovariate(4 / size))) for _ in range(3000)):
            sequence, offset = p.put(length)
            fitting = [x for x in opened if size - x[1] >= length]
            least = min((size - x[1] for x in fitting), default=None)
            if least is None:
                assert (sequence, offset) == (made, 0)
                opened.append([made, length])
                made += 1
            else:
                (home,) = [x for x in fitting if x[0] == sequence]
                assert size - home[1] == least and offset == home[1]
                home[1] += length
            opened = [x for x in opened if x[1] < size]
            if len(opened) > most:
                fullest = max(x[1] for x in opened)
                (gone,) = [x for x in opened if x[0] not in p.used]
                assert gone[1] == fullest
                opened.remove(gone)
            assert {x[0]: x[1] for x in opened} == p.used


def test_packing_spreads_rows_without_doc_id(spark):
    df = spark.createDataFrame([(None, f"word{i} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    made = rows_of(packing.pack_documents(df, WORD, size=64))
    by = defaultdict(list)
    for x in made:
        by[x.sequence_id].append((x.offset, x.length))
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) for v in by.values())
    assert sum(r.piece == 0 for r in made) == 300


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.put(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    q = packing.BestFit(10, 2)
    for x in (6, 7, 8):
        q.put(x)
    assert q.closed == {2} and q.put(2) == (1, 7)


def test_quality(spark, docs, none, texts):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    got = Counter(tuple(r) for r in rows_of(quality.judge(docs).drop("rejected_by")))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    frame = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).toPandas()
    con.register("documents", frame)
    want = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({quality.ORACLE})").fetchall())
    assert not want - got and sum(got.values()) == len(texts)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(n for r, n in got.items() if r[-1])
    assert not rows_of(quality.judge(none)) and not rows_of(quality.filter_documents(none))


def test_quality_order_changes_no_verdict(texts):
    values = [t for _, t in texts]
    order = quality.order_rules(values)
    assert sorted(order) == sorted(quality.RULES)
    for t in values:
        x = quality.Text(t)
        assert any(quality.RULES[n](x) for n in order) == any(f(x) for f in quality.RULES.values())


@pytest.mark.parametrize(("value", "n"), [("a b c a b c", 6), ("a b c d", 0), ("a a a a", 4), ("x a b c y a b c a b c", 9), ("", 0), ("a b", 0)])
def test_repeat_words(value, n):
    assert quality.repeat_words(value.encode().split()) == n


def _fingerprint_brute(t, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in low.encode().split() if x]
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, distance):
    above = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = above[i], above[j]
                for x in above:
                    if above[x] == b or above[x] == a:
                        above[x] = min(a, b)
    return above


def test_simhash_equals_brute_force(spark, docs, none, texts):
    rows = rows_of(simhash.simhash_groups(docs))
    assert Counter((r.doc_id, r.fp % 2**64) for r in rows) == Counter((i, _fingerprint_brute(t)) for i, t in texts)
    values = [_fingerprint_brute(t) for _, t in texts]
    joined = _components(dict(enumerate(values)), 3)
    least = {c: min(texts[k][0] for k, x in joined.items() if x == c) for c in set(joined.values())}
    assert Counter((x.doc_id, x.fp % 2**64, x.component_id) for x in rows) == Counter((i, v, least[joined[k]]) for k, ((i, _), v) in enumerate(zip(texts, values, strict=True)))
    r = random.Random(4)
    near = [0] * 3 + [sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for _ in range(400)] + [r.getrandbits(64) for _ in range(300)]
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v, i, b"") for i, v in enumerate(dict.fromkeys(near))], "fp long, rep long, sketch binary")
    fps = {i: v for i, v in enumerate(dict.fromkeys(near))}
    for distance, blocks in ((3, 5), (3, 8), (1, 3)):
        from entitylens.llm.common import connected_components

        found = {x.node: x.component for x in rows_of(connected_components(simhash.links(df, distance, blocks)))}
        assert {i: found.get(i, i) for i in fps} == _components(fps, distance)
    assert not rows_of(simhash.simhash_groups(none))


def test_simhash_links_rows_without_doc_id(spark):
    made = [(None, "one two three four five"), (2**53 + 1, "one two three four five"), (2**60 + 7, "six seven eight"), (None, "nine ten eleven"), (None, ""), (None, None), (9, " ")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    fps = dict(enumerate(_fingerprint_brute(t) for _, t in made))
    for distance, blocks in ((3, 5), (40, 41)):
        joined = _components(fps, distance)
        least = {c: min((made[k][0] for k, x in joined.items() if x == c and made[k][0] is not None), default=None) for c in set(joined.values())}
        got = Counter((x.doc_id, x.fp % 2**64, x.component_id) for x in rows_of(simhash.simhash_groups(df, distance=distance, blocks=blocks)))
        assert got == Counter((made[k][0], fps[k], least[joined[k]]) for k in fps)


def test_large_groups_are_searched_outwards():
    r = np.random.default_rng(2)
    fps = np.unique(np.uint64(5) ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)))
    links = simhash.group_links(fps, 3)
    a, b = simhash.small_group_links(fps[:100], np.array([0]), np.array([100]), 3)
    assert all(int(fps[x] ^ fps[y]).bit_count() <= 3 for x, y in [*links, *zip(a, b, strict=True)])
    joined = _components(dict(enumerate(map(int, fps[:100]))), 3)
    assert len(a) == 100 - len(set(joined.values())) and len(links) == len(fps) - len(set(_components(dict(enumerate(map(int, fps))), 3).values()))


def test_sketches_estimate_similarity():
    r = random.Random(6)
    base = words(r, 400).encode().split()
    for edits in (0, 4, 15, 60, 400):
        other = list(base)
        for at in r.sample(range(400), edits):
            other[at] = b"edit%d" % r.randint(0, 10**6)
        a, b = ({tuple(x[i : i + 5]) for i in range(396)} for x in (base, other))
        x, y = (int.from_bytes(simhash.sketch(w, 5)) for w in (base, other))
        assert abs(1 - 2 * (x ^ y).bit_count() / 256 - len(a & b) / len(a | b)) < 0.2
    assert simhash.sketch([], 5) == bytes(32) and simhash.most_differing(1.0) == 0 < simhash.most_differing(0.8) < 40


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(9)
    rows = []
    for g in range(30):
        base = words(r, 250).split()
        rows.append((g * 10, " ".join(base)))
        for c in range(1, 4):
            other = list(base)
            for at in r.sample(range(250), c):
                other[at] = f"edit{r.randint(0, 10**6)}"
            rows.append((g * 10 + c, " ".join(other)))
        rows.append((g * 10 + 9, " ".join(base[:100]) + words(r, 150)))
    kept = {x.doc_id for x in rows_of(simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(g * 10 in kept and g * 10 + 9 in kept for g in range(30))
    assert len([1 for g in range(30) for c in (1, 2, 3) if g * 10 + c in kept]) <= 4


def _near_texts(edits):
    r = random.Random(12)
    made = []
    for g in range(120):
        base = words(r, 250).split()
        other = list(base)
        for at in r.sample(range(250), r.choice(edits)):
            other[at] = f"edit{r.randint(0, 10**6)}"
        made += [(g * 10, " ".join(base)), (g * 10 + 1, " ".join(other))]
    return made


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def test_near_dedup_decides_by_exact_similarity(spark):
    made = _near_texts(range(2, 10))
    texts = dict(made)
    similarity = {g: _jaccard(texts[g], texts[g + 1]) for g in texts if g % 10 == 0}
    assert sum(0.7 <= s < 0.8 for s in similarity.values()) > 20 and sum(0.8 <= s < 0.9 for s in similarity.values()) > 20
    kept = {x.doc_id for x in rows_of(simhash.one_of_each_group(spark.createDataFrame(made, "doc_id long, text string")))}
    assert all(g in kept for g in similarity)
    assert all(g + 1 in kept for g, s in similarity.items() if s < 0.8)


def test_near_copies_meet_whatever_their_fingerprints(spark):
    made = _near_texts(range(3, 6))
    texts = dict(made)
    near = [g for g in texts if g % 10 == 0 and _jaccard(texts[g], texts[g + 1]) >= 0.8]
    apart = [g for g in near if (simhash.fingerprint(texts[g], 3) ^ simhash.fingerprint(texts[g + 1], 3)).bit_count() > 8]
    assert len(near) > 80 and len(apart) > 5
    kept = {x.doc_id for x in rows_of(simhash.one_of_each_group(spark.createDataFrame(made, "doc_id long, text string")))}
    assert kept == {g for g in texts if g - 1 not in near}


def test_verified_splits_and_finds_what_the_forest_left_out(spark):
    r = random.Random(14)
    # A chain: neighbours are alike, the ends are not; and a node that the sketches link to one it is not like.
    chain = [words(r, 250).split()]
    for n in range(8):
        chain.append([f"c{n}x{i}" if i % 125 == n else w for i, w in enumerate(chain[-1])])
    far = [f"far{i}" if i % 32 == 0 else w for i, w in enumerate(chain[0])]
    made = [(i, " ".join(x)) for i, x in enumerate([*chain, far])]
    texts = dict(made)
    df = spark.createDataFrame(made, "doc_id long, text string")
    signed = simhash.signatures(df, 3, 5).cache()
    key = {x.doc_id: x.rep for x in rows_of(signed)}
    nodes = signed.select("rep", "doc_id")
    pairs = [(a, b) for a in texts for b in texts if a < b]
    # A star of candidates hides the pairs between its ends; all are found, whatever the chunks.
    star = simhash._ordered(spark.createDataFrame([(key[9], key[i]) for i in range(9)], "a long, b long"))
    near = {(key[a], key[b]) for a, b in pairs if _jaccard(texts[a], texts[b]) >= 0.8}
    for chunk in (100, 3, 1):
        good = {tuple(x) for x in rows_of(simhash.verified(star, nodes, df, 5, 0.8, chunk))}
        assert {frozenset(x) for x in good} <= {frozenset(x) for x in near} and 0 < len(near) < len(pairs)
        assert _joined(set(key.values()), good) == _joined(set(key.values()), near)


def _joined(nodes, edges):
    above = {n: n for n in nodes}
    for a, b in edges:
        x, y = above[a], above[b]
        above = {n: min(x, y) if c in (x, y) else c for n, c in above.items()}
    return above


def test_one_of_each_group(spark, docs, none):
    kept = simhash.one_of_each_group(docs)
    ids = Counter(r.doc_id for r in rows_of(kept))
    assert kept.columns == docs.columns and 0 in ids and 46 not in ids and not rows_of(simhash.one_of_each_group(none))
    some = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (2, "u v w x y z", 9), (3, "k l m n o p", 1), (3, "k l m n o p", 1), (None, "a b c d e f", 3)], "doc_id long, text string, _gone int")
    assert sorted(map(str, rows_of(simhash.one_of_each_group(some).select("doc_id", "text", "_gone")))) == sorted(str(x) for x in rows_of(some.where("doc_id IS NULL OR _gone IN (7, 9, 1)").dropDuplicates()))
    unknown = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert simhash.one_of_each_group(unknown).count() == 3


@pytest.mark.parametrize(("n", "distance"), [(10, 3), (10**6, 3), (10**9, 8), (1, 0)])
def test_blocks_for(n, distance):
    blocks = simhash.blocks_for(n, distance)
    assert distance < blocks <= 64 and (n <= 128 * 2 ** (64 * (blocks - distance) / blocks) or blocks == 64)


def test_nulls_in_doc_id(spark):
    df = spark.createDataFrame([(None, "one two three. " * 20, None), (None, None, "s"), (1, "", "s"), (1, "", "s")], "doc_id long, text string, source string")
    for f in (quality.judge, simhash.simhash_groups, sharding.balanced_shards, suffix_dedup.remove_repeats, mixing.mix):
        assert Counter(r.doc_id for r in rows_of(f(df))) == Counter([None, None, 1, 1]) or f is mixing.mix
    assert Counter(r.row.doc_id for r in rows_of(span_dedup.cut_documents(df))) == Counter([None, None, 1, 1])
    assert len(rows_of(packing.pack_documents(df, WORD))) == 4
    assert Counter((r.doc_id, r.held_out) for r in rows_of(toxicity.score_documents(df, toxicity.Scorer({}, {})))) == Counter([(None, None)] * 2 + [(1, zlib.crc32(b"1") % 5 == 0)] * 2)
