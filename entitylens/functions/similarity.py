"""Name similarity (SIM1-SIM7)."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .udfs import arrow_udf, let
from .text import common_prefix, company_key, full_initialism, initialism_tokens, lookup_tokens, soft_extension, trailing_initialism, words_of


@arrow_udf("double")
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the order of the arguments matters. Each distinct pair is computed once in a batch."""
    seen: dict[tuple, float | None] = {}
    out = []
    for pair in zip(left, right, strict=True):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else SequenceMatcher(None, *pair).ratio()
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def _edits(total: int, least: float) -> int:
    """Letters that two texts of so many letters together may have unmatched, if their ratio is `least` or more; their parity is that of the total."""
    most = int((1 - least) * total + 1e-6)
    return most - (total - most) % 2


def _partners(n: int, least: float) -> range:
    """Lengths of the texts whose ratio with one of length n can be `least` or more."""
    return range(max(1, math.ceil(n * least / (2 - least) - 1e-6)), int(n * (2 - least) / least + 1e-6) + 1)


def part_keys(x: str, least: float) -> list[str]:
    """For each length that a near text can have, x in one part more than letters may be unmatched: one part is whole in that text."""
    made = []
    for n in _partners(len(x), least):
        parts = _edits(n + len(x), least) + 1
        ends = [len(x) * i // parts for i in range(parts + 1)]
        made += [f"{n}:{len(x)}:{i}:{x[ends[i] : ends[i + 1]]}" for i in range(parts)]
    return made


def place_keys(x: str, least: float) -> list[str]:
    """The keys by which x meets the `part_keys` of every text whose ratio with it is `least` or more.

    Some part i is whole with exactly i unmatched letters before it (counted part by part, the
    sum of unmatched letters less i begins at 0, ends below it and falls by at most one), so it
    stands at most i letters off, and no more off from the end than letters are left.
    """
    made = []
    for n in _partners(len(x), least):
        edits = _edits(n + len(x), least)
        ends = [n * i // (edits + 1) for i in range(edits + 2)]
        for i in range(edits + 1):
            for off in range(-i, i + 1, 2):
                at, end = ends[i] + off, ends[i + 1] + off
                if at >= 0 and end <= len(x) and abs(len(x) - n - off) <= edits - i:
                    made.append(f"{len(x)}:{n}:{i}:{x[at:end]}")
    return list(dict.fromkeys(made))


def near_keys(value: Column, least: float, parts: bool) -> Column:
    """part_keys or place_keys of a column; none of a null or empty text."""
    keys = part_keys if parts else place_keys

    def made(values: pd.Series) -> pd.Series:
        return values.map(lambda x: keys(x, least) if x else [])

    return F.pandas_udf(made, "array<string>")(value)


def quick_bound(a: Column, b: Column) -> Column:
    """An upper bound of the ratio, from the lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2 * F.least(F.length(a), F.length(b)) / total).otherwise(F.lit(1.0))


def name_parts(name: Column) -> Column:
    """struct(key, tokens, initial) of a name: what compatibility reads, to be computed once a name."""
    made = lambda key: F.struct(key.alias("key"), words_of(key).alias("tokens"), initialism_tokens(name).alias("initial"))
    return let(company_key(name), made)


def compatible_parts(left: Column, right: Column) -> Column:
    """Compatibility of two `name_parts` by all rules but similarity: true, or false where only similarity may still say yes."""

    def ordered(p: Column) -> Column:
        short, long, n = p["s"], p["l"], F.size(p["s"])
        prefix = (n >= 3) & (F.slice(long, F.lit(1), n) == short)
        subset = (n >= 2) & (F.size(F.array_except(short, long)) == 0)
        return (n > 0) & ((F.array_join(short, "") == F.array_join(long, "")) | prefix | ((n == 1) & soft_extension(short, long)) | subset)

    a, b, x, y = left["tokens"], right["tokens"], left["initial"], right["initial"]
    swap = F.size(a) > F.size(b)
    initial = trailing_initialism(x, y) | trailing_initialism(y, x) | full_initialism(x, y) | full_initialism(y, x)
    both = F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("l"))
    return let(both, ordered) | ((F.size(a) > 0) & (F.size(b) > 0) & initial)


def decided_compatible(left: Column, right: Column) -> Column:
    """compatible_parts of two names."""
    return let(F.struct(name_parts(left).alias("a"), name_parts(right).alias("b")), lambda p: compatible_parts(p["a"], p["b"]))


SAME_NAME = 0.93


def match_features(t: Column, fp: Column, d: Column, s: Column, d_fp: Column, s_fp: Column) -> Column:
    """What the confidence gate and the score read, without the similarities: of the words and joined words of a name, a display name and a slug."""
    return F.struct(
        F.size(t).alias("n_tokens"), fp.alias("fp"), d_fp.alias("display_fp"), s_fp.alias("slug_fp"), F.size(F.array_intersect(t, F.array_union(d, s))).alias("overlap"),
        F.greatest(common_prefix(fp, d_fp), common_prefix(fp, s_fp)).alias("prefix"), ((fp != "") & ((fp == d_fp) | (fp == s_fp))).alias("exact"),
        F.get(t, F.lit(0)).alias("first"), F.get(d, F.lit(0)).alias("display_first"),
    )


#: Least ratios of names of several words and of one word that share no word with their match.
NEAR_WORDS, NEAR_WORD = 0.88, 0.95


def is_confident(f: Column, similarity: Column) -> Column:
    return f["exact"] | ((f["overlap"] >= 1) & (similarity >= 0.63)) | ((f["n_tokens"] >= 2) & (similarity >= NEAR_WORDS) & (f["prefix"] >= 2)) | ((f["n_tokens"] == 1) & (similarity >= NEAR_WORD) & (f["prefix"] >= 5))


def match_score(f: Column, exchange: Column, similarity_display: Column, similarity_slug: Column) -> Column:
    def either_starts(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (a.startswith(b) | b.startswith(a))

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    both = f["first"].isNotNull() & f["display_first"].isNotNull()
    tokens = F.when(both, f["overlap"] * 18 + F.when(f["first"] == f["display_first"], 25).when(f["overlap"] == 0, -20).otherwise(0)).otherwise(0)
    made = points(f["exact"] & (f["display_fp"] == f["fp"]), 140) + points(f["exact"] & (f["slug_fp"] == f["fp"]), 130)
    made = made + points(either_starts(f["fp"], f["display_fp"]), 70) + points(either_starts(f["fp"], f["slug_fp"]), 70)
    return made + F.floor(similarity_display * 120) + F.floor(similarity_slug * 90) + tokens + points(exchange == "NSE", 8)


def token_matches(a: Column, b: Column) -> Column:
    """Equal, a prefix of three or more letters either way, or a known abbreviation."""
    short = F.create_map(*[F.lit(x) for pair in V.TRACKER_ABBREVIATIONS.items() for x in pair])
    return (a == b) | ((F.length(a) >= 3) & b.startswith(a)) | ((F.length(b) >= 3) & a.startswith(b)) | F.coalesce(F.try_element_at(short, a) == b, F.lit(False))
