"""Filters on titles, headings and names (FLT1-FLT9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import name_key, phrase_key
from .udfs import let


def is_target_title(title: Column, include: str, exclude: list[str]) -> Column:
    low = F.lower(title)
    return reduce(lambda made, x: made & ~low.contains(x), exclude, low.contains(include))


def _words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def _is_edition(key: Column) -> Column:
    return key.rlike(r"^edition\s*\d+$") | let(_words(key), lambda words: F.array_contains(words, "edition") & (F.size(words) <= 4))


def is_edition_heading(c: Column) -> Column:
    return let(name_key(c), _is_edition)


def is_sector_like(c: Column) -> Column:
    known = F.array(*[F.lit(x) for x in V.SECTOR_WORDS])
    of_words = lambda words: (F.size(words) > 0) & (F.size(F.array_except(words, known)) == 0)
    return let(name_key(c), lambda key: (key != "") & (key.isin(V.SECTOR_HEADINGS) | _is_edition(key) | let(F.filter(_words(key), lambda w: w != "and"), of_words)))


def is_listable_sector(c: Column) -> Column:
    return is_sector_like(c) & ~is_edition_heading(c)


def plain_words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9&'.-]+"), F.lit(0)), F.lower)


def is_topic_or_sentence(c: Column) -> Column:
    hints = F.array(*[F.lit(x) for x in V.COMPANY_HINTS])

    def of(words: Column) -> Column:
        n, has_on = F.size(words), F.array_contains(words, "on")
        starts = F.coalesce(F.get(words, F.lit(0)).isin(V.SENTENCE_STARTS), F.lit(False)) & (n > 4)
        comments = F.array_join(words, " ").rlike(r"\bcomments?\s+on\b")
        about = has_on & (n >= 4) & ~F.arrays_overlap(words, hints)
        official = has_on & F.arrays_overlap(words, F.array(F.lit("minister"), F.lit("secretary")))
        return (n > 0) & (starts | comments | about | official)

    return let(plain_words(c), of)


def matches_rules(c: Column, exact_keys: list[str], patterns: list[str], allow_keys: list[str]) -> Column:
    """Allowed names first, then exact keys, then any pattern, whatever the case."""
    key = name_key(c)
    made = key.isin(exact_keys) if exact_keys else F.lit(False)
    for p in patterns:
        made = made | c.rlike("(?i)" + p)
    return (~key.isin(allow_keys) if allow_keys else F.lit(True)) & made


def is_probable_company(name: Column, has_listing: Column, exact_keys: list[str], patterns: list[str], allow_keys: list[str], own_titles: list[str] = ()) -> Column:
    """Vetoes in order; a listing URL settles it before the topic and rule checks."""
    low = F.lower(name)
    bad = F.lit(False)
    for x in own_titles:
        bad = bad | low.startswith(x)
    vetoed = (F.length(name) < 2) | name.rlike(r"(?i)^edition\s*#?\d+") | is_sector_like(name) | bad | name.rlike("[?!]") | (name.contains(":") & (F.size(plain_words(name)) > 4))
    return F.coalesce(~vetoed & (has_listing | ~(is_topic_or_sentence(name) | matches_rules(name, exact_keys, patterns, allow_keys))), F.lit(False))


def is_hard_break(c: Column) -> Column:
    key = phrase_key(c)
    return key.isin(V.HARD_BREAKS) | key.rlike(f"^(?:{'|'.join([*V.PROMO_PREFIXES, 'thank you for reading'])})")


def is_non_story_heading(c: Column, post_title: Column) -> Column:
    key = phrase_key(c)
    return (key == "") | (key == phrase_key(post_title)) | key.isin(V.NON_STORY_HEADINGS) | is_hard_break(c)


def is_usable_alias(c: Column) -> Column:
    return F.coalesce((F.length(c) >= 2) & ~c.rlike("^[0-9]+$"), F.lit(False))


