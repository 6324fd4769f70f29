"""Names, keys and quotes as Column expressions (STR1-STR22); all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .udfs import let

#: White space as in Unicode, which plain \s and trim leave out.
SPACE = r"(?U)\s+"


def strip(c: Column, chars: str = r"\s") -> Column:
    """Cuts a class of characters off both ends."""
    return F.regexp_replace(c, f"(?U)^[{chars}]+|[{chars}]+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def slugify(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as hyphens; `unknown` if nothing is left."""
    made = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("unknown"))


def name_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def phrase_key(c: Column) -> Column:
    """As name_key, with `&` read as a word."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def name_tokens(c: Column) -> Column:
    equivalents = F.create_map(*[F.lit(x) for pair in V.TOKEN_EQUIVALENTS.items() for x in pair])
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(found, lambda t: F.coalesce(F.try_element_at(equivalents, t), t))


def strip_suffixes(joined: Column, suffixes: list[str]) -> Column:
    """Drops suffix words at the end of a space-joined key, as long as there is one."""
    return F.regexp_replace(joined, f"(?:(?:^| )(?:{'|'.join(suffixes)}))+$", "")


def company_key(c: Column) -> Column:
    """Tokens with an acronym at the very end written out, then without legal suffixes; also the key of rules."""
    joined = F.array_join(name_tokens(c), " ")
    for short, full in V.ACRONYM_EXPANSIONS.items():
        joined = F.regexp_replace(joined, f"(^| ){short}$", f"$1{full}")
    return strip_suffixes(joined, V.LEGAL_SUFFIXES)


def words_of(key: Column) -> Column:
    """Words of a space-joined key; none for an empty one."""
    return F.filter(F.split(key, " "), lambda t: t != "")


def initialism_tokens(c: Column) -> Column:
    return words_of(strip_suffixes(F.array_join(name_tokens(c), " "), V.INITIALISM_SUFFIXES))


def lookup_tokens(c: Column) -> Column:
    stop = F.array(*[F.lit(x) for x in V.LOOKUP_STOP_WORDS])
    return F.filter(F.split(phrase_key(c), " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def tracker_key(c: Column) -> Column:
    """Key of the coverage tracker: `&` is part of words, its own suffix list."""
    joined = F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9&]+"), F.lit(0)), " ")
    return strip_suffixes(joined, V.TRACKER_SUFFIXES)


def tracker_tokens(c: Column) -> Column:
    """Distinct words without stop words and suffixes, wherever they stand."""
    out = F.array(*[F.lit(x) for x in [*V.TRACKER_STOP_WORDS, *V.TRACKER_SUFFIXES]])
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9&]+"), F.lit(0)), lambda t: ~F.array_contains(out, t)))


def company_name(c: Column) -> Column:
    """A heading's name: cut at dashes and bars, and without a bracket at its end."""
    made = strip(c)
    for mark in (" — ", " - ", " | "):
        made = strip(F.split_part(made, F.lit(mark), F.lit(1)))
    return strip(F.regexp_replace(made, r"(?U)\s*\([^)]*\)\s*$", ""))


def heading_parts(c: Column) -> Column:
    """struct(name, hint) of `name | ... | hint`."""

    def of(whole: Column, parts: Column) -> Column:
        barred = whole.contains("|") & (F.size(parts) > 0)
        hint = F.when(barred & (F.size(parts) >= 2), F.element_at(parts, -1))
        return F.struct(company_name(F.when(barred, F.get(parts, F.lit(0))).otherwise(whole)).alias("name"), hint.alias("hint"))

    return let(collapse(c), lambda whole: let(F.filter(F.transform(F.split(whole, r"\|"), lambda p: strip(p)), lambda p: p != ""), lambda parts: of(whole, parts)))


QUOTES = '"“”'


def unquote(c: Column) -> Column:
    return strip(strip(strip(c), QUOTES))


def looks_like_speaker(c: Column) -> Column:
    """3 to 90 characters with a letter, no per cent, one digit at most; a title, a comma, or up to six capitalised words."""

    def plausible(x: Column) -> Column:
        titled = F.lower(x).rlike(f"^(?:{'|'.join(V.SPEAKER_TITLES)})")
        named = let(F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z.&']*"), F.lit(0)), lambda words: F.size(words).between(1, 6) & F.forall(words, lambda w: w.rlike("^[A-Z]")))
        plain = F.length(x).between(3, 90) & ~x.contains("%") & x.rlike("[A-Za-z]") & (F.length(F.regexp_replace(x, r"\D", "")) <= 1)
        return plain & (titled | x.contains(",") | named)

    return let(unquote(c), plausible)


def quote_and_speaker(c: Column) -> Column:
    """struct(quote, speaker): split at the first spaced dash, else at a dash behind a closing quote, if a speaker follows."""

    def split(x: Column, pattern: str, other: Column) -> Column:
        both = F.struct(unquote(F.regexp_extract(x, pattern, 1)).alias("quote"), unquote(F.regexp_extract(x, pattern, 2)).alias("speaker"))
        return let(both, lambda p: F.when((p["quote"] != "") & (p["speaker"] != "") & looks_like_speaker(p["speaker"]), p).otherwise(other))

    def made(x: Column) -> Column:
        whole = F.struct(strip(x, QUOTES).alias("quote"), F.lit(None).cast("string").alias("speaker"))
        return split(x, "^(.+?)\\s+[–—-]\\s+(.+)$", split(x, '^(.+?[”"])\\s*[–—-]\\s*(.+)$', whole))

    return let(strip(c), made)


def is_speaker_line(c: Column) -> Column:
    x = strip(c)
    return (x != "") & (F.length(x) <= 80) & (x.rlike("^[-–—]") | F.lower(x).rlike(f"^(?:{'|'.join(V.SPEAKER_TITLES)})"))


def is_direct_quote(c: Column) -> Column:
    x = strip(c)
    return (F.length(x) >= 25) & x.rlike("^(?:[“\"‘'…]|\\.\\.\\.)")


def title_from_path(path: Column) -> Column:
    return F.initcap(F.trim(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit(" "))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def full_initialism(short: Column, long: Column) -> Column:
    ignored = F.array(*[F.lit(x) for x in V.INITIALISM_IGNORED])
    word = F.get(short, F.lit(0))
    made = initials(F.filter(long, lambda t: ~F.array_contains(ignored, t)))
    return F.coalesce((F.size(short) == 1) & (F.size(long) >= 2) & (F.length(word) >= 2) & (word == made), F.lit(False))


def trailing_initialism(short: Column, long: Column) -> Column:
    """All words but the last are the long name's first words; the last has the initials of the two or more that follow."""
    n = F.size(short)
    rest = F.slice(long, n, F.greatest(F.size(long) - n + 1, F.lit(0)))
    head = F.slice(short, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(long, F.lit(1), F.greatest(n - 1, F.lit(0)))
    last = F.element_at(short, -1)
    return F.when((n >= 1) & (F.size(long) >= n + 1), head & (F.length(last) >= 2) & (last == initials(rest)) & (last != F.get(long, n - 1))).otherwise(F.lit(False))


def soft_extension(short: Column, long: Column) -> Column:
    soft = F.array(*[F.lit(x) for x in V.SOFT_WORDS])
    n = F.size(short)
    tail = F.slice(long, n + 1, F.greatest(F.size(long) - n, F.lit(0)))
    return (n > 0) & (F.size(long) > n) & (F.slice(long, F.lit(1), n) == short) & F.forall(tail, lambda t: F.array_contains(soft, t))


def has_legal_suffix(c: Column) -> Column:
    tokens = name_tokens(c)
    return F.coalesce(F.when(F.size(tokens) > 0, F.element_at(tokens, -1).isin(V.LEGAL_SUFFIXES)), F.lit(False))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """`{{ name }}` by values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{ " + name + " }}"), value)
    return template


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACE), lambda w: w != ""))


def content_hash(c: Column) -> Column:
    return F.sha1(c)
