"""Operator 9: quality rules as a short-circuit cascade.

The base rule asks for few words first, then for repeated ones; a count is made when a rule
first asks for it. Of the other rules, each is timed and tried on a bounded sample
of the documents; they then run in descending order of rejection per cost, and a document
leaves the cascade at its first rejection. The order never changes a verdict, only the time.

Null and empty texts have no words and fail the base rule. Very long texts are taken whole.
Equal doc_ids keep a row each. An empty table gives no rows and the rules' own order.
Columns other than doc_id and text are kept by `filter_documents` and left out elsewhere.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from copy import copy
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

#: Documents that are timed and tried for the order of the rules.
SAMPLE_DOCUMENTS = 400
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_SPACE_BYTES = _SPACE.encode()
_UPPER_WORD = re.compile(rb"(?<![^\x20\x09-\x0d])[^\x20\x09-\x0da-z]*[A-Z]{2}[^\x20\x09-\x0da-z]*(?![^\x20\x09-\x0d])")
_DIGITS = bytes(range(48, 58))
_LETTERS = bytes(sorted({*range(65, 91), *range(97, 123), *range(128, 256)}))


class Text:
    """A text, its UTF-8 bytes and words, and counts that are made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, _SPACE_BYTES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, _NOT_SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if not x.isspace() and x]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, n, covered = Counter(windows), 0, 0  # words before `covered` are counted
    for at, window in enumerate(windows):
        if found[window] > 1:
            n += at + 3 - max(at, covered)
            covered = at + 3
    return n


def too_long_or_short_words(x: Text) -> bool:
    return not 2.0 * x.n_words <= x.word_chars <= 14.0 * x.n_words


def too_many_symbols(x: Text) -> bool:
    return 5 * x.n_symbols > x.n_words


def too_many_repeated_lines(x: Text) -> bool:
    return 2 * x.n_dup_lines > x.raw.count(b"\n") + 1


def shouts(x: Text) -> bool:
    return 10 * sum(1 for _ in _UPPER_WORD.finditer(x.raw)) > 4 * x.n_words


def exclaims(x: Text) -> bool:
    return 5 * x.raw.count(b"!") > x.n_words


def few_letters(x: Text) -> bool:
    return 2 * (len(x.raw) - len(x.raw.translate(None, _LETTERS))) < x.word_chars


def many_digits(x: Text) -> bool:
    return 3 * (len(x.raw) - len(x.raw.translate(None, _DIGITS))) > x.word_chars


def few_different_words(x: Text) -> bool:
    """Of every run of 200 words, on average, under a quarter are different."""
    runs = [len(set(x.words[at : at + 200])) for at in range(0, x.n_words, 200)]
    return 4 * sum(runs) < x.n_words


RULES: dict[str, Callable[[Text], bool]] = {f.__name__: f for f in (too_long_or_short_words, too_many_symbols, too_many_repeated_lines, shouts, exclaims, few_letters, many_digits, few_different_words)}


def order_rules(texts: list[str | None], rules: dict[str, Callable[[Text], bool]] = RULES) -> list[str]:
    """Names by rejection per cost on the sample, the rules' own order between equals.

    A rule's selectivity is measured on what the base rule leaves; one document is added
    to each count of rejections, so that a rule without any is placed by its cost.
    """
    made = [x for x in map(Text, texts) if not x.base_failed]
    if not made:
        return list(rules)
    worth = {}
    for name, rule in rules.items():
        fresh = [copy(x) for x in made]  # each rule pays for the counts that it asks for
        began = time.perf_counter()
        rejected = sum(map(rule, fresh))
        worth[name] = (1 + rejected) / (len(made) + 1) / max(1e-9, time.perf_counter() - began)
    return sorted(rules, key=lambda name: -worth[name])


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCUMENTS) -> list[str | None]:
    """At most `n` texts of up to 100,000 characters, of the documents with the least hashes of doc_id; only the order of rules hangs on them.

    The least hashes are found without texts, so that tasks send numbers only.
    """
    h = F.xxhash64("doc_id")
    least = docs.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h").alias("h")).first().h
    if least is None:
        return []
    return [r.text for r in docs.where((h <= least) & (F.length("text") <= 100_000)).select("text").limit(n).collect()]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES) -> DataFrame:
    """Counts and verdicts; rejected_by is "base" or the first rule of the order to reject."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = order_rules(sample_texts(docs), rules)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        cascade, columns = [(x, rules[x]) for x in order], [[] for _ in names[1:]]
        for value in batch.column("text"):
            x = Text(value.as_py())
            by = "base" if x.base_failed else next((name for name, rule in cascade if rule(x)), None)
            for column, made in zip(columns, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, by is None, by), strict=True):
                column.append(made)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return arrow_map(docs, over, SCHEMA)


def filter_documents(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES) -> DataFrame:
    """The documents that are kept, with all their columns, in one pass over the table."""
    order = order_rules(sample_texts(docs), rules)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        cascade, kept = [rules[x] for x in order], []
        for value in batch.column("text"):
            x = Text(value.as_py())
            kept.append(not x.base_failed and not any(rule(x) for rule in cascade))
        return batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(lambda batches: map(over, batches), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule rejects first hangs on measured times, so `rejected_by` stays out of the query's rows."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


#: n_repeat_words: words covered by a window of three words that occurs at least twice.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w),
g2 AS (SELECT doc_id, i, list_extract(words, i) || ' ' || list_extract(words, i + 1) || ' ' || list_extract(words, i + 2) AS k FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g2),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, text, words, lines, len(words) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             list_sum(list_transform(generate_series(1, len(words), 200), lambda a: len(list_distinct(list_slice(words, a, a + 199))))) AS different
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 5 * n_symbols <= n_words
       AND 2 * n_dup_lines <= length(text) - length(replace(text, chr(10), '')) + 1
       AND 10 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]{2}') AND NOT regexp_matches(x, '[a-z]'))) <= 4 * n_words
       AND 5 * (length(text) - length(replace(text, '!', ''))) <= n_words
       AND 2 * strlen(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) >= word_chars
       AND 3 * length(regexp_replace(text, '[^0-9]+', '', 'g')) <= word_chars
       AND 4 * different >= n_words AS kept
FROM f
"""
