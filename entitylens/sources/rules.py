"""Rules: site settings, name rules, pairs and aliases, read from JSON into small tables or settings (SRC3, SRC13)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import company_key, phrase_key


@dataclass(frozen=True)
class SiteRules:
    """What is particular to a publication: its address, listing hosts and title patterns."""

    base_url: str = "https://news.example"
    listing_hosts: list[str] = field(default_factory=lambda: ["market.example"])
    title_include: str = "the digest"
    title_exclude: list[str] = field(default_factory=lambda: ["charts only"])
    generic_titles: list[str] = field(default_factory=lambda: ["the digest"])
    own_titles: list[str] = field(default_factory=lambda: ["the digest"])


def _key(x: str) -> str:
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip()


@dataclass(frozen=True)
class NameRules:
    """Names that are no companies: exact keys, patterns, and keys that are allowed all the same."""

    exact_keys: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    allow_keys: list[str] = field(default_factory=list)

    @staticmethod
    def parse(raw: object, strict: bool = True) -> "NameRules":
        """strict: wrong shapes and patterns raise; else they are left out."""
        lists = {x: raw.get(x, []) if isinstance(raw, dict) else None for x in ("exact_names", "name_patterns", "allow_names")}
        if strict and not all(isinstance(x, list) for x in lists.values()):
            raise ValueError("name rules need lists of exact_names, name_patterns and allow_names")
        exact, patterns, allow = ([str(x).strip() for x in (v if isinstance(v, list) else []) if str(x).strip()] for v in lists.values())
        good = []
        for p in patterns:
            try:
                re.compile(p)
                good.append(p)
            except re.error as e:
                if strict:
                    raise ValueError(f"invalid pattern: {p}") from e
        return NameRules([_key(x) for x in exact], good, [_key(x) for x in allow])


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text through Spark's own reader; None if there is none."""
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_json(spark: SparkSession, path: str, default: object = None) -> object:
    found = read_text(spark, path)
    return default if found is None else json.loads(found)


def read_table(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSON array of objects; an empty table if the file is missing. strict: malformed rows raise."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def rule_pairs(pairs: DataFrame) -> DataFrame:
    """(left, right) names -> distinct unordered pairs of keys (a < b); empty or equal keys are left out."""
    x, y = company_key(F.col("left")), company_key(F.col("right"))
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> '' AND a <> b").distinct()


def alias_rules(spark: SparkSession, raw: dict) -> dict[str, DataFrame]:
    """Tables company_aliases, alias_overrides, company_blocked (company_id, alias), blocked (alias) and strict (company_id)."""

    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    def keyed(df):
        return df.withColumn("alias", phrase_key(F.col("alias"))).where("alias <> ''").distinct()

    pairs = "company_id string, alias string"
    many = lambda name: [(c.strip(), str(a)) for c, xs in raw.get(name, {}).items() if c.strip() and isinstance(xs, list) for a in xs]
    return {
        "company_aliases": keyed(table(many("company_aliases"), pairs)),
        "alias_overrides": keyed(table([(c, a) for a, c in raw.get("alias_overrides", {}).items()], pairs)),
        "company_blocked": keyed(table(many("company_blocked_aliases"), pairs)),
        "blocked": keyed(table([(str(a),) for a in raw.get("blocked_aliases", [])], "alias string")),
        "strict": table([(str(c).strip(),) for c in raw.get("strict_companies", [])], "company_id string"),
    }
