"""Coverage tracker: name cascade, filings, votes, first coverage and quarter states (JOIN9, JOIN10, JOIN12, AGG3-AGG6, AGG12, WND1, TRK1-TRK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions import similarity as S
from ..functions import vocabulary as V
from .relational import dealt, keep_best


def auto_acronyms(universe: DataFrame) -> DataFrame:
    """universe (symbol, name) -> (acronym, symbol): initials of two or more significant words, if of one symbol only."""
    skip = F.array(*[F.lit(x) for x in [*V.TRACKER_STOP_WORDS, "india"]])
    tokens = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~F.array_contains(skip, t))
    made = universe.withColumn("_t", tokens).where(F.size("_t") >= 2).select("symbol", F.upper(text.initials(F.col("_t"))).alias("acronym"))
    return made.groupBy("acronym").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").drop("n")


def partial_matches(names: DataFrame, universe: DataFrame) -> DataFrame:
    """(name, symbol): all of two or more words of the name match words of a universe name; the tightest one, none if two are equally tight.

    Words meet on their first three letters, on equality, or on an abbreviation's full form,
    which covers every way in which they can match.
    """
    def keyed(df, column, own):
        t = df.withColumn("_t", text.tracker_tokens(F.col(column)))
        return t.withColumn("n", F.size("_t")).withColumn("tok", F.explode("_t")).drop("_t") if own else t

    short = F.create_map(*[F.lit(x) for pair in V.TRACKER_ABBREVIATIONS.items() for x in pair])
    left = keyed(names.select("name").distinct(), "name", True).where("n >= 2")
    keys = F.array_distinct(F.array_compact(F.array(F.substring("tok", 1, 3), F.substring(F.try_element_at(short, F.col("tok")), 1, 3))))
    left = left.withColumn("block", F.explode(keys))
    right = keyed(universe.select("symbol", F.col("name").alias("uname")), "uname", True).select("symbol", F.col("n").alias("un"), F.col("tok").alias("utok"), F.substring("tok", 1, 3).alias("block"))
    hits = left.join(right, "block").where(S.token_matches(F.col("tok"), F.col("utok")))
    full = hits.groupBy("name", "n", "symbol", "un").agg(F.count_distinct("tok").alias("hit")).where("hit = n").withColumn("extra", F.col("un") - F.col("n"))
    best = full.withColumn("least", F.min("extra").over(Window.partitionBy("name"))).where("extra = least")
    return best.groupBy("name").agg(F.count("*").alias("c"), F.min("symbol").alias("symbol")).where("c = 1").drop("c")


def resolve_symbols(names: DataFrame, universe: DataFrame, aliases: DataFrame, acronyms: DataFrame) -> DataFrame:
    """(name, symbol, layer) by the first layer that hits: symbol, alias, written-out acronym, equal name, acronym of initials, partial words.

    universe: ord, symbol, name. aliases: alias (lower case), symbol. acronyms: acronym, full_name.
    """
    n = names.select("name").distinct().withColumn("_x", text.strip(F.col("name")))
    keyed = universe.select("ord", "symbol", text.tracker_key(F.col("name")).alias("_key"))
    first = keep_best(keyed.where("_key <> ''"), ["_key"], [F.col("ord")]).select("_key", "symbol")
    layers = [
        n.join(universe.select("symbol"), F.upper("_x") == F.col("symbol")),
        n.join(aliases.join(universe.select("symbol"), "symbol", "left_semi"), F.lower("_x") == F.col("alias")),
        n.join(acronyms.select("acronym", text.tracker_key(F.col("full_name")).alias("_key")).join(first, "_key"), F.upper("_x") == F.col("acronym")),
        n.withColumn("_key", text.tracker_key(F.col("_x"))).where("_key <> ''").join(first, "_key"),
        n.join(auto_acronyms(universe), F.upper("_x") == F.col("acronym")).where(text.tracker_key(F.col("_x")) != ""),
        n.join(partial_matches(n.select(F.col("_x").alias("name")).distinct(), universe).select(F.col("name").alias("_p"), "symbol"), F.col("_x") == F.col("_p")).where(text.tracker_key(F.col("_x")) != ""),
    ]
    hits = None
    for i, df in enumerate(layers, 1):
        one = df.select("name", "symbol", F.lit(i).alias("layer"))
        hits = one if hits is None else hits.union(one)
    return keep_best(hits, ["name"], [F.col("layer"), F.col("symbol")])


def first_filings(filings: DataFrame, presentation: str = r"investor\s*presentation|presentation", transcript: str = r"transcript|earnings\s*call") -> DataFrame:
    """filings (code, category, day) -> (code, presentation_date, transcript_date); at least one is known."""
    def least(pattern: str) -> Column:
        return F.min(F.when(F.col("category").rlike("(?i)" + pattern), F.col("day")))

    return filings.groupBy("code").agg(least(presentation).alias("presentation_date"), least(transcript).alias("transcript_date")).where("presentation_date IS NOT NULL OR transcript_date IS NOT NULL")


def eligibility(universe: DataFrame, filings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(symbol, transcript_since, presentation_since): a transcript page counts before a filing (TRK2).

    universe: symbol, code. filings: code, presentation_date, transcript_date. transcripts: symbol, first_day.
    """
    made = universe.select("symbol", "code").join(filings, "code", "left").join(transcripts, "symbol", "left")
    made = made.select("symbol", F.coalesce("first_day", "transcript_date").alias("transcript_since"), F.col("presentation_date").alias("presentation_since"))
    return made.where("transcript_since IS NOT NULL OR presentation_since IS NOT NULL")


def unmatched(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """Names that no layer resolves, a queue for people to look at."""
    return names.select("name").distinct().join(resolved.select("name"), "name", "left_anti")


def first_in_window(events: DataFrame, key: str, day: str, begin: str, end: str) -> DataFrame:
    return events.where(F.col(day).between(begin, end)).groupBy(key).agg(F.min(day).alias("first_day"))


def active_quarters(quarters: DataFrame, today: str) -> DataFrame:
    """quarters (name, begin, end, deadline) that are open or still to be covered, by the beginning of their window."""
    return quarters.where(dates.active_quarter(F.lit(today), F.col("begin"), F.col("end"), F.col("deadline")))


def edition_quarters(edition_symbols: DataFrame, eligible: DataFrame) -> DataFrame:
    """(edition, quarter): where most of its symbols are eligible; of equals, the quarter that got a vote first.

    edition_symbols: edition, ord, symbol. eligible: quarter, quarter_ord, symbol.
    """
    # Hardly two votes of an edition meet before they are dealt out by it: sums made there would hold every row.
    cast = dealt(edition_symbols.join(eligible, "symbol").select("edition", "quarter", "quarter_ord", "ord"), "edition", times=8)
    votes = cast.groupBy("edition", "quarter", "quarter_ord").agg(F.count("*").alias("votes"), F.min("ord").alias("first"))
    return keep_best(votes, ["edition"], [F.desc("votes"), F.col("first"), F.col("quarter_ord")]).select("edition", "quarter", "votes")


def first_coverage(edition_symbols: DataFrame, eligible: DataFrame) -> DataFrame:
    """(quarter, symbol, edition): the first edition by address, not by date, of each eligible symbol."""
    q = edition_quarters(edition_symbols, eligible).select("edition", "quarter")
    rows = dealt(edition_symbols.join(q, "edition").select("quarter", "symbol", "edition"), "quarter", "symbol", times=8)
    # The first editions first: fewer rows are sorted for the join.
    first = rows.groupBy("quarter", "symbol").agg(F.min("edition").alias("edition"))
    return first.join(eligible.select("quarter", "symbol").distinct(), ["quarter", "symbol"], "left_semi")


def window_coverage(edition_symbols: DataFrame, editions: DataFrame, begin: str, end: str) -> DataFrame:
    """(symbol, edition): the first edition by address of each symbol among those dated in one window (WND1b).

    edition_symbols: edition, symbol. editions: edition, day.
    """
    inside = editions.where(dates.in_window(F.col("day"), F.lit(begin), F.lit(end))).select("edition")
    return edition_symbols.join(inside, "edition", "left_semi").groupBy("symbol").agg(F.min("edition").alias("edition"))


def quarter_state(universe: DataFrame, eligibility: DataFrame, covered: DataFrame, previous: DataFrame, feed: str) -> DataFrame:
    """Eligible and covered state of every symbol for one feed; a date once known stays.

    eligibility: symbol, since. covered: symbol, edition, day. previous: symbol, since.
    """
    made = universe.select("symbol", "name").join(eligibility.select("symbol", F.col("since").alias("_new")), "symbol", "left")
    made = made.join(previous.select("symbol", F.col("since").alias("_old")), "symbol", "left").join(covered.select("symbol", "edition", F.col("day").alias("_day")), "symbol", "left")
    since = F.coalesce("_new", "_old")
    return made.select("symbol", "name", since.isNotNull().alias(f"{feed}_eligible"), since.alias(f"{feed}_since"), F.col("edition").isNotNull().alias(f"{feed}_covered"), F.col("edition").alias(f"{feed}_edition"), F.col("_day").alias(f"{feed}_day"))


def state_summary(state: DataFrame, feeds: list[str]) -> DataFrame:
    counts = [F.count_if(F.col(f"{f}_{x}")).alias(f"{f}_{x}") for f in feeds for x in ("eligible", "covered")]
    return state.groupBy("quarter").agg(F.count("*").alias("total_companies"), *counts)


def primary_quarters(summary: DataFrame, quarters: DataFrame, today: str) -> DataFrame:
    """Every ended quarter with work left is primary; if there is none, the current one (TRK4)."""
    made = summary.join(quarters.select(F.col("name").alias("quarter"), "end"), "quarter")
    left = (F.col("transcript_eligible") > F.col("transcript_covered")) | (F.col("presentation_eligible") > F.col("presentation_covered"))
    made = made.withColumn("_pending", (F.col("end") < today) & left)
    none = ~F.max("_pending").over(Window.partitionBy())
    return made.withColumn("is_primary", F.col("_pending") | (none & (F.col("end") >= today))).drop("_pending", "end")
