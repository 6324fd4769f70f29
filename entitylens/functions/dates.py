"""Dates (DT1-DT8); `today` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """`YYYY-MM-DD` of an ISO date or time, else an empty string."""
    return F.coalesce(F.date_format(F.try_to_date(F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1), "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def _labelled(c: Column, pattern: str, missing: str) -> Column:
    day = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(missing)).otherwise(F.coalesce(F.date_format(day, pattern), c))


def month_label(c: Column) -> Column:
    return _labelled(c, "MMM''yy", "Unknown")


def story_label(c: Column) -> Column:
    return _labelled(c, "dd MMM yyyy", "Unknown date")


def relative_label(day: Column, today: Column) -> Column:
    n = F.greatest(F.datediff(today, day), F.lit(0))
    return F.when(n == 0, F.lit("today")).when(n == 1, F.lit("1 day ago")).otherwise(F.concat(n.cast("string"), F.lit(" days ago")))


def in_window(c: Column, begin: Column, end: Column) -> Column:
    return F.coalesce((c != "") & c.between(begin, end), F.lit(False))


def month_start(c: Column) -> Column:
    """`Jan 2026` as the first of that month."""
    return F.date_format(F.try_to_date(F.concat(F.lit("01 "), F.initcap(c)), "dd MMM yyyy"), "yyyy-MM-dd")


def span_label(first: Column, last: Column) -> Column:
    a, b = month_label(first), month_label(last)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" – "), b))


def active_quarter(today: Column, begin: Column, end: Column, deadline: Column) -> Column:
    """In its window, or behind it and not past its deadline."""
    return F.coalesce(today.between(begin, end) | ((end < today) & (F.coalesce(deadline, F.lit("")) != "") & (today <= deadline)), F.lit(False))


def now_iso() -> Column:
    """Now in UTC to the second; keep it out of rows that are compared."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
