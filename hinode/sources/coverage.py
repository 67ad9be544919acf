"""What a store lacks against a calendar, as ranges of days to fetch, and the window that a plan's answer allows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinode.operators.asof import as_of_merge

#: Fixed: how the vendor names the dates of a subscription.
COVERS = re.compile(r"subscription\s+covers\s+the\s+following\s+dates:\s*(\d{4}-\d{2}-\d{2})\s*[~～]\s*(\d{4}-\d{2}-\d{2})", re.IGNORECASE)


@dataclass(frozen=True)
class FetchWindow:
    """The window that is fetched: prices from and to, filings from; and what was changed."""

    price_start: str
    price_end: str
    financial_start: str
    notes: tuple[str, ...] = ()


def resolve_window(message: str | None, price_start: str, price_end: str, financial_start: str) -> FetchWindow:
    """A requested window within the dates that the vendor's answer names; without such an answer as it was requested.

    An answer that names no dates is an error, and so is a window wholly outside of them. Filings begin no later than the
    prices end.
    """
    if message is None:
        return FetchWindow(price_start, price_end, financial_start)
    named = COVERS.search(message)
    if not named:
        raise ValueError("the answer names no dates")
    low, high = named.groups()
    if price_end < low or price_start > high:
        raise ValueError(f"the window doesn't overlap {low} to {high}")
    clamp = lambda day: min(max(day, low), high)
    start, end = clamp(price_start), clamp(price_end)
    filings = min(clamp(financial_start), end)
    asked = (("price start", price_start, start), ("price end", price_end, end), ("financial start", financial_start, filings))
    return FetchWindow(start, end, filings, tuple(f"{what} {a} became {b}" for what, a, b in asked if a != b))


def missing_ranges(present: DataFrame, calendar: DataFrame, key: list[str], windows: DataFrame | None = None) -> DataFrame:
    """key, first_day, last_day, days: the longest runs of calendar days without a row, for each key.

    present: key and date; calendar: date, a row for each expected day. windows (key, start, end) are the days wanted of
    each key, by default from its first to its last row; a key of windows without any row lacks all of it. Days outside
    the calendar don't count. The calendar isn't multiplied by the keys: rows are numbered by it, and a jump in the numbers
    of neighbouring rows is a gap.
    """
    numbered = calendar.where("date IS NOT NULL").select("date").distinct()
    numbered = numbered.select("date", F.row_number().over(Window.orderBy("date")).alias("no"))  # a row for each day
    seen = present.where("date IS NOT NULL").select(*key, "date").distinct().join(numbered, "date").select(*key, "no")
    if windows is not None:
        spans = _numbered_windows(windows.select(*key, "start", "end"), numbered, key)
        seen = seen.join(spans, key).where("no BETWEEN low AND high").select(*key, "no")
        # a row before and one after the window stand for its ends
        ends = spans.select(*key, F.explode(F.array(F.col("low") - 1, F.col("high") + 1)).alias("no"))
        seen = seen.unionByName(ends)
    before = F.lag("no").over(Window.partitionBy(*key).orderBy("no"))
    gaps = seen.withColumn("before", before).where("no - before > 1")
    at = lambda name, no: numbered.select(F.col("date").alias(name), F.col("no").alias(no))
    found = gaps.select(*key, (F.col("before") + 1).alias("low"), (F.col("no") - 1).alias("high"))
    found = found.join(at("first_day", "low"), "low").join(at("last_day", "high"), "high")
    return found.select(*key, "first_day", "last_day", (F.col("high") - F.col("low") + 1).cast("long").alias("days"))


def _numbered_windows(windows: DataFrame, numbered: DataFrame, key: list[str]) -> DataFrame:
    """key, low, high: the numbers of a window's first and last calendar day; windows without one are left out.

    Only the distinct ends of windows are set against the calendar.
    """
    most = numbered.agg(F.coalesce(F.max("no"), F.lit(0)).alias("most"))  # one row
    calendar = numbered.withColumn("_all", F.lit(0))
    for end, name, forward in (("start", "low", True), ("end", "high", False)):
        days = windows.select(end).distinct().withColumn("_all", F.lit(0))
        found = as_of_merge(days, calendar, ["_all"], end, "date", forward=forward)
        windows = windows.join(found.select(end, F.col("_found.no").alias(name)), end)
    rows = windows.join(F.broadcast(most))
    rows = rows.withColumns({"low": F.coalesce("low", F.col("most") + 1), "high": F.coalesce("high", F.lit(0))})
    return rows.where("low <= high").select(*key, "low", "high")
