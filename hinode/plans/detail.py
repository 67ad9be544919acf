"""One security's page as one row: master, features as of its last bar, and its recent bars, filings and dates ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinode.operators.fundamentals import financial_features
from hinode.operators.prices import rolling_features

#: Fixed: how many recent bars and filings, and dates ahead, a page has.
BARS, FILINGS, AHEAD = 260, 20, 5


def _recent(rows: DataFrame, date: str, n: int, name: str, ahead: bool = False) -> DataFrame:
    """code and an array of each code's last (or first) n rows, in order of date."""
    order = [F.col(date).asc() if ahead else F.col(date).desc(), F.struct(*[c for c in rows.columns if c != date])]
    some = rows.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    packed = F.struct(F.col(date), *[c for c in some.columns if c not in (date, "code")])
    return some.groupBy("code").agg(F.sort_array(F.collect_list(packed)).alias(name))


def stock_detail(companies: DataFrame, prices: DataFrame, filings: DataFrame, earnings: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """A row of each company that has bars: its master row, as_of (the date of its last bar), price and financial features
    known then, and arrays of the last bars, the last filings, and the earnings dates from as_of on."""
    features = rolling_features(prices, index).where("next_date IS NULL").drop("next_date").withColumnRenamed("date", "as_of")
    dates = features.select("code", "as_of")
    financial = financial_features(filings, dates)
    coming = earnings.join(dates, "code").where(F.col("date") >= F.col("as_of")).drop("as_of")
    rows = companies.join(features, "code").join(financial, ["as_of", "code"], "left")
    rows = rows.join(_recent(prices, "date", BARS, "bars"), "code")
    rows = rows.join(_recent(filings, "disclosure_date", FILINGS, "filings"), "code", "left")
    return rows.join(_recent(coming, "date", AHEAD, "ahead", ahead=True), "code", "left")
