"""Price features: rolling columns over each security's sessions, computed once and picked as of any date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import ratio
from hinode.operators.trailing import trailing

SESSIONS_52W, SESSIONS_6M = 252, 126
LEAST_SESSIONS = 30


def by_code():
    return Window.partitionBy("code").orderBy("date")


def rolling_features(prices: DataFrame, index: DataFrame | None = None, as_of: DataFrame | None = None) -> DataFrame:
    """A row per bar with its trailing features; every window is over the one ordering by (code, date).

    index: date and index_close; a row for each day of the calendar, so that it is broadcast and bars stay dealt by code.
    as_of: a few dates (column as_of); then only bars that stand on one of them are returned, measured over all bars.
    """
    w = by_code()
    rows = prices.join(F.broadcast(index), "date", "left") if index is not None else prices.withColumn("index_close", F.lit(None).cast("double"))
    c = lambda name: F.col(name).cast("double").alias(name)
    rows = rows.select("code", "date", *[c(n) for n in ("close", "high", "low", "volume", "turnover", "index_close")])
    rows = rows.withColumns({"session_no": F.row_number().over(w), "change": F.col("close") / F.lag("close").over(w) - 1.0, "next_date": F.lead("date").over(w)})
    rows = rows.withColumns({"_range": ratio(F.col("high") - F.col("low"), F.col("close")), "_move": F.abs("change")})
    if as_of is not None:
        days = as_of.agg(F.collect_set("as_of").alias("days")).scalar()
        rows = rows.withColumn("_days", days).withColumn("_asked", F.exists("_days", _stands)).drop("_days")
    rows = trailing(rows, "code", "date", "session_no", {
        "high_52w": ("max", "high", SESSIONS_52W), "_start": ("oldest", "close", SESSIONS_6M),
        "_first_index": ("first", "index_close", SESSIONS_6M), "_last_index": ("last", "index_close", SESSIONS_6M), "_indexed": ("count", "index_close", SESSIONS_6M),
        "changes_60": ("count", "change", 60), "sd_60": ("sd", "change", 60),
        "average_intraday_range_20d": ("avg", "_range", 20), "average_absolute_return_20d": ("avg", "_move", 20), "average_turnover_20d": ("avg", "turnover", 20),
    }, None if as_of is None else "_asked")
    rows = rows.select(
        "code", "date", "close", "high", "low", "volume", "turnover", "session_no", "change", "high_52w",
        F.when(F.col("session_no") > 1, F.col("close") / F.col("_start") - 1.0).alias("return_6m"),
        F.when((F.col("_indexed") >= 2) & (F.col("_first_index") > 0), F.col("_last_index") / F.col("_first_index") - 1.0).alias("index_return_6m"),
        "changes_60", "sd_60", "average_intraday_range_20d", "average_absolute_return_20d", "average_turnover_20d", "next_date",
    )
    return (
        rows.withColumn("drawdown_52w", F.when(F.col("high_52w") > 0, F.col("close") / F.col("high_52w") - 1.0))
        .withColumn("volatility_60d", F.when(F.col("changes_60") >= 20, F.col("sd_60") * F.sqrt(F.lit(252.0))))
        .withColumn("relative_return_6m", F.col("return_6m") - F.col("index_return_6m"))
        .withColumn("benchmark_source", F.when(F.col("relative_return_6m").isNotNull(), "index").otherwise("none"))
        .drop("sd_60", "changes_60")
    )


def _stands(day: Column) -> Column:
    """Whether a row stands on a day, by the span until its security's next row."""
    return (F.col("date") <= day) & (F.col("next_date").isNull() | (F.col("next_date") > day))


def pick_as_of(rows: DataFrame, as_of: DataFrame) -> DataFrame:
    """The row of each security that stands on each date of as_of (column as_of), by the span until its next row."""
    return rows.join(F.broadcast(as_of), _stands(F.col("as_of"))).drop("next_date")  # replay dates: a dozen rows


def price_features(prices: DataFrame, as_of: DataFrame, index: DataFrame | None = None, least: int = LEAST_SESSIONS) -> DataFrame:
    """One row per (as_of, code) with at least `least` sessions up to then. Bars after the last date aren't read."""
    prices = prices.where(F.col("date") <= as_of.agg(F.max("as_of").alias("last")).scalar())
    return pick_as_of(rolling_features(prices, index, as_of), as_of).where(F.col("session_no") >= least)


def trend_indicators(prices: DataFrame) -> DataFrame:
    """A row per bar: moving averages, RSI, ranges, returns, the trend score and its state."""
    w = by_code()
    full = lambda n, c: F.when(F.col("session_no") >= n, c)
    close, delta = F.col("close"), F.col("delta")
    rows = prices.where("close IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in ("close", "volume")})
    rows = rows.withColumns({"session_no": F.row_number().over(w), "delta": close - F.lag("close").over(w), "next_date": F.lead("date").over(w)})
    rows = rows.withColumns({"_gain": F.greatest(delta, F.lit(0.0)), "_loss": F.greatest(-delta, F.lit(0.0))})
    sessions = (20, 50, 200)
    rows = trailing(rows, "code", "date", "session_no", {
        **{f"sma{n}": ("avg", "close", n) for n in sessions}, "gain14": ("avg", "_gain", 14), "loss14": ("avg", "_loss", 14),
        "sma20_before": ("ago", "sma20", 5), "sma50_before": ("ago", "sma50", 10), "_close_20": ("ago", "close", 20), "_close_60": ("ago", "close", 60),
        **{f"{name}{n}": (kind, "close", n) for n in (20, 60) for name, kind in (("high", "max"), ("low", "min"))}, "_volume": ("avg", "volume", 20),
    })
    # averages and ranges count from the session on that fills them
    whole = {**{f"sma{n}": n for n in sessions}, "sma20_before": 25, "sma50_before": 60, **{f"{name}{n}": n for n in (20, 60) for name in ("high", "low")}}
    rows = rows.withColumns({
        **{name: full(n, F.col(name)) for name, n in whole.items()},
        "rsi14": F.when((F.col("session_no") >= 15) & (F.col("loss14") > 0), 100.0 - 100.0 / (1.0 + F.col("gain14") / F.col("loss14"))),
        "return_20d": close / F.col("_close_20") - 1.0,
        "return_60d": close / F.col("_close_60") - 1.0,
        "volume_ratio_20d": full(20, F.when(F.col("_volume") > 0, F.col("volume") / F.col("_volume"))),
    }).drop("_gain", "_loss", "_close_20", "_close_60", "_volume")
    above = lambda a, b: F.when(a > b, 1).when(a <= b, -1).otherwise(0)
    c = F.col
    score = (
        above(close, c("sma20")) + above(close, c("sma50")) + above(close, c("sma200")) + above(c("sma20"), c("sma50")) + above(c("sma20"), c("sma20_before"))
        + F.when(c("return_20d") > 0, 1).when(c("return_20d") < -0.10, -1).otherwise(0)
        + F.when(c("rsi14").between(40, 65), 1).when(c("rsi14") >= 75, -1).otherwise(0)
        + F.when(close >= c("high20") * 0.995, 1).otherwise(0)
        + F.when(close <= c("low20") * 1.005, -1).otherwise(0)
    )
    rows = rows.withColumn("trend_score", score)
    s = c("trend_score")
    state = F.when(s >= 5, "uptrend").when(s >= 2, "turning up").when(s <= -5, "clear downtrend").when(s <= -2, "downtrend").otherwise("no direction")
    rising = lambda a, b: F.coalesce(c(a) > c(b), F.lit(False))
    return rows.withColumn("trend_state", state).withColumn("sma20_rising", rising("sma20", "sma20_before")).withColumn("sma50_rising", rising("sma50", "sma50_before"))


def with_before(indicators: DataFrame, days: int = 90) -> DataFrame:
    """indicators with _before, a struct of date, trend_score and trend_state of the security's last bar at least `days`
    calendar days before; null where there is none. The frame only grows along the ordering, so a bar is met once."""
    day = F.unix_date(F.col("date").cast("date"))
    w = Window.partitionBy("code").orderBy(day).rangeBetween(Window.unboundedPreceding, -days)
    then = F.when(F.col("date").isNotNull(), F.struct("date", "trend_score", "trend_state"))
    return indicators.withColumn("_before", F.when(F.col("code").isNotNull() & day.isNotNull(), F.max(then).over(w)))


def trend_transition(indicators: DataFrame, as_of: DataFrame, days: int = 90) -> DataFrame:
    """Trend now and about `days` calendar days before the security's last bar, with the change of score."""
    now = pick_as_of(with_before(indicators, days), as_of).withColumnsRenamed({"date": "now_date", "trend_score": "score_now", "trend_state": "state_now"})
    change = F.col("score_now") - F.col("_before.trend_score")
    kind = F.when(change.isNull(), "unknown").when(change >= 3, "improving").when(change <= -3, "worsening").otherwise("steady")
    before = [F.col("_before.date").alias("before_date"), F.col("_before.trend_score").alias("score_before"), F.col("_before.trend_state").alias("state_before")]
    return now.select("as_of", "code", "now_date", "score_now", "state_now", *before, change.alias("score_change"), kind.alias("transition"))
