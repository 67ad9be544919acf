"""Readiness checks, badge, entry zone and split plan as expressions over one row per security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinode.functions.scalars import passes

#: Fixed checks: key, column, weight, range that passes, range that warns (bounds inclusive, None open).
READINESS = (
    ("drawdown", "drawdown_52w", 12, (None, -0.20), (None, -0.12)),
    ("relative", "relative_return_6m", 8, (None, -0.08), (None, 0.0)),
    ("sales", "sales_cagr_3y", 10, (0.0, None), (-0.05, None)),
    ("margin", "operating_margin", 10, (0.05, None), (1e-300, None)),
    ("equity", "equity_ratio", 12, (0.40, None), (0.25, None)),
    ("ocf", "operating_cf_positive_ratio_3y", 12, (0.999, None), (0.66, None)),
    ("cash_quality", "cash_conversion_ratio", 8, (0.80, None), (0.50, None)),
    ("margin_stability", "operating_margin_change_3y", 6, (-0.02, None), (-0.05, None)),
    ("forecast_revision", "forecast_revision_rate", 8, (-0.05, None), (-0.15, None)),
    ("sector_relative", "sector_relative_return_6m", 6, (-0.10, None), (-0.20, None)),
    ("forecast", "forecast_op_growth", 10, (0.0, None), (-0.15, None)),
    ("dividend", "dividend_yield", 8, (0.025, 0.06), (1e-300, 0.08)),
    ("payout", "payout_ratio", 8, (None, 0.60), (None, 0.85)),
    ("div_change", "forecast_dividend_change_rate", 5, (0.0, None), (-0.10, None)),
    ("analyst", "target_upside", 5, (0.10, None), (-0.05, None)),
    ("trend", "trend_score", 12, (2.0, None), (-1.0, None)),
    ("momentum", "return_20d", 6, (0.0, 0.15), (-0.10, 0.25)),
    ("rsi", "rsi14", 5, (40.0, 65.0), (30.0, 74.999999999)),
    ("volume", "volume_ratio_20d", 4, (1.2, 3.0), (0.7, 3.999999999)),
)
CORE = ("sales", "margin", "equity", "ocf", "forecast", "payout", "div_change", "trend")
STRUCTURAL = ("cash_quality", "margin_stability", "forecast_revision", "sector_relative")
#: Fixed: the checks whose failure alone stops, and the scores from which a security is considered or researched.
HARD = ("equity", "ocf", "cash_quality", "margin_stability", "forecast_revision", "sector_relative", "forecast", "margin", "trend")
CONSIDER, RESEARCH = 75, 55
#: Fixed: the sources of a market comparison that count as one.
BENCHMARKS = ("index", "proxy")


def _within(x: Column, bounds: tuple) -> Column:
    low, high = bounds
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return ok


def readiness(rows: DataFrame, quote: Column | None = None) -> DataFrame:
    """checks (array of key, status, weight), evidence_score (0-100, half to even), failures and level.

    A check whose column is absent or null is unknown and has no weight. So is the comparison with the market where
    benchmark_source names none. The level is `stop` where a hard check fails; else `consider` from 75 points on with a
    quote at hand (`quote`, true unless given); else `research` from 55 on, and `stop` below. Other failures only cost
    points.
    """
    for _, name, *_ in READINESS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    compared = F.lit(True)
    if "benchmark_source" in rows.columns:
        source = F.coalesce("benchmark_source", F.lit(""))
        compared = (source == "") | source.isin(*BENCHMARKS)
    checks = []
    for key, name, weight, good, fair in READINESS:
        x = F.col(name).cast("double")
        unknown = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        if key == "relative":
            unknown = unknown | ~compared
        status = F.when(unknown, "unknown").when(_within(x, good), "pass").when(_within(x, fair), "warn").otherwise("fail")
        checks.append(F.struct(F.lit(key).alias("key"), status.alias("status"), F.lit(weight).alias("weight")))
    rows = rows.withColumn("checks", F.array(*checks))
    known = F.aggregate("checks", F.lit(0.0), lambda a, c: a + F.when(c["status"] != "unknown", c["weight"]).otherwise(0))
    points = lambda c: F.when(c["status"] == "pass", c["weight"]).when(c["status"] == "warn", c["weight"] * 0.5).otherwise(0.0)
    won = F.aggregate("checks", F.lit(0.0), lambda a, c: a + points(c))
    score = F.coalesce(F.bround(100.0 * won / F.nullif(known, F.lit(0.0))), F.lit(0.0)).cast("int")
    failed = F.filter("checks", lambda c: c["status"] == "fail")
    rows = rows.withColumns({"evidence_score": score, "failures": F.size(failed), "hard_failed": F.exists(failed, lambda c: c["key"].isin(*HARD))})
    quoted = F.lit(True) if quote is None else passes(quote)
    level = (
        F.when(F.col("hard_failed"), "stop")
        .when((F.col("evidence_score") >= CONSIDER) & quoted, "consider")
        .when(F.col("evidence_score") >= RESEARCH, "research")
        .otherwise("stop")
    )
    return rows.withColumn("level", level).drop("hard_failed")


def badge(rows: DataFrame) -> DataFrame:
    """legacy_star, reversal_star and badge of rows with readiness, trend columns and the score before (score_before)."""
    c = F.col
    of = lambda keys: F.filter("checks", lambda x: x["key"].isin(*keys))
    core = F.forall(of(CORE), lambda x: x["status"] == "pass") & F.forall(of(STRUCTURAL), lambda x: x["status"].isin("pass", "unknown"))
    legacy = passes((c("level") == "consider") & (c("evidence_score") >= 85) & (c("trend_score") >= 2) & core & (c("failures") == 0))
    gates = [c("trend_score") >= 5, c("return_20d") >= 0, c("close") > c("sma20"), c("sma20_rising"), c("sma20") > c("sma50")]
    rows = rows.withColumn("legacy_star", legacy).withColumn("reversal_star", legacy & F.forall(F.array(*[passes(g) for g in gates]), lambda x: x))
    escaped = passes((c("score_before") <= -2) & (c("trend_score") >= 0))
    strong = (c("level") == "consider") & (c("evidence_score") >= 75) & (escaped | passes(c("trend_score") >= 2))
    mark = F.when(strong & c("reversal_star"), "◎☆").when(strong, "◎").when(c("level") == "consider", "○").when(c("level") == "research", "△").otherwise("×")
    return rows.withColumn("escaped_downtrend", escaped).withColumn("badge", mark)


def entry_zone(rows: DataFrame) -> DataFrame:
    """Reference zone of prices to enter at, from the trend; null where there is no price."""
    c = F.col
    price, score, rsi = c("close"), F.coalesce("trend_score", F.lit(0)), c("rsi14")
    primary = F.coalesce(c("sma20"), c("sma50"), price * 0.95)
    secondary = F.coalesce(c("sma50"), c("low20"), price * 0.90)
    bottom = F.coalesce(c("low20"), c("low60"), secondary)
    upper = F.least(primary, price * 0.97)
    down, hot = score <= -2, passes(rsi >= 72)
    up = (score >= 2) | F.coalesce("escaped_downtrend", F.lit(False)) if "escaped_downtrend" in rows.columns else score >= 2
    pullback = F.coalesce(c("sma20"), price * 0.95)
    low = F.when(down, bottom * 0.98).when(hot, pullback * 0.98).when(up, primary * 0.98).otherwise(F.least(secondary, upper) * 0.98)
    high = F.when(down, bottom * 1.02).when(hot, pullback * 1.01).when(up, primary * 1.02).otherwise(F.greatest(secondary, upper) * 1.01)
    supports = F.slice(F.sort_array(F.array_distinct(F.filter(F.array("sma20", "sma50", "low20", "low60"), lambda v: (v > 0) & (v <= price * 1.10))), asc=False), 1, 4)
    return (
        rows.withColumn("zone_status", F.when(price > 0, F.when(down, "wait").when(hot, "wait for a dip").when(up, "enter in parts").otherwise("wait for a turn")).otherwise("no price"))
        .withColumn("zone_low", F.when(price > 0, F.greatest(F.lit(0.1), F.least(low, high))))
        .withColumn("zone_high", F.when(price > 0, F.greatest(low, high)))
        .withColumn("chase_limit", F.when(price > 0, F.when((score >= 2) & F.coalesce(rsi < 70, F.lit(True)), price * 1.03).otherwise(price)))
        .withColumn("reconsider_below", F.when(price > 0, F.coalesce(F.least("low20", "low60", "sma50") * 0.97, price * 0.85)))
        .withColumn("support_levels", supports)
    )


def split_plan(rows: DataFrame, budget: float, lot: int = 100, discounts: tuple = (0.0, 0.07, 0.15), weights: tuple = (0.40, 0.30, 0.30), key: tuple[str, ...] = ("code",)) -> DataFrame:
    """Three tranches of each row's price: limit price, shares in whole lots, amount."""
    parts = F.array(*[F.struct(F.lit(i + 1).alias("tranche"), F.lit(d).alias("discount"), F.lit(w).alias("weight")) for i, (d, w) in enumerate(zip(discounts, weights, strict=True))])
    rows = rows.where("close > 0").select(*key, "close", F.explode(parts).alias("p")).select(*key, "close", "p.*")
    limit = F.col("close") * (1.0 - F.col("discount"))
    shares = F.floor(F.lit(budget) * F.col("weight") / (limit * lot)) * lot
    return rows.select(*key, "tranche", limit.alias("limit_price"), shares.cast("long").alias("shares"), (shares * limit).alias("amount"))
