"""Screens and replays as one plan each: features, context, valuation, criteria, outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import passes
from hinode.operators.asof import as_of_merge, forward_outcomes, forward_returns, sessions
from hinode.operators.criteria import ScreenConfig, apply_criteria
from hinode.operators.decision import badge, readiness
from hinode.operators.fundamentals import add_sector_context, add_valuation, financial_features, strongest_events
from hinode.operators.prices import pick_as_of, price_features, rolling_features, trend_indicators, with_before
from hinode.operators.scoring import add_scores
from hinode.operators.walkforward import MATCH_ON, add_episodes, market_regime, matched_controls
from hinode.sources.store import stored


@dataclass(frozen=True)
class DemoConfig:
    """Thresholds of the event-driven screen."""

    markets: tuple[str, ...] = ("Prime", "Standard", "Growth")
    min_turnover: float = 50_000_000.0
    min_price: float = 200.0
    min_equity_ratio: float = 0.30
    max_forecast_decline: float = -0.20
    max_drawdown: float = -0.18
    max_relative: float = -0.08
    require_event: bool = True
    max_event_age: int = 365
    min_externality: float = 0.40
    min_temporary: float = 0.40
    min_catalyst: float = 0.20
    min_score: float = 55.0
    max_candidates: int = 12


def prepare_universe(companies: DataFrame, prices: DataFrame, filings: DataFrame, as_of: DataFrame, index: DataFrame | None = None, least: int = 30) -> DataFrame:
    """Threshold-free features per (as_of, code): computed once, screened as often as wished.

    companies: one master for all dates, or with a column as_of the master of each date; then a date's securities are those
    that its master knew, with the attributes that it gave them, and no other takes part in its ranks and medians.
    """
    dates = as_of.select("as_of")
    rows = price_features(prices, dates, index, least).join(financial_features(filings, dates), ["as_of", "code"])
    rows = rows.join(companies, ["as_of", "code"] if "as_of" in companies.columns else "code")
    return add_sector_context(add_valuation(rows))


def with_proxy(rows: DataFrame, prices: DataFrame, as_of: DataFrame, proxy: DataFrame) -> DataFrame:
    """Rows with proxy_return_6m, the return of a fund (date, proxy_close) over the same sessions as the security's own."""
    series = proxy.select("date", F.col("proxy_close").alias("index_close"))
    picked = pick_as_of(rolling_features(prices, series), as_of.select("as_of"))
    return rows.join(picked.select("as_of", "code", F.col("index_return_6m").alias("proxy_return_6m")), ["as_of", "code"], "left")


def with_trend(table: DataFrame, prices: DataFrame, as_of: DataFrame, days: int = 90) -> DataFrame:
    """Rows with the trend of their date and the score about `days` days before it."""
    names = ("trend_score", "trend_state", "sma20", "sma50", "sma20_rising", "low20", "low60", "return_20d", "rsi14", "volume_ratio_20d")
    indicators = with_before(trend_indicators(prices), days).select("code", "date", *names, F.col("_before.trend_score").alias("score_before"))
    rows = as_of_merge(table, indicators, ["code"], "as_of", "date", name="_now")
    found = [F.col(f"_now.{n}").alias(n) for n in names]
    return rows.select(*table.columns, *found, F.col("_now.score_before").alias("score_before"))


def decide(table: DataFrame, prices: DataFrame, as_of: DataFrame) -> DataFrame:
    """Criteria rows with trend, readiness checks and badge."""
    return badge(readiness(with_trend(table, prices, as_of)))


def walk_forward(companies: DataFrame, prices: DataFrame, filings: DataFrame, index: DataFrame, as_of: DataFrame, config: ScreenConfig = ScreenConfig(), horizons: tuple[int, ...] = (10, 30, 90), delays: tuple[int, ...] = (3, 5), controls: int = 5, least: int = 252) -> DataFrame:
    """Selected securities of each replay date with episode, badge, forward returns, control means and edges.

    Prices after a replay date are joined after the selection only. as_of has the columns as_of and snapshot_no.
    """
    table = stored(apply_criteria(prepare_universe(companies, prices, filings, as_of, index, least), config), "criteria")
    chosen = decide(table.where("selected"), prices, as_of).join(F.broadcast(as_of), "as_of")  # replay dates
    chosen = add_episodes(chosen).select("as_of", "snapshot_no", "code", "sector", "market", "episode_id", F.col("close").alias("entry_price"), "quantitative_score", "external_shock_attribution", "index_return_6m", "badge", "legacy_star", "reversal_star")
    chosen = chosen.withColumn("market_regime", market_regime(F.col("index_return_6m")))
    chosen = stored(chosen, "selected")
    pool = stored(matched_controls(table, controls).select("as_of", F.col("target").alias("for_code"), "code"), "controls")
    # one ordering of sessions for selected securities and controls, all horizons and delays
    wanted = chosen.select("as_of", "code").union(pool.select("as_of", "code")).distinct()
    wanted = wanted.join(table.select("as_of", "code", F.col("close").alias("entry_price")), ["as_of", "code"])
    found = stored(forward_outcomes(wanted, sessions(prices), horizons, (0, *delays)), "outcomes")
    events = chosen.join(found.drop("entry_price"), ["as_of", "code"])
    means = [F.avg(f"return_{h}d").alias(f"control_return_{h}d") for h in horizons]
    named = pool.join(found, ["as_of", "code"]).groupBy("as_of", F.col("for_code").alias("code"))
    events = events.join(named.agg(*means, F.sort_array(F.collect_set("code")).alias("control_codes")), ["as_of", "code"], "left")
    return events.withColumns({f"selection_edge_{h}d": F.col(f"return_{h}d") - F.col(f"control_return_{h}d") for h in horizons})


def walk_forward_variants(universe: DataFrame, prices: DataFrame, as_of: DataFrame, variants: DataFrame, screen: Callable[[DataFrame], DataFrame], horizons: tuple[int, ...] = (10, 30, 90), controls: int = 5) -> DataFrame:
    """The replay of many variants as one plan: features and returns are computed once, the variant is a column.

    variants: a few rows with `variant` and its parameters, which screen() turns into `selected`; each variant's pool of
    controls is what it didn't select.
    """
    base = stored(universe, "universe").withColumn("day", F.col("as_of")).join(F.broadcast(variants))  # a few rows
    table = screen(base.withColumn("as_of", F.struct("day", "variant"))).select("as_of", "day", "variant", "code", "sector", "market", "selected", "close", *MATCH_ON)
    table = stored(table, "variants")
    returns = stored(forward_returns(universe.select("as_of", "code", F.col("close").alias("entry_price")), prices, horizons).withColumnRenamed("as_of", "day"), "returns")
    chosen = table.where("selected").join(F.broadcast(as_of.withColumnRenamed("as_of", "day")), "day")  # replay dates
    events = add_episodes(chosen.select("as_of", "day", "variant", "snapshot_no", "code"), ("variant",)).join(returns, ["day", "code"])
    pool = matched_controls(table, controls).select("as_of", F.col("as_of.day").alias("day"), F.col("target").alias("for_code"), "code").join(returns, ["day", "code"])
    means = pool.groupBy("as_of", F.col("for_code").alias("code")).agg(*[F.avg(f"return_{h}d").alias(f"control_return_{h}d") for h in horizons])
    events = events.join(means, ["as_of", "code"], "left").withColumn("as_of", F.col("day")).drop("day")
    return events.withColumns({f"selection_edge_{h}d": F.col(f"return_{h}d") - F.col(f"control_return_{h}d") for h in horizons})


def demo_screen(universe: DataFrame, events: DataFrame, as_of: DataFrame, config: DemoConfig = DemoConfig()) -> DataFrame:
    """The event-driven screen: features with each security's strongest event, scored, with the flags eligible, approved,
    candidate and in_review. A missing forecast is not eligible; an event that is missing, not approved or too weak puts
    a fallen security into the review queue."""
    found = strongest_events(events, as_of.select("as_of"), config.max_event_age).select("as_of", "code", "category", "event_date", "externality", "temporary_probability", "catalyst_probability", "review_status", *[c for c in ("source_url",) if c in events.columns])
    rows = add_scores(universe.join(found, ["as_of", "code"], "left"))
    c = F.col
    fallen = (c("drawdown_52w") <= config.max_drawdown) & (c("relative_return_6m") <= config.max_relative)
    eligible = c("market").isin(*config.markets) & (c("average_turnover_20d") >= config.min_turnover) & (c("close") >= config.min_price) & (c("equity_ratio") >= config.min_equity_ratio) & (c("forecast_op_growth") >= config.max_forecast_decline) & fallen
    approved = (c("review_status") == "approved") & (c("externality") >= config.min_externality) & (c("temporary_probability") >= config.min_temporary) & (c("catalyst_probability") >= config.min_catalyst)
    waiting = fallen & (~c("review_status").eqNullSafe("approved") | (F.coalesce("externality", F.lit(0.0)) < config.min_externality))
    rows = rows.withColumns({"eligible": passes(eligible), "approved": passes(approved), "in_review": passes(waiting)})
    wanted = c("eligible") & (c("approved") | F.lit(not config.require_event)) & (c("score") >= config.min_score)
    return rows.withColumn("candidate", passes(wanted))


def demo_candidates(screened: DataFrame, config: DemoConfig = DemoConfig()) -> DataFrame:
    """The candidates of each date with the highest score, then turnover, then code."""
    w = Window.partitionBy("as_of").orderBy(F.desc("score"), F.desc("average_turnover_20d"), "code")
    return screened.where("candidate").withColumn("place", F.row_number().over(w)).where(F.col("place") <= config.max_candidates)


def candidate_list(table: DataFrame, prices: DataFrame, as_of: DataFrame, invalidation: DataFrame | None = None) -> DataFrame:
    """Every row of a criteria table with trend, its change, readiness, badge and the status of its invalidation rules.

    Nothing is dropped: without a trend or a review the columns are null, and the status is `not configured`.
    """
    rows = decide(table, prices, as_of)
    change = F.col("trend_score") - F.col("score_before")
    kind = F.when(change.isNull(), "unknown").when(change >= 3, "improving").when(change <= -3, "worsening").otherwise("steady")
    rows = rows.withColumn("transition", kind)
    if invalidation is None:
        return rows.withColumn("invalidation_status", F.lit("not configured"))
    return rows.join(invalidation.select("code", F.col("status").alias("invalidation_status")), "code", "left").withColumn("invalidation_status", F.coalesce("invalidation_status", F.lit("not configured")))


def reevaluate(analysis: DataFrame, prices: DataFrame, as_of: DataFrame) -> DataFrame:
    """Unassessed analysis rows judged again with the prices of their day or earlier: symbol, price, trend, status, reason.

    A row is backfilled if its security has a bar by its date and its strategy is the value screen; else it stays
    unassessed with a reason. Later prices take no part.
    """
    judged = decide(analysis, prices, as_of)
    traded = prices.where("close IS NOT NULL").groupBy("code").agg(F.min("date").alias("first_bar"))
    last = pick_as_of(trend_indicators(prices), as_of.select("as_of")).select("as_of", "code", F.col("close").alias("latest_price"), F.col("date").alias("latest_market_date"))
    rows = judged.join(traded, "code", "left").join(last, ["as_of", "code"], "left")
    value = F.coalesce(F.col("selection_strategy"), F.lit("value_dislocation")) == "value_dislocation"
    done = value & F.col("latest_price").isNotNull()
    reason = F.when(done, "").when(F.col("as_of").isNull() | ~value, "insufficient history").when(F.col("first_bar").isNull(), "quote failed").otherwise("insufficient history")
    only = lambda c: F.when(done, F.col(c))
    return rows.select(
        "as_of", "code", F.coalesce(only("badge"), F.lit("")).alias("intuitive_symbol"), only("latest_price").alias("latest_price"), only("latest_market_date").alias("latest_market_date"), F.coalesce(only("trend_state"), F.lit("unavailable")).alias("latest_trend"),
        F.when(done, "backfilled").otherwise("unassessed").alias("status"), reason.alias("reason"), only("legacy_star").alias("legacy_star"), only("reversal_star").alias("reversal_star"),
    )
