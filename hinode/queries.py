"""Queries over the driver's tables: one per operator, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinode import oracles as O
from hinode.functions.scalars import coerce_flag, display_code, half_up, normalize_code
from hinode.operators import asof, criteria, decision, fundamentals, history, learning, portfolio, prices, scoring, search, walkforward
from hinode.oracles import AS_OF, HORIZONS, r, sql
from hinode.plans import screen
from hinode.sources import driver_tables as T
from hinode.sources import readers
from hinode.sources.store import stored

LOOSE = criteria.ScreenConfig(
    min_turnover=1000.0, min_equity_ratio=0.2, min_cf_ratio=0.6, min_sales_cagr=-0.5, min_relative=0.10, max_forecast_decline=-0.35, min_cash_conversion=0.35, min_margin_change=-0.10, min_revision=-0.30, min_sector_relative=-0.40, min_score=25.0
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function as a query of its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def dates(spark: SparkSession, days: tuple[str, ...] = AS_OF) -> DataFrame:
    rows = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "d string, snapshot_no int")
    return rows.select(F.to_date("d").alias("as_of"), "snapshot_no")


def rounded(df: DataFrame, *names: str) -> list:
    return [half_up(F.col(n)).alias(n) for n in names]


def universe(spark: SparkSession, d: str, days: tuple[str, ...] = AS_OF) -> DataFrame:
    return screen.prepare_universe(T.companies(spark, d), T.prices(spark, d), T.financials(spark, d), dates(spark, days), T.index_series(spark, d))


def screened(spark: SparkSession, d: str) -> DataFrame:
    return criteria.apply_criteria(universe(spark, d), LOOSE)


PRICE = ("close", "drawdown_52w", "return_6m", "index_return_6m", "relative_return_6m", "volatility_60d", "average_intraday_range_20d", "average_absolute_return_20d", "average_turnover_20d")


@query(sql(f"SELECT as_of, code, CAST(session_no AS BIGINT) AS session_no, {', '.join(r(c) for c in PRICE)} FROM pf"))
def price_features_asof(spark, d):
    df = prices.price_features(T.prices(spark, d), dates(spark).select("as_of"), T.index_series(spark, d))
    return df.select("as_of", "code", F.col("session_no").cast("long").alias("session_no"), *rounded(df, *PRICE))


@query(sql(f"SELECT code, date, CAST(session_no AS BIGINT) AS session_no, {r('close / high_52w - 1.0e0', 'drawdown_52w')}, {r('return_6m')}, {r('CASE WHEN n60 >= 20 THEN sd60 * sqrt(252.0e0) END', 'volatility_60d')} FROM roll"))
def rolling_feature_store(spark, d):
    df = prices.rolling_features(T.prices(spark, d), T.index_series(spark, d))
    return df.select("code", "date", F.col("session_no").cast("long").alias("session_no"), *rounded(df, "drawdown_52w", "return_6m", "volatility_60d"))


FINANCE = ("sales_cagr_3y", "operating_margin", "operating_margin_change_3y", "operating_profit_latest", "cash_conversion_ratio", "operating_cf_positive_ratio_3y", "equity_ratio", "net_cash", "payout_ratio", "forecast_op_growth")


@query(sql(f"SELECT as_of, code, CAST(financial_history_years AS BIGINT) AS financial_history_years, financial_disclosure_date, {', '.join(r(c) for c in FINANCE)} FROM ff"))
def financial_last3(spark, d):
    df = fundamentals.financial_features(T.financials(spark, d), dates(spark).select("as_of"))
    return df.select("as_of", "code", "financial_history_years", "financial_disclosure_date", *rounded(df, *FINANCE))


@query(sql(f"SELECT as_of, code, CAST(forecast_revision_target_year AS BIGINT) AS target, {r('forecast_operating_profit')}, {r('forecast_revision_from')}, {r('forecast_revision_rate')} FROM ff WHERE forecast_operating_profit IS NOT NULL"))
def forecast_revision(spark, d):
    known = T.financials(spark, d).join(F.broadcast(dates(spark)), F.col("disclosure_date") <= F.col("as_of"))
    df = fundamentals.forecast_revisions(known)
    return df.select("as_of", "code", F.col("forecast_revision_target_year").cast("long").alias("target"), *rounded(df, "forecast_operating_profit", "forecast_revision_from", "forecast_revision_rate"))


@query(sql(f"SELECT as_of, code, dividend_source, {r('dividend')}, {r('dividend_change')}, {r('payout_ratio')} FROM ff"))
def dividend_cascade(spark, d):
    df = fundamentals.financial_features(T.financials(spark, d), dates(spark).select("as_of"))
    df = df.withColumnsRenamed({"forecast_annual_dividend_per_share": "dividend", "forecast_dividend_change_rate": "dividend_change", "dividend_forecast_source": "dividend_source"})
    return df.select("as_of", "code", "dividend_source", *rounded(df, "dividend", "dividend_change", "payout_ratio"))


@query(sql(f"SELECT code, event_date, CAST(DATE '2024-01-31' - event_date AS BIGINT) AS event_age_days, category, event_no, review_status, {r('strength', 'event_strength')} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY strength DESC, event_date DESC, event_no) AS n FROM ev WHERE event_date <= DATE '2024-01-31' AND DATE '2024-01-31' - event_date <= 20) WHERE n = 1"))
def event_strength_argmax(spark, d):
    day = spark.createDataFrame([("2024-01-31",)], "s string").select(F.to_date("s").alias("as_of"))
    df = fundamentals.strongest_events(T.external_events(spark, d), day, 20)
    return df.select("code", "event_date", F.col("event_age_days").cast("long").alias("event_age_days"), "category", "event_no", "review_status", half_up(F.col("event_strength")).alias("event_strength"))


VALUE = ("market_cap", "per", "pbr", "per_vs_sector", "pbr_vs_sector", "sector_median", "sector_relative_return_6m")


@query(sql(f"SELECT as_of, code, sector, CAST(peers AS BIGINT) AS peers, {', '.join(r(c) for c in VALUE)} FROM uni"))
def valuation_vs_sector(spark, d):
    df = universe(spark, d).withColumnsRenamed({"sector_peer_count_6m": "peers", "sector_return_6m_median": "sector_median"})
    return df.select("as_of", "code", "sector", "peers", *rounded(df, *VALUE))


@query(sql(f"SELECT as_of, code, {r('quality')}, {r('valuation')}, {r('depth')}, {r('explained')}, {r('penalty')}, {r('least(greatest(quality + valuation + depth - penalty, 0), 85)', 'legacy_score')}, {r('least(greatest(quality + valuation + explained - penalty, 0), 85)', 'explained_score')} FROM sc"))
def score_components(spark, d):
    base = scoring.add_attribution(universe(spark, d), name="external_shock_attribution_v2")
    one = scoring.add_scores(base).withColumnRenamed("quantitative_score", "legacy_score").withColumnRenamed("dislocation_score", "depth")
    df = scoring.add_scores(one, "external_explained").withColumnsRenamed({"quantitative_score": "explained_score", "dislocation_score": "explained", "quality_score": "quality", "valuation_score": "valuation", "financial_penalty": "penalty"}).drop("score")
    return df.select("as_of", "code", *rounded(df, "quality", "valuation", "depth", "explained", "penalty", "legacy_score", "explained_score"))


@query(sql(f"SELECT as_of, code, {r('v1')}, {r('v2')}, CASE WHEN v2 IS NOT NULL THEN '' WHEN return_6m >= 0 THEN 'no fall' WHEN return_6m IS NULL THEN 'no comparison' ELSE 'too few peers' END AS reason FROM att"))
def attribution_v1_v2(spark, d):
    df = scoring.add_attribution(scoring.add_attribution(universe(spark, d), "v1_legacy", "v1"), "v2_sector_absolute", "v2")
    return df.select("as_of", "code", *rounded(df, "v1", "v2"), F.col("v2_reason").alias("reason"))


@query(sql("SELECT as_of, cohort, reason, COUNT(*) AS n FROM (SELECT as_of, CASE WHEN return_6m >= 0 THEN 'no fall' WHEN return_6m IS NULL THEN 'no comparison' ELSE 'too few peers' END AS reason, unnest(CASE WHEN p_market AND p_liquidity AND p_price AND p_equity_ratio AND p_operating_profit AND p_cf_history AND p_sales_trend AND p_margin AND p_drawdown AND p_relative AND p_forecast THEN ['all', 'before the gate'] ELSE ['all'] END) AS cohort FROM sel WHERE v2 IS NULL) GROUP BY 1, 2, 3"))
def attribution_diagnostics(spark, d):
    return criteria.attribution_diagnostics(screened(spark, d), ["as_of"])


FLAGS = ("market", "liquidity", "price", "equity_ratio", "operating_profit", "cf_history", "sales_trend", "margin", "drawdown", "relative", "attribution", "forecast", "guard", "score")


@query(sql(f"SELECT as_of, code, {', '.join(f'p_{c} AS pass_{c}' for c in FLAGS)}, hard AS hard_pass, selected, {r('qscore', 'quantitative_score')} FROM sel"))
def criteria_flags(spark, d):
    df = screened(spark, d)
    return df.select("as_of", "code", *[f"pass_{c}" for c in FLAGS], "hard_pass", "selected", half_up(F.col("quantitative_score")).alias("quantitative_score"))


REASONS = _REASONS = ", ".join(f"CASE WHEN NOT p_{c} THEN '{c}' END" for c in FLAGS)


@query(sql(f"SELECT as_of, code, list_aggregate(list_filter([{_REASONS}], lambda x: x IS NOT NULL), 'string_agg', ' / ') AS fail_reasons, CAST(len(list_filter([{_REASONS}], lambda x: x IS NOT NULL)) AS BIGINT) AS n FROM sel WHERE NOT selected"))
def reasons_joined(spark, d):
    df = screened(spark, d).where("NOT selected")
    return df.select("as_of", "code", F.array_join("fail_reasons", " / ").alias("fail_reasons"), F.size("fail_reasons").cast("long").alias("n"))


def _stage(names: list[str]) -> str:
    return f"count_if({' AND '.join(f'p_{n}' for n in names) or 'true'})"


_STAGES = [[], ["market", "liquidity", "price"], list(FLAGS[:8]), list(FLAGS[:10]), list(FLAGS[:11]), list(FLAGS[:12]), list(FLAGS[:13]), list(FLAGS[:13]), list(FLAGS)]


@query(sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS place, '{criteria.STAGES[i][0]}' AS stage, CAST({_stage(s)} AS BIGINT) AS n FROM sel" for i, s in enumerate(_STAGES)) + "".join(f" UNION ALL SELECT {9 + i}, '{label}', 0" for i, label in enumerate(("attribution below minimum", "attribution unknown, failed", "attribution unknown, passed"))) + ")"))
def screening_funnel(spark, d):
    df = criteria.funnel(screened(spark, d), LOOSE)
    return df.select(F.col("place").cast("long").alias("place"), "stage", "n")


@query(sql(f"SELECT as_of, code, CAST(place AS BIGINT) AS place, {r('qscore', 'strategy_score')} FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY qscore DESC, average_turnover_20d DESC, code) AS place FROM sel WHERE selected) WHERE place <= 50"))
def shortlist_topk(spark, d):
    return criteria.shortlist(screened(spark, d), LOOSE).select("as_of", "code", F.col("place").cast("long").alias("place"), half_up(F.col("strategy_score")).alias("strategy_score"))


@query(sql(f"SELECT as_of, code, CAST(place AS BIGINT) AS place, {r('qscore', 'strategy_score')} FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY qscore DESC, code) AS place FROM sel WHERE NOT selected) WHERE place <= 30"))
def near_miss(spark, d):
    return criteria.near_misses(screened(spark, d)).select("as_of", "code", F.col("place").cast("long").alias("place"), half_up(F.col("strategy_score")).alias("strategy_score"))


_GUARD = "p_market AND p_liquidity AND p_price AND p_equity_ratio AND p_operating_profit AND p_cf_history AND p_sales_trend AND p_margin AND p_drawdown AND p_forecast AND p_guard AND p_score"


@query(sql(f"""SELECT as_of, method, minimum, relative, CAST(count_if({_GUARD} AND (NOT relative OR COALESCE(relative_return_6m <= -0.08e0, true)) AND (minimum = 0 OR COALESCE(CASE WHEN method = 'v1_legacy' THEN v1 ELSE v2 END >= minimum, true))) AS BIGINT) AS selected
    FROM sel, (SELECT unnest(['v2_sector_absolute', 'v1_legacy']) AS method), (SELECT unnest([0.0e0, 0.3e0, 0.5e0, 0.7e0]) AS minimum), (SELECT unnest([true, false]) AS relative) GROUP BY 1, 2, 3, 4"""))
def variant_comparison_16(spark, d):
    return criteria.screen_variants(universe(spark, d), LOOSE).select("as_of", "method", "minimum", "relative", "selected")


@query(sql(f"SELECT as_of, 'legacy_depth' AS mode, CAST(count_if(selected) AS BIGINT) AS selected, {r('AVG(qscore)', 'mean_score')} FROM sel GROUP BY 1 UNION ALL SELECT as_of, 'external_explained', CAST(count_if(hard AND least(greatest(quality + valuation + explained - penalty, 0), 85) >= 25) AS BIGINT), {r('AVG(least(greatest(quality + valuation + explained - penalty, 0), 85))', 'mean_score')} FROM sel GROUP BY 1"))
def score_mode_comparison(spark, d):
    df = criteria.score_mode_variants(universe(spark, d), LOOSE)
    return df.select("as_of", "mode", "selected", half_up(F.col("mean_score")).alias("mean_score"))


@query(sql(f"SELECT as_of, code, {r('activity', 'activity_score')} FROM act"))
def activity_percent_rank(spark, d):
    df = criteria.activity_score(universe(spark, d))
    return df.select("as_of", "code", half_up(F.col("activity_score")).alias("activity_score"))


TREND = ("sma20", "sma50", "sma200", "rsi14", "return_20d", "return_60d", "high20", "low20", "volume_ratio_20d")


@query(sql(f"SELECT code, date, {', '.join(r(c) for c in TREND)} FROM tr"))
def sma_rsi(spark, d):
    df = prices.trend_indicators(T.prices(spark, d))
    return df.select("code", "date", *rounded(df, *TREND))


@query(sql("SELECT as_of, code, CAST(trend_score AS BIGINT) AS trend_score, CASE WHEN trend_score >= 5 THEN 'uptrend' WHEN trend_score >= 2 THEN 'turning up' WHEN trend_score <= -5 THEN 'clear downtrend' WHEN trend_score <= -2 THEN 'downtrend' ELSE 'no direction' END AS trend_state FROM tr JOIN dates ON date <= as_of AND (next_date IS NULL OR next_date > as_of)"))
def trend_state(spark, d):
    df = prices.pick_as_of(prices.trend_indicators(T.prices(spark, d)), dates(spark).select("as_of"))
    return df.select("as_of", "code", F.col("trend_score").cast("long").alias("trend_score"), "trend_state")


@query(sql("SELECT a.as_of, a.code, a.date AS now_date, CAST(a.trend_score AS BIGINT) AS score_now, b.date AS before_date, CAST(b.trend_score AS BIGINT) AS score_before, CAST(a.trend_score - b.trend_score AS BIGINT) AS score_change FROM (SELECT * FROM tr JOIN dates ON date <= as_of AND (next_date IS NULL OR next_date > as_of)) a ASOF LEFT JOIN tr b ON a.code = b.code AND b.date <= a.date - 90"))
def trend_transition_90d(spark, d):
    df = prices.trend_transition(prices.trend_indicators(T.prices(spark, d)), dates(spark).select("as_of"))
    return df.select("as_of", "code", "now_date", F.col("score_now").cast("long").alias("score_now"), "before_date", F.col("score_before").cast("long").alias("score_before"), F.col("score_change").cast("long").alias("score_change"))


@query(sql("SELECT as_of, code, CAST(evidence_score AS BIGINT) AS evidence_score, CAST(failures AS BIGINT) AS failures, level, " + " || ' ' || ".join(f"'{k}=' || c_{k}" for k, *_ in O.CHECKS) + " AS checks FROM rd"))
def readiness_checks(spark, d):
    df = screen.decide(screened(spark, d), T.prices(spark, d), dates(spark))
    return df.select("as_of", "code", F.col("evidence_score").cast("long").alias("evidence_score"), F.col("failures").cast("long").alias("failures"), "level", F.array_join(F.transform("checks", lambda c: F.concat_ws("=", c["key"], c["status"])), " ").alias("checks"))


@query(sql("SELECT as_of, code, badge, legacy_star, reversal_star, escaped_downtrend FROM bd"))
def badge(spark, d):
    df = screen.decide(screened(spark, d), T.prices(spark, d), dates(spark))
    return df.select("as_of", "code", "badge", "legacy_star", "reversal_star", "escaped_downtrend")


@query(sql(f"""SELECT as_of, code, zone_status, {r('least(lo, hi)', 'zone_low')}, {r('greatest(lo, hi)', 'zone_high')} FROM (SELECT *, CASE WHEN trend_score <= -2 THEN COALESCE(low20, low60, secondary) * 0.98e0 WHEN COALESCE(rsi14 >= 72, false) THEN COALESCE(sma20, close * 0.95e0) * 0.98e0 WHEN trend_score >= 2 THEN prim * 0.98e0 ELSE least(secondary, least(prim, close * 0.97e0)) * 0.98e0 END AS lo,
    CASE WHEN trend_score <= -2 THEN COALESCE(low20, low60, secondary) * 1.02e0 WHEN COALESCE(rsi14 >= 72, false) THEN COALESCE(sma20, close * 0.95e0) * 1.01e0 WHEN trend_score >= 2 THEN prim * 1.02e0 ELSE greatest(secondary, least(prim, close * 0.97e0)) * 1.01e0 END AS hi,
    CASE WHEN trend_score <= -2 THEN 'wait' WHEN COALESCE(rsi14 >= 72, false) THEN 'wait for a dip' WHEN trend_score >= 2 THEN 'enter in parts' ELSE 'wait for a turn' END AS zone_status
    FROM (SELECT *, COALESCE(sma20, sma50, close * 0.95e0) AS prim, COALESCE(sma50, low20, close * 0.9e0) AS secondary FROM tr JOIN dates ON date <= as_of AND (next_date IS NULL OR next_date > as_of)))"""))
def entry_zone(spark, d):
    df = decision.entry_zone(prices.pick_as_of(prices.trend_indicators(T.prices(spark, d)), dates(spark).select("as_of")))
    return df.select("as_of", "code", "zone_status", *rounded(df, "zone_low", "zone_high"))


@query(sql(f"SELECT as_of, code, CAST(tranche AS BIGINT) AS tranche, {r('close * (1 - discount)', 'limit_price')}, CAST(floor(1000000.0e0 * weight / (close * (1 - discount) * 100)) * 100 AS BIGINT) AS shares FROM (SELECT as_of, code, close FROM pf), (VALUES (1, 0.0e0, 0.4e0), (2, 0.07e0, 0.3e0), (3, 0.15e0, 0.3e0)) t(tranche, discount, weight)"))
def split_plan(spark, d):
    rows = prices.price_features(T.prices(spark, d), dates(spark).select("as_of"))
    df = decision.split_plan(rows, 1_000_000.0, key=("as_of", "code"))
    return df.select("as_of", "code", F.col("tranche").cast("long").alias("tranche"), half_up(F.col("limit_price")).alias("limit_price"), "shares")


_FORWARD = ", ".join(f"floor((h{h}.close / entry_price - 1.0e0) * 10000.0e0 + 0.5e0) / 10000.0e0 AS return_{h}d, CAST(h{h}.date - as_of AS BIGINT) AS actual_days_{h}d" for h in HORIZONS)
_JOINS = " ".join(f"LEFT JOIN ses h{h} ON h{h}.code = anc.code AND h{h}.no = n0 + {h}" for h in HORIZONS)


def anchors(spark, d) -> DataFrame:
    picked = prices.pick_as_of(prices.rolling_features(T.prices(spark, d)), dates(spark).select("as_of"))
    return picked.select("as_of", "code", F.col("close").alias("entry_price"))


def _returns(df: DataFrame, suffix: str = "") -> list:
    out = []
    for h in HORIZONS:
        out += [half_up(F.col(f"return_{h}d{suffix}")).alias(f"return_{h}d"), F.col(f"actual_days_{h}d{suffix}").cast("long").alias(f"actual_days_{h}d")]
    return out


@query(sql(f"SELECT as_of, anc.code, {_FORWARD} FROM anc {_JOINS}"))
def nth_session_return(spark, d):
    df = asof.forward_returns(anchors(spark, d), T.prices(spark, d), HORIZONS)
    return df.select("as_of", "code", *_returns(df))


_LATE = ", ".join(f"floor((h{h}.close / e.close - 1.0e0) * 10000.0e0 + 0.5e0) / 10000.0e0 AS return_{h}d, CAST(h{h}.date - e.date AS BIGINT) AS actual_days_{h}d" for h in HORIZONS)


@query(sql(f"SELECT as_of, anc.code, {_LATE} FROM anc LEFT JOIN ses e ON e.code = anc.code AND e.no = n0 + 3 " + " ".join(f"LEFT JOIN ses h{h} ON h{h}.code = anc.code AND h{h}.no = n0 + {h + 3}" for h in HORIZONS)))
def delayed_entry_return(spark, d):
    df = asof.forward_returns(anchors(spark, d), T.prices(spark, d), HORIZONS, delay=3, suffix="_late")
    return df.select("as_of", "code", *_returns(df, "_late"))


@query(sql(f"SELECT as_of, code, {r('(SELECT arg_min(close, date) FROM px p WHERE p.code = anc.code AND p.date >= as_of + 30) / entry_price - 1.0e0', 'calendar_return_30d')}, {r('(SELECT arg_min(close, date) FROM px p WHERE p.code = anc.code AND p.date >= as_of + 90) / entry_price - 1.0e0', 'calendar_return_90d')} FROM anc"))
def calendar_forward_return(spark, d):
    df = asof.calendar_returns(anchors(spark, d), T.prices(spark, d), (30, 90))
    return df.select("as_of", "code", *rounded(df, "calendar_return_30d", "calendar_return_90d"))


@query(sql("SELECT code, date AS event_date, fd AS disclosure_date, years FROM (SELECT p.code, p.date, MAX(f.disclosure_date) AS fd, CAST(arg_max(f.fiscal_year, f.disclosure_date) AS BIGINT) AS years FROM px p LEFT JOIN fin f ON f.code = p.code AND f.disclosure_date <= p.date AND f.statement_type = 'FY' GROUP BY 1, 2)"))
def asof_backward_filing(spark, d):
    left = T.prices(spark, d).select("code", F.col("date").alias("event_date"))
    right = T.financials(spark, d).where("statement_type = 'FY'").select("code", "disclosure_date", "fiscal_year")
    df = asof.as_of_backward(left, right, "code", "event_date", "disclosure_date")
    return df.select("code", "event_date", F.col("disclosure_date_r").alias("disclosure_date"), F.col("fiscal_year_r").cast("long").alias("years"))


@query(sql("SELECT date AS as_of, row_number() OVER (ORDER BY date) AS snapshot_no FROM (SELECT date, row_number() OVER (ORDER BY date) AS no, COUNT(*) OVER () AS total FROM (SELECT DISTINCT date FROM px)) WHERE no >= 252 AND total - 200 - no >= 0 AND (total - 200 - no) % 40 = 0 AND total - 200 - no < 320"))
def replay_schedule(spark, d):
    df = walkforward.replay_dates(T.prices(spark, d), 8, 40, 252, 200)
    return df.select("as_of", F.col("snapshot_no").cast("long").alias("snapshot_no"))


def replay(spark, d) -> DataFrame:
    return screen.walk_forward(T.companies(spark, d), T.prices(spark, d), T.financials(spark, d), T.index_series(spark, d), dates(spark), LOOSE, HORIZONS, (3, 5))


_PER_HORIZON = ", ".join(f"{r(f'r{h}', f'return_{h}d')}, {r(f'c{h}', f'control_return_{h}d')}, {r(f'r{h} - c{h}', f'selection_edge_{h}d')}" for h in HORIZONS)


@query(sql(f"SELECT as_of, code, episode_id, badge, market_regime, {_PER_HORIZON} FROM wev JOIN (SELECT as_of, code, badge FROM bd) USING (as_of, code) WHERE variant = 'plain'"))
def walkforward_events(spark, d):
    df = replay(spark, d)
    return df.select("as_of", "code", "episode_id", "badge", "market_regime", *rounded(df, *[f"{k}_{h}d" for h in HORIZONS for k in ("return", "control_return", "selection_edge")]))


@query(sql(f"SELECT as_of, target, code, CAST(tier AS BIGINT) AS tier, CAST(place AS BIGINT) AS place, {r('distance')} FROM ctl WHERE variant = 'plain'"))
def matched_controls(spark, d):
    df = walkforward.matched_controls(stored(screened(spark, d), "criteria"), 5)
    return df.select("as_of", "target", "code", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"), half_up(F.col("distance")).alias("distance"))


_EVENTS = f"SELECT *, CASE WHEN index_return_6m IS NULL THEN 'unknown' WHEN index_return_6m <= -0.05e0 THEN 'falling' WHEN index_return_6m >= 0.05e0 THEN 'rising' ELSE 'flat' END AS regime, code || ':' || MIN(snapshot_no) OVER (PARTITION BY code, island) AS episode_id FROM (SELECT s.as_of, snapshot_no, s.code, v2, index_return_6m, snapshot_no - row_number() OVER (PARTITION BY s.code ORDER BY snapshot_no) AS island, h.close / s.close - 1 AS ret FROM sel s JOIN dates USING (as_of) JOIN anc ON anc.as_of = s.as_of AND anc.code = s.code LEFT JOIN ses h ON h.code = s.code AND h.no = n0 + 30 WHERE selected)"


@query(sql(f"SELECT as_of, code, episode_id, {r('ret', 'return_30d')} FROM ({_EVENTS})"))
def episodes_islands(spark, d):
    df = replay(spark, d)
    return df.select("as_of", "code", "episode_id", half_up(F.col("return_30d")).alias("return_30d"))


ONCE = {"mean_return": "AVG(r)", "positive_share": "AVG(CASE WHEN r > 0 THEN 1.0e0 WHEN r IS NOT NULL THEN 0 END)", "control_mean": "AVG(c)", "edge": "AVG(e)", "edge_positive_share": "AVG(CASE WHEN e > 0 THEN 1.0e0 WHEN e IS NOT NULL THEN 0 END)"}


def summary_sql(keys: str, where: str) -> str:
    stats = ", ".join(r(f"{x} FILTER (nth = 1)", name) for name, x in ONCE.items())
    return sql(f"SELECT {keys}, horizon, COUNT(r) AS events, COUNT(r) FILTER (nth = 1) AS episodes, {stats} FROM wel WHERE {where} GROUP BY ALL")


def summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("horizon").cast("long").alias("horizon"), "events", "episodes", *rounded(df, *ONCE))


@query(summary_sql("'all' AS cohort", "variant = 'plain'"))
def wf_summary(spark, d):
    return summary(walkforward.horizon_summary(replay(spark, d), HORIZONS).withColumn("cohort", F.lit("all")), "cohort")


@query(summary_sql("market_regime", "variant = 'plain'"))
def wf_regime(spark, d):
    return summary(walkforward.horizon_summary(replay(spark, d), HORIZONS, ["market_regime"]), "market_regime")


def _stats_sql(x: str) -> str:
    parts = {"mean_return": f"AVG({x})", "median_return": f"median({x})", "positive_share": f"AVG(CASE WHEN {x} > 0 THEN 1.0e0 WHEN {x} IS NOT NULL THEN 0 END)", "loss_share": f"AVG(CASE WHEN {x} <= -0.05e0 THEN 1.0e0 WHEN {x} IS NOT NULL THEN 0 END)"}
    return f"COUNT({x}) AS n, " + ", ".join(r(v, k) for k, v in parts.items())


STATS = ("mean_return", "median_return", "positive_share", "loss_share")
_COHORTS = "SELECT w.*, unnest(['all'] || CASE WHEN legacy_star THEN ['legacy star'] ELSE [] END || CASE WHEN reversal_star THEN ['reversal star'] ELSE [] END) AS cohort FROM wev w JOIN (SELECT as_of, code, legacy_star, reversal_star FROM bd) USING (as_of, code) WHERE variant = 'plain' AND nth = 1"


def _each_horizon(select: str, rest: str) -> str:
    """One SELECT for each horizon, with {h} as its sessions."""
    return sql(" UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS horizon, {select.replace('{h}', str(h))} {rest.replace('{h}', str(h))}" for h in HORIZONS))


def horizon():
    return F.col("horizon").cast("long").alias("horizon")


@query(_each_horizon(f"cohort, COUNT(*) AS members, {_stats_sql('r{h}')}", f"FROM ({_COHORTS}) GROUP BY cohort"))
def wf_cohort(spark, d):
    df = walkforward.cohort_summary(replay(spark, d), HORIZONS)
    return df.select(horizon(), "cohort", "members", "n", *rounded(df, *STATS))


_DELAYED = " UNION ALL ".join(f"SELECT {k} AS delay, {x} AS r FROM wev WHERE variant = 'plain' AND nth = 1" for k, x in ((0, "r{h}"), (3, "r{h}_3"), (5, "r{h}_5")))


@query(_each_horizon(f"CAST(delay AS BIGINT) AS delay, {_stats_sql('r')}", f"FROM ({_DELAYED}) GROUP BY delay"))
def wf_timing(spark, d):
    df = walkforward.timing_summary(replay(spark, d), HORIZONS)
    return df.select(horizon(), F.col("delay").cast("long").alias("delay"), "n", *rounded(df, *STATS))


_BAND = "CASE WHEN v2 <= 0.25e0 THEN '0-25' WHEN v2 <= 0.5e0 THEN '25-50' WHEN v2 <= 0.75e0 THEN '50-75' ELSE '75-100' END"


@query(_each_horizon(f"{_BAND} AS band, {_stats_sql('r{h}')}", f"FROM wev WHERE variant = 'plain' AND nth = 1 AND v2 IS NOT NULL AND r{{h}} IS NOT NULL GROUP BY {_BAND}"))
def attribution_bands(spark, d):
    df = walkforward.attribution_bands(replay(spark, d), HORIZONS)
    return df.select(horizon(), "band", "n", *rounded(df, *STATS))


def evaluations(spark, d) -> DataFrame:
    rows = prices.trend_indicators(T.prices(spark, d))
    s = F.col("trend_score")
    return rows.select(
        "code", F.col("date").alias("evaluation_date"), F.col("close").alias("latest_price"), "trend_score", F.when(s >= 3, "◎☆").when(s >= 1, "◎").when(s == 0, "○").when(s >= -2, "△").otherwise("×").alias("intuitive_symbol"),
        F.when(F.col("session_no") % 7 == 0, "unassessed").otherwise("same_day").alias("status"), F.when(F.col("session_no") % 11 == 0, "unavailable").otherwise("trend").alias("latest_trend"), F.col("date").alias("latest_market_date"), F.lit(None).cast("boolean").alias("legacy_star"), (s >= 5).alias("reversal_star"),
    )


STARS = _STARS = "SELECT * FROM (SELECT *, intuitive_symbol = '◎☆' AS st, lag(intuitive_symbol = '◎☆', 1, false) OVER (PARTITION BY code ORDER BY evaluation_date) AS was FROM ev8 WHERE latest_trend <> 'unavailable') WHERE st AND NOT was"


@query(sql(f"SELECT code, evaluation_date AS star_date, {r('latest_price', 'entry_price')} FROM ({_STARS})"))
def star_events(spark, d):
    df = history.star_events(evaluations(spark, d))
    return df.select("code", "star_date", half_up(F.col("entry_price")).alias("entry_price"))


def star_outcomes_of(spark, d) -> DataFrame:
    events = history.star_events(evaluations(spark, d)).select("code", "star_date", "entry_price")
    return asof.forward_returns(events, T.prices(spark, d), HORIZONS, date="star_date")


STAR_RETURNS = " UNION ALL ".join(f"SELECT s.code, CAST({h} AS BIGINT) AS horizon, h.close / latest_price - 1 AS ret FROM ({_STARS}) s JOIN ses a ON a.code = s.code AND a.date = evaluation_date LEFT JOIN ses h ON h.code = s.code AND h.no = a.no + {h}" for h in HORIZONS)


@query(sql(f"SELECT horizon, COUNT(ret) AS n, {r('AVG(ret)', 'mean_return')}, {r('AVG(CASE WHEN ret > 0 THEN 1.0e0 WHEN ret IS NOT NULL THEN 0 END)', 'positive_share')} FROM ({STAR_RETURNS}) GROUP BY 1"))
def star_outcomes(spark, d):
    df = history.outcome_summary(star_outcomes_of(spark, d), HORIZONS)
    return df.select(F.col("horizon").cast("long").alias("horizon"), "n", *rounded(df, "mean_return", "positive_share"))


@query(sql(f"SELECT code, horizon, COUNT(ret) AS n, {r('AVG(ret)', 'mean_return')} FROM ({STAR_RETURNS}) GROUP BY 1, 2"))
def star_outcomes_by_code(spark, d):
    df = history.outcome_summary(star_outcomes_of(spark, d), HORIZONS, ["code"])
    return df.select("code", F.col("horizon").cast("long").alias("horizon"), "n", half_up(F.col("mean_return")).alias("mean_return"))


_SEEN_STARS = f"SELECT s.*, sel.* EXCLUDE (code) FROM (SELECT s.code, s.evaluation_date AS star_date, {', '.join(f'h{h}.close / latest_price - 1 AS q{h}' for h in HORIZONS)} FROM ({_STARS}) s JOIN ses a ON a.code = s.code AND a.date = s.evaluation_date {' '.join(f'LEFT JOIN ses h{h} ON h{h}.code = s.code AND h{h}.no = a.no + {h}' for h in HORIZONS)}) s ASOF JOIN sel ON s.code = sel.code AND s.star_date >= sel.as_of"
_MET = " UNION ALL ".join(f"SELECT {i} AS place, '{name}' AS condition, COALESCE({ {'external_shock_attribution': 'v2', 'dividend_yield': 'dividend / close'}.get(c, c) } {op} {t!r}, false) AS met, {', '.join(f'q{h}' for h in HORIZONS)} FROM seen" for i, (name, c, op, t) in enumerate(history.CONDITIONS))
_BY_CONDITION = ", ".join(f"COUNT(q{h}) FILTER (met) AS n_{h}d, AVG(q{h}) FILTER (met) AS mean_{h}d, AVG(CASE WHEN q{h} > 0 THEN 1.0e0 WHEN q{h} IS NOT NULL THEN 0 END) FILTER (met) AS positive_{h}d" for h in HORIZONS)
PERFORMANCE = f"SELECT CAST(place AS BIGINT) AS place, condition, count_if(met) AS matching, COUNT(*) AS events, {_BY_CONDITION} FROM (WITH seen AS MATERIALIZED ({_SEEN_STARS}) {_MET}) GROUP BY 1, 2"


def performance_of(spark, d) -> DataFrame:
    return history.condition_performance(star_outcomes_of(spark, d), screened(spark, d).withColumnRenamed("as_of", "analysis_date"), HORIZONS)


@query(sql(f"SELECT place, condition, matching, events, {', '.join(f'n_{h}d' for h in HORIZONS)}, {', '.join(r(f'{k}_{h}d') for h in HORIZONS for k in ('mean', 'positive'))} FROM ({PERFORMANCE})"))
def condition_performance(spark, d):
    df = performance_of(spark, d)
    return df.select(F.col("place").cast("long").alias("place"), "condition", "matching", "events", *[f"n_{h}d" for h in HORIZONS], *rounded(df, *[f"{k}_{h}d" for h in HORIZONS for k in ("mean", "positive")]))


@query(sql("SELECT evaluation_date, CAST(count_if(status = 'same_day') AS BIGINT) AS same_day, CAST(count_if(status = 'unassessed') AS BIGINT) AS unassessed FROM ev8 GROUP BY 1"))
def evaluation_pivot(spark, d):
    return history.daily_counts(evaluations(spark, d), ("same_day", "unassessed"))


@query(sql("SELECT CAST(i AS BIGINT) AS place, s AS symbol, COUNT(code) AS n FROM (VALUES (0, '◎☆'), (1, '◎'), (2, '○'), (3, '△'), (4, '×')) t(i, s) LEFT JOIN ev8 ON intuitive_symbol = s GROUP BY 1, 2"))
def symbol_counts(spark, d):
    df = history.symbol_counts(evaluations(spark, d))
    return df.select(F.col("place").cast("long").alias("place"), "symbol", "n")


@query(sql(f"SELECT code, evaluation_date, {r('latest_price')}, note FROM (SELECT code, evaluation_date, latest_price * 2 AS latest_price, 'new' AS note FROM ev8 WHERE status = 'unassessed' UNION ALL SELECT code, evaluation_date, latest_price, NULL FROM ev8 WHERE status <> 'unassessed')"))
def keep_last_upsert(spark, d):
    """Evaluations that were unassessed come again with another price; the rest stays."""
    made = evaluations(spark, d).select("code", "evaluation_date", "latest_price", "status").withColumn("stamp", F.lit(1))
    new = made.where("status = 'unassessed'").drop("status").withColumn("latest_price", F.col("latest_price") * 2).withColumn("note", F.lit("new"))
    old = made.drop("status")
    df = history.upsert(old, new, ["evaluation_date", "code"], "stamp")
    return df.select("code", "evaluation_date", half_up(F.col("latest_price")).alias("latest_price"), "note")


@query(sql("SELECT px.code, px.date AS analysis_date, COALESCE(intuitive_symbol, 'unassessed') AS final, status FROM px LEFT JOIN ev8 ON ev8.code = px.code AND evaluation_date = px.date"))
def attach_evaluations(spark, d):
    analysis = T.prices(spark, d).select("code", F.col("date").alias("analysis_date"))
    made = evaluations(spark, d).withColumn("evaluated_at", F.col("evaluation_date"))
    return history.attach_evaluations(analysis, made).select("code", "analysis_date", "final", "status")


@query(sql(f"SELECT reason, COUNT(*) AS n FROM (SELECT unnest(list_filter([{_REASONS}], lambda x: x IS NOT NULL)) AS reason FROM sel) GROUP BY 1 ORDER BY n DESC, reason LIMIT 10"))
def fail_reason_topn(spark, d):
    return criteria.fail_reason_counts(screened(spark, d))


_NEXT_30 = "nx AS MATERIALIZED (SELECT a.code, a.date, b.date AS after FROM px a ASOF JOIN px b ON a.code = b.code AND a.date + 30 <= b.date)"


@query(f"WITH RECURSIVE px AS MATERIALIZED ({O.TABLES['px']}), {_NEXT_30}, g(code, day) AS (SELECT code, MIN(date) FROM px GROUP BY 1 UNION ALL SELECT g.code, nx.after FROM g JOIN nx ON nx.code = g.code AND nx.date = g.day) SELECT code, day AS analysis_date FROM g")
def gap_dedupe_fold(spark, d):
    return asof.spaced_events(T.prices(spark, d).select("code", F.col("date").alias("analysis_date")), 30)


_METRICS = ("operating_margin", "equity_ratio", "net_cash")


@query(sql("SELECT code, CAST(3 AS BIGINT) AS n_conditions, CAST(a + b + c AS BIGINT) AS n_breached, CAST(u AS BIGINT) AS n_unknown, CASE WHEN a + b + c > 0 THEN 'breached' WHEN u > 0 THEN 'unevaluable' ELSE 'clear' END AS status FROM (SELECT code, CASE WHEN operating_margin < 0.0e0 THEN 1 ELSE 0 END AS a, CASE WHEN equity_ratio <= 0.25e0 THEN 1 ELSE 0 END AS b, CASE WHEN net_cash < 0 THEN 1 ELSE 0 END AS c, CASE WHEN net_cash IS NULL THEN 1 ELSE 0 END AS u FROM ff WHERE as_of = DATE '2000-06-30')"))
def invalidation_rules(spark, d):
    rules = [("operating_margin", "<", 0.0), ("equity_ratio", "<=", 25.0), ("net_cash", "<", 0.0)]
    conditions = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(o).alias("operator"), F.lit(t).alias("threshold"), F.lit(True).alias("enabled")) for m, o, t in rules])
    features = fundamentals.financial_features(T.financials(spark, d), dates(spark).where("as_of = DATE '2000-06-30'").select("as_of"))
    reviews = features.select("code", F.lit("").alias("free_text"), conditions.alias("conditions"))
    return history.invalidation_status(reviews, features, _METRICS, ("operating_margin", "equity_ratio"))


def signals(spark, d) -> DataFrame:
    """Month-end signals: the lower the 6-month return, the better."""
    rows = prices.rolling_features(T.prices(spark, d)).where("session_no >= 30")
    ends = T.prices(spark, d).groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("signal_date")).select("signal_date")
    return rows.join(ends, F.col("date") == F.col("signal_date")).select("signal_date", "code", (-F.col("return_6m")).alias("score")).where("score IS NOT NULL")


_SIGNALS = """sig AS MATERIALIZED (SELECT date AS signal_date, code, -return_6m AS score FROM roll WHERE session_no >= 30 AND return_6m IS NOT NULL AND date IN (SELECT MAX(date) FROM px GROUP BY date_trunc('month', date))),
    reb AS MATERIALIZED (SELECT signal_date, row_number() OVER (ORDER BY signal_date) AS i, lead(signal_date) OVER (ORDER BY signal_date) AS next_signal FROM (SELECT DISTINCT signal_date FROM sig)),
    pick AS MATERIALIZED (SELECT i, s.signal_date, next_signal, s.code, p.close AS price, COALESCE(q.close, 0) AS next_price, COUNT(*) OVER (PARTITION BY i) AS size FROM (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY score DESC, code) AS n FROM sig) s JOIN reb USING (signal_date)
        JOIN px p ON p.code = s.code AND p.date = s.signal_date LEFT JOIN px q ON q.code = s.code AND q.date = next_signal WHERE n <= 6 AND p.close > 0),
    val(i, value) AS (SELECT CAST(1 AS BIGINT), 3000000.0e0 UNION ALL SELECT val.i + 1, (SELECT val.value - COALESCE(SUM(floor(val.value / size * 0.999e0 / price) * price * 1.001e0), 0) + COALESCE(SUM(floor(val.value / size * 0.999e0 / price) * next_price), 0) * 0.999e0 FROM pick WHERE pick.i = val.i) FROM val WHERE val.i < (SELECT MAX(i) FROM reb)),
    lots AS MATERIALIZED (SELECT pick.*, floor(value / size * 0.999e0 / price) AS quantity, value FROM pick JOIN val USING (i)),
    held AS MATERIALIZED (SELECT reb.signal_date, next_signal, val.value - COALESCE((SELECT SUM(quantity * price * 1.001e0) FROM lots WHERE lots.i = reb.i), 0) AS cash FROM reb JOIN val USING (i)),
    days AS MATERIALIZED (SELECT d.date, h.signal_date, COALESCE(cash, 3000000.0e0) AS cash FROM (SELECT DISTINCT date FROM px) d ASOF LEFT JOIN held h ON d.date >= h.signal_date),
    worth AS MATERIALIZED (SELECT days.date, ANY_VALUE(days.cash) AS cash, ANY_VALUE(days.cash) + COALESCE(SUM(quantity * px.close), 0) AS equity FROM days LEFT JOIN lots ON lots.signal_date = days.signal_date LEFT JOIN px ON px.code = lots.code AND px.date = days.date GROUP BY 1),
    curve AS MATERIALIZED (SELECT date, equity, cash, COALESCE(equity / lag(equity) OVER (ORDER BY date) - 1, 0) AS daily_return, equity / MAX(equity) OVER (ORDER BY date) - 1 AS drawdown FROM worth)"""


def _curve_sql(select: str) -> str:
    return sql("@", "roll", "px").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n@", f",\n{_SIGNALS}\n{select}")


@query(_curve_sql(f"SELECT date, {', '.join(r(c) for c in ('equity', 'cash', 'daily_return', 'drawdown'))} FROM curve"))
def signal_backtest(spark, d):
    df = portfolio.backtest_curve(signals(spark, d), T.prices(spark, d))
    return df.select("date", *rounded(df, "equity", "cash", "daily_return", "drawdown"))


METRICS = ("final_equity", "total_return", "cagr", "annualized_volatility", "max_drawdown", "sharpe")


@query(_curve_sql(f"SELECT {', '.join(r(c) for c in METRICS)} FROM (SELECT arg_max(equity, date) AS final_equity, arg_max(equity, date) / 3e6 - 1 AS total_return, pow(arg_max(equity, date) / 3e6, 1 / greatest((MAX(date) - MIN(date)) / 365.25e0, 1 / 365.25e0)) - 1 AS cagr, stddev_samp(daily_return) * sqrt(252.0e0) AS annualized_volatility, MIN(drawdown) AS max_drawdown, AVG(daily_return) / nullif(stddev_samp(daily_return), 0) * sqrt(252.0e0) AS sharpe FROM curve)"))
def backtest_metrics(spark, d):
    df = portfolio.backtest_metrics(portfolio.backtest_curve(signals(spark, d), T.prices(spark, d)))
    return df.select(*rounded(df, *METRICS))


@query()
def order_proposals(spark, d):
    rows = screened(spark, d).select("as_of", "code", "close", F.col("quantitative_score").alias("score"))
    return portfolio.order_proposals(rows)


@query()
def company_search(spark, d):
    return search.search_companies(T.companies(spark, d).select("code", "name"), "supplier#00000001")


#: Analysis days for rule learning: four weeks apart, so that the gap of 30 days takes every other one.
LEARN_DAYS = tuple(str(datetime.date(1998, 9, 1) + datetime.timedelta(days=28 * k)) for k in range(40))
#: The driver's prices are noise, so the other horizons are let differ by as much as they do.
LEARNING = learning.LearningConfig(enabled=True, gain=0.005, positive_gain=-0.05, decline=1.0)
CURRENT = learning.current_thresholds(LOOSE)


def learning_analysis(spark, d) -> DataFrame:
    """The screen of each analysis day, as the history that rules are learned from."""
    rows = criteria.apply_criteria(universe(spark, d, LEARN_DAYS), LOOSE).withColumn("analysis_date", F.col("as_of"))
    return rows.select("code", "analysis_date", "close", "selected", "fail_reasons", *[r.column for r in learning.RULES])


def learning_evaluations(spark, d) -> DataFrame:
    events = stored(learning.mature_events(learning_analysis(spark, d), T.prices(spark, d), LEARNING), "mature-events")
    return learning.evaluate_rules(events.where("NOT held_out"), CURRENT, LEARNING)


_TRIED = ", ".join(
    f"({i}, '{x.key}', {place}, {CURRENT[x.key]!r}e0, {t!r}e0)" for i, x in enumerate(learning.RULES) for place, t in enumerate(learning.candidates(x, CURRENT[x.key]))
)
_MEASURE = {"quantitative_score": "qscore"}
_ELIGIBLE = " UNION ALL ".join(
    f"SELECT {i} AS rule_no, as_of, r30, r90, r180, {_MEASURE.get(x.column, x.column)} AS v, {str(x.null_passes).lower()} AS soft, "
    f"{1 if x.direction == '>=' else -1} AS way FROM mature WHERE selected OR (NOT p_{x.label} AND {' AND '.join(f'p_{c}' for c in FLAGS if c != x.label)})"
    for i, x in enumerate(learning.RULES)
)
_FIGURES = ", ".join(
    f"COUNT(r{h}) FILTER (train = {t} AND v_ok) AS {name}_n_{h}, AVG(r{h}) FILTER (train = {t} AND v_ok) AS {name}_mean_{h}, "
    f"AVG(CASE WHEN r{h} > 0 THEN 1.0e0 WHEN r{h} IS NOT NULL THEN 0 END) FILTER (train = {t} AND v_ok) AS {name}_up_{h}, "
    f"COUNT(r{h}) FILTER (train = {t} AND now_ok) AS now_{name}_n_{h}, AVG(r{h}) FILTER (train = {t} AND now_ok) AS now_{name}_mean_{h}, "
    f"AVG(CASE WHEN r{h} > 0 THEN 1.0e0 WHEN r{h} IS NOT NULL THEN 0 END) FILTER (train = {t} AND now_ok) AS now_{name}_up_{h}"
    for h in learning.HORIZONS
    for name, t in (("train", "true"), ("check", "false"))
)
_WORSE = " OR ".join(
    f"COALESCE(least(check_n_{h}, now_check_n_{h}) >= 5 AND check_mean_{h} < now_check_mean_{h} - {LEARNING.decline!r}e0, false)" for h in learning.CONFIRMED_BY
)
_LEARNED = f"""pairs AS MATERIALIZED (SELECT a.code, a.as_of, min(b.as_of) AS after FROM sel a LEFT JOIN sel b ON a.code = b.code AND b.as_of >= a.as_of + 30 GROUP BY 1, 2),
    kept(code, as_of) AS (SELECT code, MIN(as_of) FROM sel GROUP BY 1 UNION ALL SELECT k.code, p.after FROM kept k JOIN pairs p ON p.code = k.code AND p.as_of = k.as_of WHERE p.after IS NOT NULL),
    {", ".join(f"o{h} AS MATERIALIZED (SELECT k.code, k.as_of, p.close AS c{h}, p.date AS d{h} FROM kept k ASOF LEFT JOIN px p ON k.code = p.code AND k.as_of + {h} <= p.date)" for h in learning.HORIZONS)},
    mature AS MATERIALIZED (SELECT sel.*, c30 / close - 1 AS r30, c90 / close - 1 AS r90, c180 / close - 1 AS r180 FROM sel JOIN kept USING (code, as_of) {" ".join(f"JOIN o{h} USING (code, as_of)" for h in learning.HORIZONS)}
        WHERE c90 IS NOT NULL AND close > 0 AND d90 < (SELECT MIN(date) FROM (SELECT DISTINCT date FROM px ORDER BY date DESC LIMIT 60))),
    eligible AS MATERIALIZED ({_ELIGIBLE}),
    days AS (SELECT rule_no, as_of, row_number() OVER (PARTITION BY rule_no ORDER BY as_of) - 1 AS nth, COUNT(*) OVER (PARTITION BY rule_no) AS days FROM (SELECT DISTINCT rule_no, as_of FROM eligible)),
    splits AS (SELECT rule_no, as_of AS split_day FROM days WHERE days >= 2 AND nth = least(greatest(floor(days * 0.7e0), 1), days - 1)),
    tried AS (SELECT * FROM (VALUES {_TRIED}) t(rule_no, rule, place, current, candidate)),
    figures AS (SELECT rule_no, rule, place, current, candidate, {_FIGURES} FROM (SELECT *, as_of < split_day AS train, CASE WHEN v IS NULL THEN soft ELSE way * v >= way * candidate END AS v_ok, CASE WHEN v IS NULL THEN soft ELSE way * v >= way * current END AS now_ok
        FROM eligible JOIN splits USING (rule_no) JOIN tried USING (rule_no)) GROUP BY ALL),
    judged AS MATERIALIZED (SELECT *, train_mean_90 - now_train_mean_90 AS train_gain, check_mean_90 - now_check_mean_90 AS check_gain, check_up_90 - now_check_up_90 AS positive_gain, check_n_90 / CAST(now_check_n_90 AS DOUBLE) AS retention, NOT ({_WORSE}) AS confirmed
        FROM figures WHERE least(train_n_90, now_train_n_90) >= 20 AND least(check_n_90, now_check_n_90) >= 10),
    scored AS MATERIALIZED (SELECT *, check_gain + 0.25e0 * positive_gain + 0.15e0 * train_gain AS score, candidate <> current AND retention >= 0.35e0 AND train_gain >= {LEARNING.gain / 2!r}e0 AND check_gain >= {LEARNING.gain!r}e0 AND positive_gain >= {LEARNING.positive_gain!r}e0 AND confirmed AS accepted FROM judged)"""


def _learned_sql(select: str) -> str:
    return sql("@", "sel", "px", dates=LEARN_DAYS).replace("WITH ", "WITH RECURSIVE ", 1).replace("\n@", f",\n{_LEARNED}\n{select}")


_JUDGED = ("retention", "train_gain", "check_gain", "positive_gain", "score")


@query(_learned_sql(f"SELECT rule, {r('current')}, {r('candidate')}, train_n_90 AS n_train, check_n_90 AS n_check, confirmed, accepted, {', '.join(r(c) for c in _JUDGED)} FROM scored"))
def rule_learning(spark, d):
    df = learning_evaluations(spark, d)
    return df.select("rule", *rounded(df, "current", "candidate"), "n_train", "n_check", "confirmed", "accepted", *rounded(df, *_JUDGED))


@query(_learned_sql(f"SELECT rule, {r('current')}, {r('candidate')}, {r('check_gain')}, {r('score')} FROM scored WHERE accepted ORDER BY score DESC, rule_no, place LIMIT 1"))
def rule_proposals(spark, d):
    df = learning.best_proposal(learning_evaluations(spark, d))
    return df.select("rule", *rounded(df, "current", "candidate", "check_gain", "score"))


@query(sql("SELECT date, COUNT(*) AS n FROM px GROUP BY 1"))
def day_counts(spark, d):
    return history.day_fingerprints(T.prices(spark, d), "date", ["code", "close"]).select("date", "n")


@query("SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(range(MIN(o_orderdate), MAX(o_orderdate) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) <= 5")
def request_dates(spark, d):
    """The week days from the first order to the last."""
    day = F.col("o_orderdate").cast("date").cast("string")
    first, last = T.table(spark, d, "orders").agg(F.min(day), F.max(day)).first()
    return readers.request_dates(spark, first, last)


@query(sql("SELECT code, CASE WHEN length(code) = 4 THEN code || '0' ELSE code END AS normal, CASE WHEN length(code) = 5 AND code LIKE '%0' THEN substr(code, 1, 4) ELSE code END AS shown, CAST(c_custkey % 2 = 0 AS BOOLEAN) AS flag FROM (SELECT CAST(c_custkey AS VARCHAR) AS code, c_custkey FROM customer)"))
def scalar_functions(spark, d):
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("code"), F.when(F.col("c_custkey") % 2 == 0, " Yes").otherwise("off").alias("text"))
    return rows.select("code", normalize_code(F.concat(F.lit("x"), "code")).alias("normal"), display_code(F.col("code")).alias("shown"), coerce_flag(F.col("text")).alias("flag"))


@query(sql("SELECT code, date FROM px ORDER BY code, date LIMIT 50 OFFSET 100"))
def page_slice(spark, d):
    return T.prices(spark, d).select("code", "date").orderBy("code", "date").offset(100).limit(50)


from hinode import store_queries, view_queries  # noqa: E402, F401  further queries, registered by the import
