"""Further queries: the event-driven screen, replays of variants, star rules, history views, reviews, quotes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinode import oracles as O
from hinode.functions.scalars import half_up
from hinode.operators import asof, criteria, fundamentals, history, learning, prices, review, walkforward
from hinode.oracles import AS_OF, HORIZONS, r, sql
from hinode.plans import screen
from hinode.queries import LOOSE, PERFORMANCE, REASONS, STAR_RETURNS, STARS, dates, evaluations, performance_of, query, replay, rounded, screened, star_outcomes_of, summary, summary_sql, universe
from hinode.sources import driver_tables as T
from hinode.sources import readers
from hinode.sources.store import stored

# --- the event-driven screen ----------------------------------------------------------------------------------------

DEMO_DAY = ("2024-01-31",)
DEMO = screen.DemoConfig(min_turnover=1000.0, min_equity_ratio=0.2, max_forecast_decline=-0.35, max_relative=0.10, max_event_age=20, min_score=20.0)
_EXTERNAL = " + ".join(O._scale(c, low, 1.0, 5) for c, low in (("externality", 0.4), ("temporary_probability", 0.4), ("catalyst_probability", 0.2)))
_STRONGEST = "SELECT code, event_date, category, externality, temporary_probability, catalyst_probability, review_status FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY strength DESC, event_date DESC, event_no) AS n FROM ev WHERE event_date <= DATE '2024-01-31' AND DATE '2024-01-31' - event_date <= 20) WHERE n = 1"
_FALLEN = "COALESCE(drawdown_52w <= -0.18e0 AND relative_return_6m <= 0.10e0, false)"
_DEMO = f"""SELECT *, eligible AND approved AND score >= 20 AS candidate FROM (SELECT *, least(greatest(quality + valuation + depth + {_EXTERNAL} - penalty - CASE WHEN review_status = 'approved' THEN 0 ELSE 20 END - 8, 0), 100) AS score,
    COALESCE(market IN ('Prime', 'Standard', 'Growth') AND average_turnover_20d >= 1000 AND close >= 200 AND equity_ratio >= 0.2e0 AND forecast_op_growth >= -0.35e0, false) AND {_FALLEN} AS eligible,
    COALESCE(review_status = 'approved' AND externality >= 0.4e0 AND temporary_probability >= 0.4e0 AND catalyst_probability >= 0.2e0, false) AS approved,
    {_FALLEN} AND (review_status IS NULL OR review_status <> 'approved' OR COALESCE(externality, 0) < 0.4e0) AS in_review FROM sc LEFT JOIN ({_STRONGEST}) e USING (code))"""


def demo(spark, d) -> DataFrame:
    return screen.demo_screen(universe(spark, d, DEMO_DAY), T.external_events(spark, d), dates(spark, DEMO_DAY), DEMO)


@query(sql(f"SELECT as_of, code, eligible, approved, candidate, in_review, category, event_date, {r('score')} FROM ({_DEMO})", dates=DEMO_DAY))
def demo_screen(spark, d):
    return demo(spark, d).select("as_of", "code", "eligible", "approved", "candidate", "in_review", "category", "event_date", half_up(F.col("score")).alias("score"))


@query(sql(f"SELECT as_of, code, CAST(place AS BIGINT) AS place, {r('score')} FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, average_turnover_20d DESC, code) AS place FROM ({_DEMO}) WHERE candidate) WHERE place <= 12", dates=DEMO_DAY))
def demo_candidates(spark, d):
    return screen.demo_candidates(demo(spark, d), DEMO).select("as_of", "code", F.col("place").cast("long").alias("place"), half_up(F.col("score")).alias("score"))


@query(sql(f"SELECT as_of, code, review_status, {r('drawdown_52w')}, {r('relative_return_6m')} FROM ({_DEMO}) WHERE in_review", dates=DEMO_DAY))
def review_queue(spark, d):
    df = demo(spark, d).where("in_review")
    return df.select("as_of", "code", "review_status", *rounded(df, "drawdown_52w", "relative_return_6m"))


# --- replays of variants --------------------------------------------------------------------------------------------


@query(summary_sql("variant", "variant NOT IN ('plain', 'external_explained')"))
def wf_attribution_comparison(spark, d):
    grid = [(f"{m}:{x}:{str(on).lower()}", m, x, on) for m in ("v2_sector_absolute", "v1_legacy") for x in (0.0, 0.3, 0.5, 0.7) for on in (True, False)]
    variants = spark.createDataFrame(grid, "variant string, method string, minimum double, relative boolean")
    run = lambda rows: criteria.apply_criteria(rows, criteria.with_overrides(LOOSE, min_relative=-0.08), F.col("minimum"), F.col("method"), F.col("relative"))
    events = screen.walk_forward_variants(universe(spark, d), T.prices(spark, d), dates(spark), variants, run, HORIZONS)
    return summary(walkforward.horizon_summary(events, HORIZONS, ["variant"], ("variant",)), "variant")


_MATURED = "SELECT *, COALESCE(snapshot_no - lag(snapshot_no) OVER (PARTITION BY variant, horizon, code ORDER BY snapshot_no) <> 1, true) AS starts FROM wel WHERE variant IN ('plain', 'external_explained') AND r IS NOT NULL AND e IS NOT NULL"


@query(sql(f"SELECT CASE variant WHEN 'plain' THEN 'legacy_depth' ELSE variant END AS variant, horizon, COUNT(*) AS matured, count_if(starts) AS episodes, {r('AVG(e) FILTER (starts)', 'edge')}, {r('AVG(CASE WHEN r > 0 THEN 1.0e0 ELSE 0 END) FILTER (starts)', 'positive_share')} FROM ({_MATURED}) GROUP BY 1, 2"))
def wf_score_modes(spark, d):
    variants = spark.createDataFrame([("legacy_depth",), ("external_explained",)], "variant string")
    run = lambda rows: criteria.apply_criteria(rows, LOOSE, score_mode=F.col("variant"))
    events = screen.walk_forward_variants(universe(spark, d), T.prices(spark, d), dates(spark), variants, run, HORIZONS)
    df = walkforward.matured_summary(events, HORIZONS, ["variant"])
    return df.select("variant", F.col("horizon").cast("long").alias("horizon"), "matured", "episodes", *rounded(df, "edge", "positive_share"))


@query(sql("SELECT n AS available_sessions, n - 257 AS maximum_horizon, array_to_string(list_filter([10, 20, 30, 60, 90, 180], lambda h: h <= n - 257), ' ') AS supported, 180 + 5 + 252 + 1 AS sessions_for_one, 438 + 140 AS sessions_for_all, CAST(least(8, floor((n - 185 - 252) / 20) + 1) AS BIGINT) AS usable_replays FROM (SELECT CAST(COUNT(DISTINCT date) AS BIGINT) AS n FROM px)"))
def replay_readiness(spark, d):
    df = walkforward.replay_readiness(T.prices(spark, d), HORIZONS)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return df.select(whole("available_sessions"), whole("maximum_horizon"), F.array_join(F.transform("supported_horizons", lambda x: x.cast("string")), " ").alias("supported"), whole("sessions_for_one"), whole("sessions_for_all"), whole("usable_replays"))


@query(sql("SELECT as_of, COUNT(*) AS securities, count_if(n < 252) AS excluded FROM (SELECT as_of, code, COUNT(*) AS n FROM px JOIN dates ON date <= as_of GROUP BY 1, 2) GROUP BY 1"))
def replay_exclusions(spark, d):
    return walkforward.replay_exclusions(T.prices(spark, d), dates(spark))


_MATURE_SHARES = ", ".join(r(f"100.0e0 * COUNT(r{h}) / COUNT(*)", f"matured_{h}d") for h in HORIZONS)


@query(sql(f"SELECT COUNT(*) AS events, COUNT(DISTINCT episode_id) AS episodes, COUNT(DISTINCT as_of) AS dates, MIN(as_of) AS first_date, MAX(as_of) AS last_date, {_MATURE_SHARES} FROM wev WHERE variant = 'plain'"))
def wf_overview(spark, d):
    df = walkforward.result_overview(replay(spark, d), HORIZONS)
    return df.select("events", "episodes", "dates", "first_date", "last_date", *rounded(df, *[f"matured_{h}d" for h in HORIZONS]))


# --- stars and history views ----------------------------------------------------------------------------------------


def _starred(mode: str, flag: str) -> str:
    return f"SELECT '{mode}' AS star_mode, code, evaluation_date, latest_price FROM (SELECT *, {flag} AS st, lag({flag}, 1, false) OVER (PARTITION BY code ORDER BY evaluation_date) AS was FROM ev8 WHERE latest_trend <> 'unavailable') WHERE st AND NOT was"


_BOTH_RULES = f"{_starred('legacy', chr(40) + 'intuitive_symbol = ' + repr('◎☆') + chr(41))} UNION ALL {_starred('reversal', 'reversal_star')}"
_RULE_STATS = ", ".join(f"COUNT(q{h}) AS n_{h}d, {r(f'AVG(q{h})', f'mean_{h}d')}, {r(f'AVG(CASE WHEN q{h} > 0 THEN 1.0e0 WHEN q{h} IS NOT NULL THEN 0 END)', f'positive_{h}d')}" for h in HORIZONS)
_RULE_RETURNS = f"SELECT s.*, {', '.join(f'h{h}.close / latest_price - 1 AS q{h}' for h in HORIZONS)} FROM ({_BOTH_RULES}) s JOIN ses a ON a.code = s.code AND a.date = evaluation_date " + " ".join(f"LEFT JOIN ses h{h} ON h{h}.code = s.code AND h{h}.no = a.no + {h}" for h in HORIZONS)


@query(sql(f"SELECT star_mode, COUNT(*) AS events, {_RULE_STATS} FROM ({_RULE_RETURNS}) GROUP BY 1"))
def star_rule_comparison(spark, d):
    df = history.star_rule_comparison(evaluations(spark, d), lambda events: asof.forward_returns(events, T.prices(spark, d), HORIZONS, date="star_date"), HORIZONS)
    return df.select("star_mode", "events", *[f"n_{h}d" for h in HORIZONS], *rounded(df, *[f"{k}_{h}d" for h in HORIZONS for k in ("mean", "positive")]))


@query(sql("SELECT place, condition, horizon, n, " + r("CASE WHEN n > 0 THEN 100.0e0 * m END", "mean_percent") + " FROM (" + " UNION ALL ".join(f"SELECT place, condition, CAST({h} AS BIGINT) AS horizon, n_{h}d AS n, mean_{h}d AS m FROM ({PERFORMANCE})" for h in HORIZONS) + ")"))
def condition_heatmap(spark, d):
    df = history.condition_heatmap(performance_of(spark, d), HORIZONS)
    return df.select(F.col("place").cast("long").alias("place"), "condition", F.col("horizon").cast("long").alias("horizon"), "n", half_up(F.col("mean_percent")).alias("mean_percent"))


@query(sql(f"SELECT place, condition, n_90d AS n, {r('100.0e0 * mean_90d', 'mean_percent')}, {r('100.0e0 * positive_90d', 'positive_percent')} FROM ({PERFORMANCE}) WHERE n_90d > 0"))
def condition_bubbles(spark, d):
    df = history.condition_bubbles(performance_of(spark, d), 90)
    return df.select(F.col("place").cast("long").alias("place"), "condition", "n", *rounded(df, "mean_percent", "positive_percent"))


_TWO = f"SELECT s.code, h30.close / latest_price - 1 AS x, h90.close / latest_price - 1 AS y FROM ({STARS}) s JOIN ses a ON a.code = s.code AND a.date = evaluation_date LEFT JOIN ses h30 ON h30.code = s.code AND h30.no = a.no + 30 LEFT JOIN ses h90 ON h90.code = s.code AND h90.no = a.no + 90"
_BOTH = "FILTER (x IS NOT NULL AND y IS NOT NULL)"


@query(sql(f"SELECT * FROM (SELECT code, {r(f'100.0e0 * AVG(x) {_BOTH}', 'x_percent')}, {r(f'100.0e0 * AVG(y) {_BOTH}', 'y_percent')}, COUNT(*) AS stars, COUNT(*) {_BOTH} AS comparable FROM ({_TWO}) GROUP BY 1) WHERE comparable > 0"))
def security_bubbles(spark, d):
    df = history.security_bubbles(star_outcomes_of(spark, d), 30, 90)
    return df.select("code", "stars", "comparable", *rounded(df, "x_percent", "y_percent"))


_DAYS = "strftime(MIN(evaluation_date), '%Y-%m-%d') || ' to ' || strftime(MAX(evaluation_date), '%Y-%m-%d')"
_SHARE = "CAST(floor(({0}) / n * 1000.0e0 + 0.5e0) / 10.0e0 AS VARCHAR)"
_EVALUATED = f"""SELECT n || ' records of ' || codes || ' securities, ' || span AS extent, 'most often ' || symbol || ', ' || k || ' times (' || {_SHARE.format('k')} || '%)' AS most, high || ' high, ' || watch || ' to watch, ' || avoid || ' to avoid' AS classes,
    CASE WHEN open > 0 THEN open || ' unassessed (' || {_SHARE.format('open')} || '%), mostly too few sessions' END AS unassessed FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT code) AS codes, {_DAYS} AS span, count_if(intuitive_symbol IN ('◎☆', '◎')) AS high, count_if(intuitive_symbol IN ('○', '△')) AS watch,
    count_if(intuitive_symbol = '×') AS avoid, count_if(status = 'unassessed') AS open FROM ev8), (SELECT intuitive_symbol AS symbol, COUNT(*) AS k FROM ev8 GROUP BY 1 ORDER BY k DESC, symbol DESC LIMIT 1)"""


def with_reason(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", F.when(F.col("status") == "unassessed", "too few sessions"))


@query(sql(_EVALUATED))
def evaluation_summary(spark, d):
    return history.evaluation_summary(with_reason(evaluations(spark, d)))


_MEANS = f"SELECT horizon, COUNT(ret) AS n, AVG(ret) AS m FROM ({STAR_RETURNS}) GROUP BY 1"


@query(sql(f"SELECT n || ' events of ' || codes || ' securities' AS extent, (SELECT 'best after ' || horizon || ' sessions: ' || CAST(floor(m * 1000.0e0 + 0.5e0) / 10.0e0 AS VARCHAR) || '% over ' || n || ' events' FROM ({_MEANS}) WHERE n > 0 ORDER BY m DESC, horizon DESC LIMIT 1) AS best, (SELECT count_if(m > 0) || ' of ' || COUNT(*) || ' horizons above zero' FROM ({_MEANS}) WHERE n > 0) AS rising FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT code) AS codes FROM ({STARS}))"))
def star_summary(spark, d):
    outcomes = stored(star_outcomes_of(spark, d).select("code", *[f"return_{h}d" for h in HORIZONS]), "star-outcomes")
    return history.star_summary(outcomes, history.outcome_summary(outcomes, HORIZONS))


@query(sql("SELECT code, evaluation_date, intuitive_symbol FROM ev8 WHERE status = 'unassessed' AND code IN (SELECT DISTINCT code FROM ev8 WHERE status = 'unassessed' ORDER BY code LIMIT 20)"))
def reevaluation_batch(spark, d):
    return history.first_codes(evaluations(spark, d).where("status = 'unassessed'"), 20).select("code", "evaluation_date", "intuitive_symbol")


_STATES = "CASE WHEN t_score >= 5 THEN 'uptrend' WHEN t_score >= 2 THEN 'turning up' WHEN t_score <= -5 THEN 'clear downtrend' WHEN t_score <= -2 THEN 'downtrend' ELSE 'no direction' END"


@query(sql(f"SELECT as_of, code, badge AS intuitive_symbol, {r('close', 'latest_price')}, bar AS latest_market_date, {_STATES} AS latest_trend, 'backfilled' AS status, '' AS reason, legacy_star, reversal_star FROM bd UNION ALL SELECT as_of, 'unlisted', '', NULL, NULL, 'unavailable', 'unassessed', 'quote failed', NULL, NULL FROM dates"))
def reevaluation(spark, d):
    table = screened(spark, d).withColumn("selection_strategy", F.lit("value_dislocation"))
    unlisted = dates(spark).select("as_of", F.lit("unlisted").alias("code"), F.lit("value_dislocation").alias("selection_strategy"))
    df = screen.reevaluate(table.unionByName(unlisted, allowMissingColumns=True), T.prices(spark, d), dates(spark))
    return df.withColumn("latest_price", half_up(F.col("latest_price")))


@query(sql("SELECT ev8.code, name, evaluation_date, intuitive_symbol, status FROM ev8 JOIN comp USING (code) WHERE intuitive_symbol IN ('◎☆', '◎', '○') AND (lower(ev8.code) LIKE '%r#00000001%' OR lower(name) LIKE '%r#00000001%') AND status = 'same_day'"))
def history_search(spark, d):
    rows = with_reason(evaluations(spark, d)).join(T.companies(spark, d).select("code", "name"), "code")
    found = history.search_history(rows, " R#00000001 ", ("◎☆", "◎", "○"), ("same_day",), ("too few sessions",))
    return found.select("code", "name", "evaluation_date", "intuitive_symbol", "status")


@query(sql("SELECT code, evaluation_date FROM ev8 WHERE starts_with(intuitive_symbol, '◎☆')"))
def star_view(spark, d):
    return history.stars_only(evaluations(spark, d)).select("code", "evaluation_date")


@query(sql(f"SELECT s.code, evaluation_date AS star_date, 'sessions' AS basis, {r('CASE WHEN month(evaluation_date) > 6 THEN later / latest_price - 1 END', 'return_30d')} FROM ({STARS}) s JOIN (SELECT code, date, lead(close, 30) OVER (PARTITION BY code ORDER BY date) AS later FROM px) f ON f.code = s.code AND f.date = evaluation_date"))
def star_basis(spark, d):
    rows = star_outcomes_of(spark, d).withColumn("basis", F.when(F.month("star_date") > 6, "sessions").otherwise("calendar days"))
    df = history.same_basis_only(rows, "sessions", HORIZONS)
    return df.select("code", "star_date", "basis", half_up(F.col("return_30d")).alias("return_30d"))


_TEXTS = "CASE WHEN session_no % 5 = 0 THEN 'not run (bulk)' WHEN session_no % 5 = 1 THEN 'unavailable' WHEN session_no % 5 = 2 THEN '' ELSE 'uptrend' END AS trend, CASE WHEN session_no % 13 = 0 THEN 'stopped at the bulk limit' ELSE '' END AS note, CASE WHEN session_no % 4 = 0 THEN NULL ELSE close END AS price, CASE WHEN session_no % 6 = 0 THEN '' ELSE '○' END AS symbol"


@query(sql(f"SELECT code, date, CASE WHEN starts_with(trend, 'not run') OR note LIKE '%bulk limit%' THEN 'bulk limit' WHEN trend = 'unavailable' THEN 'quote failed' WHEN symbol <> '' AND trend = '' AND price IS NULL THEN '' WHEN price IS NULL THEN 'quote failed' WHEN symbol <> '' THEN '' ELSE 'other' END AS reason FROM (SELECT code, date, {_TEXTS} FROM tr)"))
def inferred_status(spark, d):
    n = F.col("session_no")
    rows = prices.trend_indicators(T.prices(spark, d)).select(
        "code", "date", F.lit(None).cast("string").alias("evaluation_status"), F.lit("").alias("unassessed_reason"), F.when(n % 5 == 0, "not run (bulk)").when(n % 5 == 1, "unavailable").when(n % 5 == 2, "").otherwise("uptrend").alias("latest_trend"),
        F.when(n % 13 == 0, "stopped at the bulk limit").otherwise("").alias("decision_note"), F.when(n % 4 != 0, F.col("close")).alias("latest_price"), F.when(n % 6 == 0, "").otherwise("○").alias("intuitive_symbol"),
    )
    return history.infer_status(rows).select("code", "date", "reason")


# --- candidates, peers, recent rows ---------------------------------------------------------------------------------

_KIND = "CASE WHEN t_score - score_before IS NULL THEN 'unknown' WHEN t_score - score_before >= 3 THEN 'improving' WHEN t_score - score_before <= -3 THEN 'worsening' ELSE 'steady' END"


@query(sql(f"SELECT as_of, code, selected, badge, level, {_KIND} AS transition, CASE WHEN operating_margin < 0 THEN 'breached' ELSE 'clear' END AS invalidation_status, {r('qscore', 'strategy_score')} FROM bd JOIN (SELECT code, operating_margin AS newest_margin FROM ff WHERE as_of = DATE '2000-06-30') n USING (code)".replace("operating_margin < 0 THEN", "newest_margin < 0 THEN")))
def candidate_list(spark, d):
    rules = F.array(F.struct(F.lit("operating_margin").alias("metric"), F.lit("<").alias("operator"), F.lit(0.0).alias("threshold"), F.lit(True).alias("enabled")))
    newest = fundamentals.financial_features(T.financials(spark, d), dates(spark).where(F.col("as_of") == F.lit(AS_OF[-1]).cast("date")).select("as_of"))
    status = history.invalidation_status(newest.select("code", F.lit("").alias("free_text"), rules.alias("conditions")), newest, ("operating_margin",), ())
    df = screen.candidate_list(screened(spark, d), T.prices(spark, d), dates(spark), status)
    return df.select("as_of", "code", "selected", "badge", "level", "transition", "invalidation_status", half_up(F.col("strategy_score")).alias("strategy_score"))


@query(sql(f"SELECT as_of, code, {r('qscore', 'strategy_score')} FROM sel WHERE p_score"))
def score_passed(spark, d):
    return screened(spark, d).where("pass_score").select("as_of", "code", half_up(F.col("strategy_score")).alias("strategy_score"))


_PEERS = ("operating_margin", "equity_ratio", "drawdown_52w", "return_6m")


@query(sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT as_of, sector, '{m}' AS metric, COUNT({m}) AS peers, {r(f'median({m})', 'median')} FROM uni GROUP BY 1, 2" for m in _PEERS) + ") WHERE peers >= 5"))
def sector_reference(spark, d):
    df = review.sector_reference(universe(spark, d), _PEERS)
    return df.select("as_of", "sector", "metric", "peers", half_up(F.col("median")).alias("median"))


@query(sql(f"SELECT code, date, CAST(back AS BIGINT) AS back, {r('close')} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM px) WHERE back <= 260"))
def detail_prices(spark, d):
    df = review.recent_rows(T.prices(spark, d), "date", 260)
    return df.select("code", "date", F.col("back").cast("long").alias("back"), half_up(F.col("close")).alias("close"))


@query(sql("SELECT code, disclosure_date, statement_type, CAST(back AS BIGINT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY disclosure_date DESC) AS back FROM fin) WHERE back <= 20"))
def detail_filings(spark, d):
    return review.recent_rows(T.financials(spark, d), "disclosure_date", 20).select("code", "disclosure_date", "statement_type", F.col("back").cast("long").alias("back"))


@query(sql("SELECT code, disclosure_date, CAST(ahead AS BIGINT) AS ahead FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY disclosure_date) AS ahead FROM fin WHERE disclosure_date >= DATE '1998-12-31') WHERE ahead <= 5"))
def detail_upcoming(spark, d):
    return review.next_rows(T.financials(spark, d), "disclosure_date", F.lit(AS_OF[0]).cast("date"), 5).select("code", "disclosure_date", F.col("ahead").cast("long").alias("ahead"))


_WARNED = (
    ("relative_return_6m IS NULL", "no benchmark, relative rule not applied"), ("forecast_op_growth IS NULL", "no guidance"), ("cash_conversion_ratio IS NULL", "no cash conversion"), ("operating_margin_change_3y IS NULL", "margins too few"),
    ("forecast_revision_rate IS NULL", "no comparable guidance"), ("sector_relative_return_6m IS NULL", "too few peers"), ("NOT p_guard", "guard failed"), ("operating_cf_positive_ratio_3y IS NULL", "cash flow history too short"),
    ("COALESCE(financial_history_years, 0) < 3", "under three years of filings"), ("dividend IS NULL", "no dividend data"), ("dividend IS NOT NULL AND payout_ratio IS NULL", "no payout ratio"), ("dividend_change < 0", "dividend cut ahead"), ("v2 IS NULL", "attribution unknown"),
)


@query(sql("SELECT as_of, code, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _WARNED) + "], lambda x: x IS NOT NULL), ' / ') AS warnings FROM sel"))
def warnings_joined(spark, d):
    return review.warnings(screened(spark, d)).select("as_of", "code", F.array_join("warnings", " / ").alias("warnings"))


_LABELS = ("drawdown", "score", "market", "equity_ratio")


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS rule, as_of, count_if(selected OR failed = ['{k}']) AS n FROM (SELECT *, list_filter([{REASONS}], lambda x: x IS NOT NULL) AS failed FROM sel) GROUP BY 2" for k in _LABELS)))
def rule_eligibility(spark, d):
    rows = screened(spark, d)
    found = F.array_compact(F.array(*[F.when(review.eligible_for_rule(rows, k), F.lit(k)) for k in _LABELS]))
    every = F.array(*[F.struct(F.lit(k).alias("rule"), F.array_contains(found, k).alias("ok")) for k in _LABELS])
    return rows.select("as_of", F.explode(every).alias("x")).groupBy("x.rule", "as_of").agg(F.count_if("x.ok").alias("n"))


# --- quotes, reviews, texts -----------------------------------------------------------------------------------------


@query(sql(f"SELECT code, MAX(date) AS market_date, {r('MAX(close) FILTER (n = 1)', 'price')}, {r('MAX(close) FILTER (n = 2)', 'previous_close')}, {r('MAX(close) FILTER (n = 1) / MAX(close) FILTER (n = 2) - 1', 'change_pct')} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM px) WHERE n <= 2 GROUP BY 1"))
def latest_quotes(spark, d):
    df = review.latest_quotes(T.prices(spark, d))
    return df.select("code", "market_date", *rounded(df, "price", "previous_close", "change_pct"))


_QUOTED = "SELECT code, MAX(date) AS market_date, CAST(DATE '2001-11-30' - MAX(date) AS BIGINT) AS age_days, DATE '2001-11-30' - MAX(date) <= 7 AS fresh FROM px WHERE date <= DATE '2001-11-30' GROUP BY 1"


def quoted(spark, d) -> DataFrame:
    day = F.lit("2001-11-30").cast("date")
    return review.freshness(T.prices(spark, d).where(F.col("date") <= day), day)


@query(sql(_QUOTED))
def quote_freshness(spark, d):
    return quoted(spark, d).withColumn("age_days", F.col("age_days").cast("long"))


@query(sql(f"SELECT code, event_no, array_to_string(list_filter([CASE WHEN review_status <> 'approved' THEN 'review not approved' END, CASE WHEN NOT COALESCE(fresh, false) THEN 'data not fresh' END, CASE WHEN event_no % 2 = 0 THEN 'manual check open' END], lambda x: x IS NOT NULL), ', ') AS against, review_status = 'approved' AND COALESCE(fresh, false) AND event_no % 2 <> 0 AS allowed FROM ev LEFT JOIN ({_QUOTED}) q USING (code)"))
def order_preview(spark, d):
    rows = T.external_events(spark, d).join(quoted(spark, d), "code", "left")
    rows = rows.select("code", "event_no", F.col("review_status").alias("approval_status"), F.lit(True).alias("valid"), "fresh", (F.col("event_no") % 2 != 0).alias("manual_done"))
    return review.order_preview(rows).select("code", "event_no", F.array_join("against", ", ").alias("against"), "allowed")


@query("SELECT n_nationkey AS nation, CAST(row_number() OVER (ORDER BY lower(n_name)) AS BIGINT) AS by_name, CAST(row_number() OVER (ORDER BY n_nationkey DESC) AS BIGINT) AS by_number FROM nation")
def dynamic_sort(spark, d):
    from pyspark.sql import Window

    rows = T.table(spark, d, "nation").withColumn("number", F.col("n_nationkey").cast("string"))
    place = lambda c, up: F.row_number().over(Window.orderBy(*review.sort_order(rows, c, up))).cast("long")  # noqa: E731  a page of rows
    return rows.select(F.col("n_nationkey").alias("nation"), place("n_name", True).alias("by_name"), place("number", False).alias("by_number"))


@query("SELECT c_custkey AS customer, regexp_replace(regexp_replace(trim(c_name), '[^0-9A-Za-zぁ-んァ-ヶ一-龠_-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS profile, lower(regexp_replace('PER (' || c_name || ')', '[\\s()#/-]', '', 'g')) AS header, CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS japanese FROM customer")
def text_functions(spark, d):
    name = F.col("c_name")
    mark = F.when(F.col("c_custkey") % 2 == 0, F.concat(name, F.lit("株価"))).otherwise(name)
    header = F.regexp_replace(review.header_key(F.concat(F.lit("PER ("), name, F.lit(")"))), "#", "")
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), review.profile_name(name).alias("profile"), header.alias("header"), review.contains_japanese(mark).alias("japanese"))


@query("SELECT c_custkey AS customer, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS publisher, 'https://x.example/' || c_custkey AS url FROM customer WHERE c_custkey % 5 <> 0")
def news_items(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    link = F.concat(F.lit("https://x.example/"), key.cast("string"))
    old = F.to_json(F.struct(name.alias("title"), link.alias("link"), F.lit("old").alias("publisher")))
    new = F.to_json(F.struct(F.struct(name.alias("title"), F.struct(link.alias("url")).alias("canonicalUrl"), F.struct(F.lit("new").alias("displayName")).alias("provider")).alias("content")))
    untitled = F.to_json(F.struct(link.alias("url")))
    rows = T.table(spark, d, "customer").select(key.alias("customer"), F.when(key % 5 == 0, untitled).when(key % 2 == 0, old).otherwise(new).alias("item"))
    return review.news_items(rows).select("customer", "title", "publisher", "url")


@query("SELECT n_nationkey AS nation, CAST(n_nationkey AS VARCHAR) AS whole, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey // 4 AS VARCHAR) ELSE CAST(n_nationkey / 4 AS VARCHAR) END AS quarters FROM nation")
def threshold_texts(spark, d):
    n = F.col("n_nationkey").cast("double")
    return T.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), review.threshold_text(n).alias("whole"), review.threshold_text(n / 4.0).alias("quarters"))


@query(sql(f"SELECT date, {r('index_close')} FROM idx"))
def index_normalised(spark, d):
    rows = T.index_series(spark, d)
    raw = rows.select(F.col("date").cast("string").alias("Date"), F.col("index_close").alias("C"), F.lit(1).alias("loaded"))
    raw = raw.unionByName(raw.withColumn("C", F.col("C") + 1).withColumn("loaded", F.lit(0))).unionByName(raw.withColumn("C", F.lit(None).cast("double")))
    return readers.normalize_index(raw).select("date", half_up(F.col("index_close")).alias("index_close"))


@query("SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN length(CAST(o_custkey AS VARCHAR)) = 4 THEN CAST(o_custkey AS VARCHAR) || '0' ELSE CAST(o_custkey AS VARCHAR) END AS code, o_orderpriority AS name, CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS fiscal_year, '' AS quarter FROM orders")
def earnings_normalised(spark, d):
    raw = T.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("Date"), F.col("o_custkey").alias("Code"), F.col("o_orderpriority").alias("CoName"), F.year(F.col("o_orderdate").cast("date")).alias("FY"))
    return readers.normalize_earnings(raw).select("date", "code", "name", "fiscal_year", "quarter")


@query(sql("SELECT code, name, sector, code IN (SELECT code FROM sel WHERE selected) AS is_candidate FROM comp"))
def import_master(spark, d):
    imported = T.companies(spark, d).select("code", F.lit(None).cast("string").alias("name"))
    return readers.join_master(imported, T.companies(spark, d), screened(spark, d).where("selected")).select("code", "name", "sector", "is_candidate")
