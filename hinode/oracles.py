"""The queries of hinode.queries restated as SQL over the driver's tables."""

from __future__ import annotations

AS_OF = ("1998-12-31", "1999-06-30", "2000-06-30")
#: Fixed: sessions after which outcomes are taken.
HORIZONS = (10, 20, 30, 60, 90, 180)

#: Common tables, each using only earlier ones.
TABLES = {
    "dates": "",
    "px": """SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date, SUM(l_extendedprice) / SUM(l_quantity) AS close, MAX(l_extendedprice / l_quantity) AS high,
        MIN(l_extendedprice / l_quantity) AS low, CAST(SUM(l_quantity) AS DOUBLE) AS volume, CAST(SUM(l_extendedprice) AS DOUBLE) AS turnover FROM lineitem GROUP BY 1, 2""",
    "idx": "SELECT CAST(l_shipdate AS DATE) AS date, SUM(l_extendedprice) / SUM(l_quantity) AS index_close FROM lineitem GROUP BY 1",
    "comp": """SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, r_name AS sector, CASE n_nationkey % 3 WHEN 0 THEN 'Prime' WHEN 1 THEN 'Standard' ELSE 'Growth' END AS market,
        abs(s_acctbal) * 100.0e0 + 1000.0e0 AS shares_outstanding FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "yr": "SELECT CAST(l_suppkey AS BIGINT) AS k, CAST(year(CAST(l_shipdate AS DATE)) AS BIGINT) AS fy, SUM(l_extendedprice * (1.0e0 - l_discount)) AS s FROM lineitem GROUP BY 1, 2",
    "yo": "SELECT k, fy, s, s * CAST(((k * 7 + fy * 5) % 23) - 4 AS DOUBLE) / 100.0e0 AS op FROM yr",
    "fin": """SELECT CAST(k AS VARCHAR) AS code, make_date(fy + 1, 5, 1 + k % 20) AS disclosure_date, 'FY' AS statement_type, fy AS fiscal_year, true AS is_full_year_actual, s AS sales, op AS operating_profit,
        CASE WHEN (k + fy) % 9 <> 0 THEN op * (0.4e0 + CAST((k + fy) % 7 AS DOUBLE) / 10.0e0) - CASE WHEN (k * fy) % 5 = 0 THEN s * 0.03e0 ELSE 0.0e0 END END AS operating_cf,
        s * 1.5e0 AS total_assets, s * 1.5e0 * (0.15e0 + CAST(k % 9 AS DOUBLE) * 0.06e0) AS equity, s * 0.2e0 AS cash, CASE WHEN k % 5 <> 0 THEN s * 0.1e0 END AS debt, op * 0.6e0 / 1000.0e0 AS eps,
        s * 1.5e0 * (0.15e0 + CAST(k % 9 AS DOUBLE) * 0.06e0) / 1000.0e0 AS bps, CASE WHEN k % 11 <> 0 THEN op * (0.7e0 + CAST((k * 3 + fy) % 6 AS DOUBLE) / 10.0e0) END AS fop,
        CASE WHEN op > 0 THEN op * 0.6e0 / 1000.0e0 * 0.3e0 END AS div_a, CASE WHEN k % 4 = 0 AND op > 0 THEN op * 0.6e0 / 1000.0e0 * 0.33e0 END AS div_f,
        CASE WHEN k % 6 = 1 AND op > 0 THEN op * 0.6e0 / 1000.0e0 * 0.25e0 END AS div_n, CASE WHEN op > 0 THEN 0.3e0 END AS payout FROM yo
        UNION ALL BY NAME
        SELECT CAST(k AS VARCHAR) AS code, make_date(fy + 1, 11, 1 + k % 20) AS disclosure_date, '2Q' AS statement_type, fy + 1 AS fiscal_year, false AS is_full_year_actual, s * 1.5e0 AS total_assets,
        s * 1.5e0 * (0.14e0 + CAST(k % 9 AS DOUBLE) * 0.06e0) AS equity, CASE WHEN k % 11 <> 0 THEN op * (0.6e0 + CAST((k * 5 + fy) % 6 AS DOUBLE) / 10.0e0) END AS fop FROM yo WHERE (k + fy) % 3 = 0""",
    "num": "SELECT p.*, idx.index_close, row_number() OVER w AS session_no, CASE WHEN row_number() OVER w > 1 THEN close / lag(close) OVER w - 1.0e0 END AS change FROM px p LEFT JOIN idx USING (date) WINDOW w AS (PARTITION BY code ORDER BY date)",
    "roll": """SELECT code, date, close, session_no, index_close, lead(date) OVER w AS next_date, MAX(high) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high_52w,
        CASE WHEN session_no > 1 THEN close / first_value(close) OVER (w ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) - 1.0e0 END AS return_6m,
        CASE WHEN count(index_close) OVER (w ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) >= 2 THEN last_value(index_close) OVER (w ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) / first_value(index_close) OVER (w ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) - 1.0e0 END AS index_return_6m,
        count(change) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n60, stddev_samp(change) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS sd60,
        AVG((high - low) / close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rng, AVG(abs(change)) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS absret, AVG(turnover) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS turn
        FROM num WINDOW w AS (PARTITION BY code ORDER BY date)""",
    "pf": """SELECT as_of, code, date, close, session_no, close / high_52w - 1.0e0 AS drawdown_52w, return_6m, index_return_6m, return_6m - index_return_6m AS relative_return_6m,
        CASE WHEN n60 >= 20 THEN sd60 * sqrt(252.0e0) END AS volatility_60d, rng AS average_intraday_range_20d, absret AS average_absolute_return_20d, turn AS average_turnover_20d
        FROM roll JOIN dates ON date <= as_of AND (next_date IS NULL OR next_date > as_of) WHERE session_no >= 30""",
    "known": "SELECT fin.*, as_of FROM fin JOIN dates ON disclosure_date <= as_of",
    "ann": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, code ORDER BY fiscal_year DESC) AS back FROM (SELECT *, row_number() OVER (PARTITION BY as_of, code, fiscal_year ORDER BY disclosure_date DESC) AS n FROM known
        WHERE is_full_year_actual) WHERE n = 1) WHERE back <= 3""",
    "ann2": """SELECT as_of, code, COUNT(*) AS years, arg_min(sales, fiscal_year) AS s0, arg_max(sales, fiscal_year) AS s1, arg_max(operating_profit, fiscal_year) AS op1, MAX(CASE WHEN back = 1 THEN operating_cf END) AS cf1, arg_max(eps, fiscal_year) AS eps,
        arg_max(operating_profit / sales, fiscal_year) AS m1, arg_min(operating_profit / sales, fiscal_year) AS m0, COUNT(operating_cf) AS ncf, AVG(CASE WHEN operating_cf > 0 THEN 1.0e0 ELSE 0.0e0 END) AS cfs FROM ann GROUP BY 1, 2""",
    "newest": """SELECT as_of, code, MAX(disclosure_date) AS financial_disclosure_date, MAX(CASE WHEN r = 1 THEN equity / total_assets END) AS equity_ratio, MAX(CASE WHEN r = 1 THEN cash - debt END) AS net_cash, MAX(CASE WHEN r = 1 THEN bps END) AS bps,
        arg_max(div_a, disclosure_date) FILTER (WHERE div_a IS NOT NULL) AS da, arg_max(div_f, disclosure_date) FILTER (WHERE div_f IS NOT NULL) AS df, arg_max(div_n, disclosure_date) FILTER (WHERE div_n IS NOT NULL) AS dn,
        arg_max(payout, disclosure_date) FILTER (WHERE payout IS NOT NULL) AS pay FROM (SELECT *, row_number() OVER (PARTITION BY as_of, code ORDER BY disclosure_date DESC, statement_type DESC) AS r FROM known) GROUP BY 1, 2""",
    "fc": "SELECT as_of, code, disclosure_date, statement_type, fop, CASE WHEN statement_type = 'FY' THEN fiscal_year + 1 ELSE fiscal_year END AS target, row_number() OVER (PARTITION BY as_of, code ORDER BY disclosure_date DESC, statement_type DESC) AS r FROM known WHERE fop IS NOT NULL",
    "rev": """SELECT a.as_of, a.code, a.fop AS fop_now, a.target, COALESCE(arg_min(b.fop, b.r) FILTER (WHERE b.fop <> a.fop), arg_min(b.fop, b.r)) AS fop_from FROM fc a LEFT JOIN fc b ON a.as_of = b.as_of AND a.code = b.code AND b.r > 1 AND b.target = a.target
        WHERE a.r = 1 GROUP BY 1, 2, 3, 4""",
    "ff": """SELECT as_of, code, years AS financial_history_years, CASE WHEN years > 1 AND s0 > 0 AND s1 > 0 THEN pow(s1 / s0, 1.0e0 / (years - 1)) - 1.0e0 END AS sales_cagr_3y, CASE WHEN s1 > 0 THEN op1 / s1 END AS operating_margin,
        CASE WHEN years >= 2 THEN m1 - m0 END AS operating_margin_change_3y, op1 AS operating_profit_latest, CASE WHEN op1 > 0 THEN cf1 / op1 END AS cash_conversion_ratio, CASE WHEN ncf > 0 THEN cfs END AS operating_cf_positive_ratio_3y, ncf AS operating_cf_observed_years,
        eps, financial_disclosure_date, equity_ratio, net_cash, bps AS book_value_per_share, COALESCE(dn, df, da) AS dividend, CASE WHEN dn IS NOT NULL THEN 'next guidance' WHEN df IS NOT NULL THEN 'guidance' WHEN da IS NOT NULL THEN 'actual' ELSE 'none' END AS dividend_source,
        CASE WHEN dn IS NULL AND df IS NULL THEN pay END AS payout_ratio, CASE WHEN da > 0 THEN COALESCE(dn, df, da) / da - 1.0e0 END AS dividend_change, fop_now AS forecast_operating_profit, target AS forecast_revision_target_year, fop_from AS forecast_revision_from,
        CASE WHEN fop_from > 0 THEN fop_now / fop_from - 1.0e0 END AS forecast_revision_rate, CASE WHEN op1 > 0 THEN fop_now / op1 - 1.0e0 END AS forecast_op_growth FROM ann2 JOIN newest USING (as_of, code) LEFT JOIN rev USING (as_of, code)""",
    "u0": """SELECT *, COUNT(return_6m) OVER (PARTITION BY as_of, sector) AS peers, median(return_6m) OVER (PARTITION BY as_of, sector) AS sector_median, close * shares_outstanding AS market_cap, CASE WHEN eps > 0 THEN close / eps END AS per,
        CASE WHEN book_value_per_share > 0 THEN close / book_value_per_share END AS pbr FROM pf JOIN ff USING (as_of, code) JOIN comp USING (code)""",
    "uni": """SELECT *, CASE WHEN peers >= 5 THEN return_6m - sector_median END AS sector_relative_return_6m, per / nullif(median(per) OVER (PARTITION BY as_of, sector), 0) AS per_vs_sector, pbr / nullif(median(pbr) OVER (PARTITION BY as_of, sector), 0) AS pbr_vs_sector FROM u0""",
    "att": """SELECT *, CASE WHEN return_6m < 0 AND peers >= 5 THEN least(greatest(least(greatest(-sector_median, 0), -return_6m) / -return_6m, 0), 1) END AS v2,
        CASE WHEN return_6m < 0 AND peers >= 5 AND index_return_6m IS NOT NULL THEN least(greatest(least(greatest(-index_return_6m, 0) + greatest(-(sector_median - index_return_6m), 0), -return_6m) / -return_6m, 0), 1) END AS v1 FROM uni""",
}


def _scale(x: str, low: float, high: float, points: int, inverse: bool = False) -> str:
    part = f"least(greatest(({x} - ({low!r}e0)) / ({high!r}e0 - ({low!r}e0)), 0), 1)"
    return f"CASE WHEN {x} IS NULL THEN 0 ELSE ({'1 - ' if inverse else ''}{part}) * {points} END"


QUALITY = " + ".join((_scale("sales_cagr_3y", -0.05, 0.1, 8), _scale("operating_margin", 0.0, 0.15, 8), _scale("operating_cf_positive_ratio_3y", 0.34, 1.0, 8), _scale("equity_ratio", 0.2, 0.6, 8), _scale("forecast_op_growth", -0.15, 0.2, 8)))
VALUATION = " + ".join((_scale("per", 6.0, 18.0, 5, True), _scale("pbr", 0.6, 1.8, 5, True), _scale("per_vs_sector", 0.55, 1.1, 5, True), _scale("pbr_vs_sector", 0.55, 1.1, 5, True)))


def _dislocation(weight: str) -> str:
    return _scale(f"(-COALESCE(drawdown_52w, 0) * {weight})", 0.15, 0.45, 14) + " + " + _scale(f"(-COALESCE(relative_return_6m, 0) * {weight})", 0.05, 0.3, 11)


PENALTY = "(CASE WHEN operating_profit_latest <= 0 THEN 18 ELSE 0 END + CASE WHEN forecast_op_growth < -0.2e0 THEN 10 ELSE 0 END + CASE WHEN equity_ratio < 0.2e0 THEN 10 ELSE 0 END)"
TABLES["sc"] = f"SELECT *, {QUALITY} AS quality, {VALUATION} AS valuation, {_dislocation('1.0e0')} AS depth, {_dislocation('COALESCE(v2, 0.5e0)')} AS explained, {PENALTY} AS penalty FROM att"
TABLES["act"] = (
    "SELECT *, 100 * (0.45e0 * COALESCE((rank() OVER (PARTITION BY as_of ORDER BY volatility_60d NULLS LAST) + (COUNT(*) OVER (PARTITION BY as_of, volatility_60d) - 1) / 2.0e0) / nullif(COUNT(volatility_60d) OVER (PARTITION BY as_of), 0), 0)"
    " + 0.35e0 * (rank() OVER (PARTITION BY as_of ORDER BY average_intraday_range_20d) + (COUNT(*) OVER (PARTITION BY as_of, average_intraday_range_20d) - 1) / 2.0e0) / COUNT(average_intraday_range_20d) OVER (PARTITION BY as_of)"
    " + 0.20e0 * (rank() OVER (PARTITION BY as_of ORDER BY average_turnover_20d) + (COUNT(*) OVER (PARTITION BY as_of, average_turnover_20d) - 1) / 2.0e0) / COUNT(average_turnover_20d) OVER (PARTITION BY as_of)) AS activity,"
    " least(greatest(quality + valuation + depth - penalty, 0), 85) AS qscore FROM sc"
)
#: Thresholds of the loose screen that the queries use: the driver's prices are noise, so few would pass the defaults.
TABLES["cr"] = """SELECT *, market IN ('Prime', 'Standard', 'Growth') AS p_market, COALESCE(average_turnover_20d >= 1000, false) AS p_liquidity, COALESCE(close >= 200, false) AS p_price, COALESCE(equity_ratio >= 0.2e0, false) AS p_equity_ratio,
    COALESCE(operating_profit_latest > 0, false) AS p_operating_profit, COALESCE(operating_cf_positive_ratio_3y >= 0.6e0, false) AS p_cf_history, COALESCE(sales_cagr_3y >= -0.5e0, true) AS p_sales_trend, COALESCE(operating_margin >= 0, false) AS p_margin,
    COALESCE(drawdown_52w <= -0.18e0, false) AS p_drawdown, COALESCE(relative_return_6m <= 0.10e0, true) AS p_relative, true AS p_attribution, COALESCE(forecast_op_growth >= -0.35e0, true) AS p_forecast,
    COALESCE(cash_conversion_ratio >= 0.35e0, true) AND COALESCE(operating_margin_change_3y >= -0.10e0, true) AND COALESCE(forecast_revision_rate >= -0.30e0, true) AND COALESCE(sector_relative_return_6m >= -0.40e0, true) AS p_guard, qscore >= 25 AS p_score FROM act"""
TABLES["sel"] = """SELECT *, p_market AND p_liquidity AND p_price AND p_equity_ratio AND p_operating_profit AND p_cf_history AND p_sales_trend AND p_margin AND p_drawdown AND p_relative AND p_attribution AND p_forecast AND p_guard AS hard,
    p_market AND p_liquidity AND p_price AND p_equity_ratio AND p_operating_profit AND p_cf_history AND p_sales_trend AND p_margin AND p_drawdown AND p_relative AND p_attribution AND p_forecast AND p_guard AND p_score AS selected FROM cr"""
TABLES["ses"] = "SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS no FROM px"
TABLES["anc"] = "SELECT as_of, code, MAX(no) AS n0, arg_max(close, no) AS entry_price FROM ses JOIN dates ON date <= as_of GROUP BY 1, 2"
TABLES["ti"] = """SELECT *, CASE WHEN session_no >= 20 THEN AVG(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sma20, CASE WHEN session_no >= 50 THEN AVG(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS sma50,
    CASE WHEN session_no >= 200 THEN AVG(close) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma200, AVG(greatest(delta, 0)) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS g14, AVG(greatest(-delta, 0)) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS l14,
    close / lag(close, 20) OVER w - 1 AS return_20d, close / lag(close, 60) OVER w - 1 AS return_60d, CASE WHEN session_no >= 20 THEN MAX(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS high20,
    CASE WHEN session_no >= 20 THEN MIN(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS low20, CASE WHEN session_no >= 60 THEN MIN(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS low60, CASE WHEN session_no >= 20 THEN volume / AVG(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS volume_ratio_20d, lead(date) OVER w AS next_date
    FROM (SELECT *, close - lag(close) OVER (PARTITION BY code ORDER BY date) AS delta FROM num) WINDOW w AS (PARTITION BY code ORDER BY date)"""
TABLES["tj"] = "SELECT *, CASE WHEN session_no >= 15 AND l14 > 0 THEN 100 - 100 / (1 + g14 / l14) END AS rsi14, lag(sma20, 5) OVER (PARTITION BY code ORDER BY date) AS sma20_before FROM ti"
TABLES["tr"] = """SELECT *, CASE WHEN close > sma20 THEN 1 WHEN close <= sma20 THEN -1 ELSE 0 END + CASE WHEN close > sma50 THEN 1 WHEN close <= sma50 THEN -1 ELSE 0 END + CASE WHEN close > sma200 THEN 1 WHEN close <= sma200 THEN -1 ELSE 0 END
    + CASE WHEN sma20 > sma50 THEN 1 WHEN sma20 <= sma50 THEN -1 ELSE 0 END + CASE WHEN sma20 > sma20_before THEN 1 WHEN sma20 <= sma20_before THEN -1 ELSE 0 END + CASE WHEN return_20d > 0 THEN 1 WHEN return_20d < -0.1e0 THEN -1 ELSE 0 END
    + CASE WHEN rsi14 BETWEEN 40 AND 65 THEN 1 WHEN rsi14 >= 75 THEN -1 ELSE 0 END + CASE WHEN close >= high20 * 0.995e0 THEN 1 ELSE 0 END + CASE WHEN close <= low20 * 1.005e0 THEN -1 ELSE 0 END AS trend_score FROM tj"""
TABLES["ev"] = """SELECT *, externality * temporary_probability * (0.6e0 + 0.4e0 * catalyst_probability) AS strength FROM (SELECT CAST(user_id % (SELECT MAX(s_suppkey) FROM supplier) + 1 AS VARCHAR) AS code, CAST(ts AS DATE) AS event_date, event_type AS category, event_id AS event_no,
    CAST((event_id * 7 + 3) % 101 AS DOUBLE) / 100 AS externality, CAST((event_id * 13 + 11) % 101 AS DOUBLE) / 100 AS temporary_probability, CAST((event_id * 29 + 5) % 101 AS DOUBLE) / 100 AS catalyst_probability, CASE WHEN event_id % 3 = 0 THEN 'approved' ELSE 'pending' END AS review_status FROM events)"""
#: Evaluations of securities at month ends, made from the trend.
TABLES["ev8"] = """SELECT code, date AS evaluation_date, close AS latest_price, trend_score, CASE WHEN trend_score >= 3 THEN '◎☆' WHEN trend_score >= 1 THEN '◎' WHEN trend_score = 0 THEN '○' WHEN trend_score >= -2 THEN '△' ELSE '×' END AS intuitive_symbol,
    CASE WHEN session_no % 7 = 0 THEN 'unassessed' ELSE 'same_day' END AS status, CASE WHEN session_no % 11 = 0 THEN 'unavailable' ELSE 'trend' END AS latest_trend, trend_score >= 5 AS reversal_star FROM tr"""


#: Readiness checks: key, column, weight, bounds that pass, bounds that warn.
CHECKS = (
    ("drawdown", "drawdown_52w", 12, (None, -0.20), (None, -0.12)), ("relative", "relative_return_6m", 8, (None, -0.08), (None, 0.0)), ("sales", "sales_cagr_3y", 10, (0.0, None), (-0.05, None)),
    ("margin", "operating_margin", 10, (0.05, None), (1e-300, None)), ("equity", "equity_ratio", 12, (0.40, None), (0.25, None)), ("ocf", "operating_cf_positive_ratio_3y", 12, (0.999, None), (0.66, None)),
    ("cash_quality", "cash_conversion_ratio", 8, (0.80, None), (0.50, None)), ("margin_stability", "operating_margin_change_3y", 6, (-0.02, None), (-0.05, None)),
    ("forecast_revision", "forecast_revision_rate", 8, (-0.05, None), (-0.15, None)), ("sector_relative", "sector_relative_return_6m", 6, (-0.10, None), (-0.20, None)),
    ("forecast", "forecast_op_growth", 10, (0.0, None), (-0.15, None)), ("dividend", "dividend / close", 8, (0.025, 0.06), (1e-300, 0.08)), ("payout", "payout_ratio", 8, (None, 0.60), (None, 0.85)),
    ("div_change", "dividend_change", 5, (0.0, None), (-0.10, None)), ("analyst", "CAST(NULL AS DOUBLE)", 5, (0.10, None), (-0.05, None)), ("trend", "t_score", 12, (2.0, None), (-1.0, None)),
    ("momentum", "return_20d", 6, (0.0, 0.15), (-0.10, 0.25)), ("rsi", "rsi14", 5, (40.0, 65.0), (30.0, 74.999999999)), ("volume", "volume_ratio_20d", 4, (1.2, 3.0), (0.7, 3.999999999)),
)


def _bounded(column: str, bounds: tuple) -> str:
    low, high = bounds
    return " AND ".join([f"({column}) >= {low!r}"] * (low is not None) + [f"({column}) <= {high!r}"] * (high is not None))


def _all(keys: tuple, test: str) -> str:
    return "(" + " AND ".join(f"c_{k} {test}" for k in keys) + ")"


_CORE = ("sales", "margin", "equity", "ocf", "forecast", "payout", "div_change", "trend")
_STRUCTURAL = ("cash_quality", "margin_stability", "forecast_revision", "sector_relative")
TABLES["now"] = "SELECT as_of, code, date AS bar, trend_score AS t_score, sma20, sma50, COALESCE(sma20 > sma20_before, false) AS sma20_rising, low20, return_20d, rsi14, volume_ratio_20d FROM tr JOIN dates ON date <= as_of AND (next_date IS NULL OR next_date > as_of)"
TABLES["trd"] = "SELECT now.*, b.trend_score AS score_before FROM now ASOF LEFT JOIN tr b ON b.code = now.code AND b.date <= bar - 90"
TABLES["chk"] = "SELECT *, " + ", ".join(f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {_bounded(x, good)} THEN 'pass' WHEN {_bounded(x, fair)} THEN 'warn' ELSE 'fail' END AS c_{k}" for k, x, _, good, fair in CHECKS) + " FROM sel LEFT JOIN trd USING (as_of, code)"
TABLES["pts"] = "SELECT *, " + " + ".join(f"CASE WHEN c_{k} = 'unknown' THEN 0.0e0 ELSE {w} END" for k, _, w, *_ in CHECKS) + " AS known_points, " + " + ".join(f"CASE c_{k} WHEN 'pass' THEN {w} WHEN 'warn' THEN {w} * 0.5e0 ELSE 0.0e0 END" for k, _, w, *_ in CHECKS) + " AS won_points, " + " + ".join(f"CASE WHEN c_{k} = 'fail' THEN 1 ELSE 0 END" for k, *_ in CHECKS) + " AS failures FROM chk"
_HARD = ("equity", "ocf", "cash_quality", "margin_stability", "forecast_revision", "sector_relative", "forecast", "margin", "trend")
TABLES["rd"] = f"""SELECT *, CASE WHEN {" OR ".join(f"c_{k} = 'fail'" for k in _HARD)} THEN 'stop' WHEN evidence_score >= 75 THEN 'consider' WHEN evidence_score >= 55 THEN 'research' ELSE 'stop' END AS level
    FROM (SELECT *, CAST(COALESCE(round_even(100.0e0 * won_points / nullif(known_points, 0), 0), 0) AS INTEGER) AS evidence_score FROM pts)"""
_PASS, _SOFT = "= 'pass'", "IN ('pass', 'unknown')"
TABLES["bd"] = f"""SELECT *, CASE WHEN strong AND reversal_star THEN '◎☆' WHEN strong THEN '◎' WHEN level = 'consider' THEN '○' WHEN level = 'research' THEN '△' ELSE '×' END AS badge FROM (SELECT *, level = 'consider' AND evidence_score >= 75 AND (escaped_downtrend OR COALESCE(t_score >= 2, false)) AS strong,
    legacy_star AND COALESCE(t_score >= 5, false) AND COALESCE(return_20d >= 0, false) AND COALESCE(close > sma20, false) AND COALESCE(sma20_rising, false) AND COALESCE(sma20 > sma50, false) AS reversal_star FROM (SELECT *, COALESCE(score_before <= -2 AND t_score >= 0, false) AS escaped_downtrend,
    COALESCE(level = 'consider' AND evidence_score >= 85 AND t_score >= 2 AND {_all(_CORE, _PASS)} AND {_all(_STRUCTURAL, _SOFT)} AND failures = 0, false) AS legacy_star FROM rd))"""

_LATER = [(f"r{h}", h) for h in HORIZONS]
#: Returns of every security from every replay date, at once and after a delay.
TABLES["ret"] = "SELECT anc.as_of, anc.code, " + ", ".join([f"h{h}.close / entry_price - 1.0e0 AS r{h}" for h in HORIZONS] + [f"l{d}_{h}.close / e{d}.close - 1.0e0 AS r{h}_{d}" for d in (3, 5) for h in HORIZONS]) + " FROM anc " + " ".join(
    [f"LEFT JOIN ses h{h} ON h{h}.code = anc.code AND h{h}.no = n0 + {h}" for h in HORIZONS] + [f"LEFT JOIN ses e{d} ON e{d}.code = anc.code AND e{d}.no = n0 + {d}" for d in (3, 5)] + [f"LEFT JOIN ses l{d}_{h} ON l{d}_{h}.code = anc.code AND l{d}_{h}.no = n0 + {d + h}" for d in (3, 5) for h in HORIZONS])
#: The 16 variants of the attribution gate, and the plain screen as one more.
_OTHERS = "p_market AND p_liquidity AND p_price AND p_equity_ratio AND p_operating_profit AND p_cf_history AND p_sales_trend AND p_margin AND p_drawdown AND p_forecast AND p_guard"
_V = f"{_OTHERS} AND (NOT relative OR COALESCE(relative_return_6m <= -0.08e0, true)) AND (minimum = 0 OR COALESCE(CASE WHEN method = 'v1_legacy' THEN v1 ELSE v2 END >= minimum, true))"
TABLES["selv"] = f"""SELECT sel.* EXCLUDE (selected), method || ':' || CAST(minimum AS VARCHAR) || ':' || CAST(relative AS VARCHAR) AS variant, {_V} AND p_score AS selected FROM sel, (SELECT unnest(['v2_sector_absolute', 'v1_legacy']) AS method), (SELECT unnest([0.0e0, 0.3e0, 0.5e0, 0.7e0]) AS minimum), (SELECT unnest([true, false]) AS relative)
    UNION ALL BY NAME SELECT sel.*, 'plain' AS variant FROM sel
    UNION ALL BY NAME SELECT sel.* EXCLUDE (selected), 'external_explained' AS variant, hard AND least(greatest(quality + valuation + explained - penalty, 0), 85) >= 25 AS selected FROM sel"""
TABLES["pool"] = "SELECT *, CASE WHEN market_cap IS NOT NULL THEN ln(1 + greatest(market_cap, 0)) END AS m1, drawdown_52w AS m2, volatility_60d AS m3, per_vs_sector AS m4, pbr_vs_sector AS m5 FROM selv"
_SPREAD = ", ".join(f"CASE WHEN COUNT(m{i}) >= 4 THEN quantile_cont(m{i}, 0.75) - quantile_cont(m{i}, 0.25) ELSE MAX(m{i}) - MIN(m{i}) END AS i{i}, stddev_samp(m{i}) AS d{i}" for i in range(1, 6))
_SCALES = ", ".join(f"CASE WHEN i{i} > 0 THEN i{i} WHEN d{i} > 0 THEN d{i} END AS s{i}" for i in range(1, 6))
_GAPS = " + ".join(f"CASE WHEN s{i} > 0 THEN COALESCE(abs(p.m{i} - t.m{i}) / s{i}, 0) ELSE 0 END" for i in range(1, 6))
_SEEN = " + ".join(f"CASE WHEN s{i} > 0 AND p.m{i} IS NOT NULL AND t.m{i} IS NOT NULL THEN 1 ELSE 0 END" for i in range(1, 6))
TABLES["scal"] = f"SELECT variant, as_of, {_SCALES} FROM (SELECT variant, as_of, {_SPREAD} FROM pool WHERE NOT selected GROUP BY 1, 2)"
TABLES["ctl"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, as_of, target ORDER BY tier, distance, code) AS place FROM (SELECT p.variant, p.as_of, t.code AS target, p.code, CASE WHEN p.sector = t.sector THEN 1 WHEN p.market = t.market THEN 2 ELSE 3 END AS tier,
    CASE WHEN ({_SEEN}) >= 2 THEN ({_GAPS}) / ({_SEEN}) END AS distance FROM pool p JOIN pool t ON p.variant = t.variant AND p.as_of = t.as_of AND t.selected AND NOT p.selected JOIN scal s ON s.variant = p.variant AND s.as_of = p.as_of) WHERE distance IS NOT NULL) WHERE place <= 5"""
TABLES["ctm"] = "SELECT variant, as_of, target AS code, " + ", ".join(f"AVG(r{h}) AS c{h}" for h in HORIZONS) + " FROM ctl JOIN ret USING (as_of, code) GROUP BY 1, 2, 3"
TABLES["wev"] = """SELECT *, code || ':' || MIN(snapshot_no) OVER (PARTITION BY variant, code, island) AS episode_id, row_number() OVER (PARTITION BY variant, code, island ORDER BY snapshot_no) AS nth FROM (SELECT v.*, snapshot_no, snapshot_no - row_number() OVER (PARTITION BY v.variant, v.code ORDER BY snapshot_no) AS island,
    CASE WHEN v.index_return_6m IS NULL THEN 'unknown' WHEN v.index_return_6m <= -0.05e0 THEN 'falling' WHEN v.index_return_6m >= 0.05e0 THEN 'rising' ELSE 'flat' END AS market_regime, ret.* EXCLUDE (as_of, code), ctm.* EXCLUDE (variant, as_of, code)
    FROM selv v JOIN dates USING (as_of) JOIN ret ON ret.as_of = v.as_of AND ret.code = v.code LEFT JOIN ctm ON ctm.variant = v.variant AND ctm.as_of = v.as_of AND ctm.code = v.code WHERE v.selected)"""
TABLES["wel"] = " UNION ALL ".join(f"SELECT variant, as_of, snapshot_no, code, market_regime, nth, CAST({h} AS BIGINT) AS horizon, r{h} AS r, c{h} AS c, r{h} - c{h} AS e FROM wev" for h in HORIZONS)


def sql(select: str, *tables: str, dates: tuple[str, ...] = AS_OF) -> str:
    """select over the named common tables and whatever these use, at these replay dates."""
    import re

    when = "SELECT CAST(d AS DATE) AS as_of, n AS snapshot_no FROM (VALUES " + ", ".join(f"('{d}', {i + 1})" for i, d in enumerate(dates)) + ") t(d, n)"
    need: set[str] = set()
    todo = list(tables) or [t for t in TABLES if re.search(rf"\b{t}\b", select)]
    while todo:
        t = todo.pop()
        if t not in need:
            need.add(t)
            todo += [u for u in TABLES if u != t and re.search(rf"\b{u}\b", TABLES[t])]
    if not need:
        return select
    return "WITH " + ",\n".join(f"{t} AS MATERIALIZED ({TABLES[t] if t != 'dates' else when})" for t in TABLES if t in need) + "\n" + select


def r(column: str, name: str | None = None) -> str:
    """A column rounded by steps that are the same in both engines."""
    return f"floor(({column}) * 10000.0e0 + 0.5e0) / 10000.0e0 AS {name or column}"
