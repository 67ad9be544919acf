"""Queries over stores and archives, and of the screen's gates that the other queries leave off."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinode.operators import asof, criteria, history, walkforward
from hinode.oracles import HORIZONS, r, sql
from hinode.plans import screen
from hinode.plans.detail import stock_detail
from hinode.queries import LOOSE, STARS, dates, evaluations, query, replay, rounded, star_outcomes_of, universe
from hinode.sources import coverage, masters, readers
from hinode.sources import driver_tables as T
from hinode.sources.store import scratch_path, stored
from hinode.sources.versions import Store

# --- the archive of masters -----------------------------------------------------------------------------------------

#: Days of masters, in the order in which they are archived: the last comes late.
MASTER_DAYS = ("1996-06-30", "2000-06-30", "1998-06-30")
ASKED = ("1996-01-01", "1997-01-01", "1998-06-30", "1999-06-30", "2001-01-01")
_TRADED = "SELECT code, MIN(date) AS first_bar FROM px GROUP BY 1"
_MASTERS = " UNION ALL ".join(
    f"SELECT DATE '{day}' AS master_date, code, sector, (SELECT MAX(fiscal_year) FROM fin WHERE fin.code = comp.code AND is_full_year_actual "
    f"AND disclosure_date <= DATE '{day}') AS last_year FROM comp JOIN ({_TRADED}) USING (code) WHERE first_bar <= DATE '{day}'"
    for day in MASTER_DAYS
)


def master_of(spark, d: str, day: str) -> DataFrame:
    """The securities that have traded by a day, with the last fiscal year that they had reported."""
    until = F.lit(day).cast("date")
    listed = T.prices(spark, d).groupBy("code").agg(F.min("date").alias("first_bar")).where(F.col("first_bar") <= until)
    filed = T.financials(spark, d).where(F.col("is_full_year_actual") & (F.col("disclosure_date") <= until))
    filed = filed.groupBy("code").agg(F.max("fiscal_year").alias("last_year"))
    return T.companies(spark, d).select("code", "sector").join(listed.select("code"), "code").join(filed, "code", "left")


@query(
    sql(
        f"SELECT as_of, master_date, code, sector, CAST(last_year AS BIGINT) AS last_year FROM ({_MASTERS}) JOIN (SELECT as_of, MAX(master_date) AS master_date "
        f"FROM dates, (SELECT unnest([{', '.join(f"DATE '{x}'" for x in MASTER_DAYS)}]) AS master_date) WHERE master_date <= as_of GROUP BY 1) USING (master_date)",
        dates=ASKED,
    )
)
def asof_master(spark, d):
    store = Store(spark, scratch_path(spark, "masters"))
    for day in MASTER_DAYS:
        masters.archive_master(store, master_of(spark, d, day), day)
    df = masters.masters_as_of(store, dates(spark, ASKED))
    return df.select("as_of", "master_date", "code", "sector", F.col("last_year").cast("long").alias("last_year"))


@query(
    sql(
        "SELECT as_of, COUNT(*) AS observable, count_if(m.code IS NOT NULL) AS covered, count_if(m.code IS NULL) AS missing FROM (SELECT DISTINCT as_of, px.code FROM px JOIN dates ON date <= as_of "
        "WHERE EXISTS (SELECT 1 FROM fin WHERE fin.code = px.code AND disclosure_date <= as_of)) o LEFT JOIN (SELECT code FROM comp WHERE market <> 'Growth') m USING (code) GROUP BY 1"
    )
)
def master_coverage(spark, d):
    """The master here knows the two larger markets."""
    master = T.companies(spark, d).where("market <> 'Growth'")
    return walkforward.cohort_audit(T.prices(spark, d), T.financials(spark, d), master, dates(spark))


#: Masters of the replays: the growth market joins with the second, which is archived first.
REPLAY_MASTERS = (("2000-01-31", "true"), ("1998-06-30", "market <> 'Growth'"))
_KNOWN = "SELECT as_of, comp.* FROM comp, dates WHERE as_of >= DATE '2000-01-31' OR market <> 'Growth'"


@query(
    sql(f"SELECT as_of, code, market, CAST(peers AS BIGINT) AS peers, {r('sector_relative_return_6m')}, selected FROM sel").replace(
        "JOIN comp USING (code)", f"JOIN ({_KNOWN}) known USING (as_of, code)"
    )
)
def point_in_time_screen(spark, d):
    """The screen of each replay date over the securities that the archived master of the day knew."""
    store = Store(spark, scratch_path(spark, "masters"))
    for day, listed in REPLAY_MASTERS:
        masters.archive_master(store, T.companies(spark, d).where(listed), day)
    known = masters.masters_as_of(store, dates(spark)).drop("master_date")
    bars, index = T.prices(spark, d), T.index_series(spark, d)
    rows = screen.prepare_universe(known, bars, T.financials(spark, d), dates(spark), index)
    df = criteria.apply_criteria(rows, LOOSE).withColumnRenamed("sector_peer_count_6m", "peers")
    return df.select("as_of", "code", "market", "peers", *rounded(df, "sector_relative_return_6m"), "selected")


# --- days, fingerprints, rewrites -----------------------------------------------------------------------------------

_MONTHS = "SELECT CAST(last_day(CAST(m AS DATE)) AS DATE) AS day FROM range(DATE '1996-01-01', DATE '2000-01-01', INTERVAL 1 MONTH) t(m)"
_REPORTED = f"SELECT day, comp.code, (SELECT MAX(fiscal_year) FROM fin WHERE fin.code = comp.code AND is_full_year_actual AND disclosure_date <= day) AS last_year FROM comp, ({_MONTHS})"


@query(
    sql(
        f"SELECT day AS date FROM (SELECT day, seen, lag(seen) OVER (ORDER BY day) AS before FROM (SELECT day, string_agg(code || ':' || COALESCE(last_year, 0), ' ' ORDER BY code) AS seen "
        f"FROM ({_REPORTED}) GROUP BY 1)) WHERE before IS NULL OR seen <> before"
    )
)
def distinct_days(spark, d):
    """Of the month-end lists of what each company had reported, the heads of runs of equal ones: most months change nothing."""
    months = spark.sql("SELECT last_day(m) AS date FROM (SELECT explode(sequence(DATE '1996-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS m)")
    grid = T.companies(spark, d).select("code").join(F.broadcast(months))  # 48 rows
    filed = T.financials(spark, d).where("is_full_year_actual").select("code", "disclosure_date", "fiscal_year")
    rows = asof.as_of_backward(grid, filed, "code", "date", "disclosure_date").select("date", "code", F.col("fiscal_year_r").alias("last_year"))
    return history.collapse_repeats(rows, "date", ["code", "last_year"]).select("date").distinct()


_CENTS = "CAST(floor(close * 10000.0e0 + 0.5e0) AS BIGINT)"
_PART = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"


@query(
    sql(
        f"SELECT date, COUNT(*) AS n, CAST(SUM({_PART.format(1)}) AS BIGINT) AS s1, CAST(SUM({_PART.format(9)}) AS BIGINT) AS s2 "
        f"FROM (SELECT date, md5(code || '|' || {_CENTS}) AS h FROM px) GROUP BY 1"
    )
)
def day_signatures(spark, d):
    rows = T.prices(spark, d).withColumn("cents", F.floor(F.col("close") * 10000.0 + 0.5).cast("long"))
    return history.portable_fingerprints(rows, "date", ["code", "cents"])


_EVENTS = f"SELECT comp.code, day, px.close AS given FROM comp CROSS JOIN ({_MONTHS}) LEFT JOIN px ON px.code = comp.code AND px.date = day"
_ENTERED = f"SELECT e.code, CASE WHEN given IS NULL THEN COALESCE(n.date, day) ELSE day END AS star_date, COALESCE(given, n.close) AS entry FROM ({_EVENTS}) e ASOF LEFT JOIN px n ON n.code = e.code AND day <= n.date"


@query(
    sql(
        f"SELECT v.code, star_date, {r('entry', 'entry_price')}, {r('h30.close / entry - 1.0e0', 'return_30d')}, CASE WHEN entry IS NOT NULL THEN CAST(h30.date - star_date AS BIGINT) END AS actual_days_30d, "
        f"{r('h180.close / entry - 1.0e0', 'return_180d')} FROM ({_ENTERED}) v ASOF LEFT JOIN ses a ON a.code = v.code AND a.date <= star_date LEFT JOIN ses h30 ON h30.code = v.code "
        "AND h30.no = COALESCE(a.no, 0) + 30 LEFT JOIN ses h180 ON h180.code = v.code AND h180.no = COALESCE(a.no, 0) + 180"
    )
)
def outcome_entries(spark, d):
    """Outcomes from month ends: entered at the close of the day, and where there is none at the first one after it."""
    bars = T.prices(spark, d)
    months = spark.sql("SELECT last_day(m) AS star_date FROM (SELECT explode(sequence(DATE '1996-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS m)")
    events = T.companies(spark, d).select("code").join(F.broadcast(months))  # 48 rows
    events = events.join(bars.select("code", F.col("date").alias("star_date"), F.col("close").alias("entry_price")), ["code", "star_date"], "left")
    df = history.enrich_outcomes(events, bars, HORIZONS)
    days = F.col("actual_days_30d").cast("long").alias("actual_days_30d")
    return df.select("code", "star_date", *rounded(df, "entry_price", "return_30d", "return_180d"), days)


CUT = "1999-06-30"
_LATER = " ".join(f"LEFT JOIN ses h{h} ON h{h}.code = s.code AND h{h}.no = a.no + {h}" for h in HORIZONS)


@query(
    sql(
        f"SELECT DISTINCT evaluation_date AS star_date FROM ({STARS}) s JOIN ses a ON a.code = s.code AND a.date = evaluation_date {_LATER} "
        f"WHERE evaluation_date > DATE '{CUT}' OR {' OR '.join(f"h{h}.date > DATE '{CUT}'" for h in HORIZONS)}"
    )
)
def outcome_rewrites(spark, d):
    """The days of star events that a store rewrites when bars after a date come in: those that are new, and those of which
    a return has matured since. The rest keeps its fingerprint and isn't written."""
    store, cut = Store(spark, scratch_path(spark, "outcomes")), F.lit(CUT).cast("date")
    known = evaluations(spark, d).where(F.col("evaluation_date") <= cut)
    events = history.star_events(known).select("code", "star_date", "entry_price")
    early = asof.forward_returns(events, T.prices(spark, d).where(F.col("date") <= cut), HORIZONS, date="star_date")
    store.commit_days("star_outcomes", early, "star_date")
    changed = store.commit_days("star_outcomes", star_outcomes_of(spark, d), "star_date")
    return spark.createDataFrame([(x,) for x in changed], "x string").select(F.to_date("x").alias("star_date"))


@query(
    sql(
        "SELECT code, f.date AS first_day, l.date AS last_day, CAST(g.no - before - 1 AS BIGINT) AS days FROM (SELECT code, no, lag(no) OVER (PARTITION BY code ORDER BY no) AS before FROM px JOIN cal USING (date)) g "
        "JOIN cal f ON f.no = before + 1 JOIN cal l ON l.no = g.no - 1 WHERE g.no - before > 1"
    ).replace("px AS MATERIALIZED", "cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS no FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)),\npx AS MATERIALIZED", 1)
)
def coverage_gaps(spark, d):
    """The ranges of market days on which a security has no bar, between its first and its last."""
    bars = T.prices(spark, d).select("code", "date")
    return coverage.missing_ranges(bars, T.index_series(spark, d).select("date"), ["code"])


# --- the bootstrap --------------------------------------------------------------------------------------------------

def _poisson_sql() -> str:
    """The weights of the bootstrap by the same mixing, a step a subquery."""
    import numpy as np

    rows = "SELECT code_no, s, e_h.*, (code_no + s * 1000003 + 20261019) % 2147483647 AS x FROM e_h, (SELECT unnest(range(2000)) AS s)"
    for shift, factor in ((15, 48271), (13, 69621), (16, 16807)):
        rows = f"SELECT * EXCLUDE (x), xor(x, x >> {shift}) * {factor} % 2147483647 AS x FROM ({rows})"
    chance = total = float(np.exp(-1.0))
    cases = [f"WHEN u < {total!r}e0 THEN 0"]
    for k in range(1, 12):
        chance /= k
        total += chance
        cases.append(f"WHEN u < {total!r}e0 THEN {k}")
    return f"SELECT horizon, s, e, CASE {' '.join(cases)} ELSE 12 END AS w FROM (SELECT *, (x + 0.5e0) / 2147483647.0e0 AS u FROM ({rows}))"


_EDGES = "SELECT horizon, e, CAST('0x' || substr(md5(code || '|' || strftime(as_of, '%Y-%m-%d')), 1, 7) AS BIGINT) AS code_no FROM wel WHERE variant = 'plain' AND nth = 1 AND e IS NOT NULL"


@query(
    sql(
        f"SELECT horizon, n, {r('CASE WHEN n >= 2 THEN low END', 'low')}, {r('CASE WHEN n >= 2 THEN high END', 'high')}, {r('CASE WHEN n >= 2 THEN none END', 'nonpositive_share')} FROM "
        f"(SELECT horizon, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, AVG(CASE WHEN m <= 0 THEN 1.0e0 ELSE 0 END) AS none FROM "
        f"(SELECT horizon, s, SUM(w * e) / SUM(w) AS m FROM ({_poisson_sql().replace('e_h.*', 'horizon, e').replace('FROM e_h,', f'FROM ({_EDGES}),')}) WHERE w > 0 GROUP BY 1, 2) GROUP BY 1) "
        f"JOIN (SELECT horizon, COUNT(e) AS n FROM wel WHERE variant = 'plain' AND nth = 1 GROUP BY 1) USING (horizon)"
    )
)
def wf_bootstrap(spark, d):
    df = walkforward.bootstrap_edges(replay(spark, d), HORIZONS)
    return df.select(F.col("horizon").cast("long").alias("horizon"), "n", *rounded(df, "low", "high", "nonpositive_share"))


# --- gates of the screen that are off by default --------------------------------------------------------------------

DIVIDENDS = replace(LOOSE, require_dividend=True, min_yield=0.001, max_yield=0.5, exclude_dividend_cut=True)
_DIVIDEND = (
    "COALESCE(dividend >= 0 AND dividend / close >= 0.001e0 AND dividend / close <= 0.5e0, false) AND COALESCE(payout_ratio <= 0.8e0, true) AND COALESCE(dividend_change >= 0, true)"
)


@query(sql(f"SELECT as_of, code, {_DIVIDEND} AS pass_dividend, hard AND {_DIVIDEND} AS hard_pass, selected AND {_DIVIDEND} AS selected FROM sel"))
def dividend_gate(spark, d):
    return criteria.apply_criteria(universe(spark, d), DIVIDENDS).select("as_of", "code", "pass_dividend", "hard_pass", "selected")


ACTIVE = replace(LOOSE, strategy="active_trading")


@query(
    sql(
        f"SELECT as_of, code, v AS pass_volatility, g AS pass_range, a AS pass_activity, p_market AND p_liquidity AND p_price AND v AND g AND a AS selected, {r('activity', 'strategy_score')} FROM (SELECT *, "
        "COALESCE(volatility_60d >= 0.35e0, false) AS v, COALESCE(average_intraday_range_20d >= 0.025e0, false) AS g, COALESCE(activity >= 50, false) AS a FROM sel)"
    )
)
def active_screen(spark, d):
    df = criteria.apply_criteria(universe(spark, d), ACTIVE)
    return df.select("as_of", "code", "pass_volatility", "pass_range", "pass_activity", "selected", *rounded(df, "strategy_score"))


_BACK = "OVER (PARTITION BY p.code ORDER BY p.date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"
_PROXY = (
    f"SELECT p.code, p.date, lead(p.date) OVER (PARTITION BY p.code ORDER BY p.date) AS until, CASE WHEN COUNT(q.close) {_BACK} >= 2 THEN "
    f"last_value(q.close IGNORE NULLS) {_BACK} / first_value(q.close IGNORE NULLS) {_BACK} - 1 END AS pr FROM px p LEFT JOIN px q ON q.code = '1' AND q.date = p.date"
)
_MODES = {
    "auto": ("COALESCE(o, x)", "CASE WHEN o IS NOT NULL THEN 'index' WHEN x IS NOT NULL THEN 'proxy' ELSE 'none' END"),
    "official": ("o", "CASE WHEN o IS NOT NULL THEN 'index' ELSE 'none' END"),
    "proxy": ("x", "CASE WHEN x IS NOT NULL THEN 'proxy' ELSE 'none' END"),
    "disabled": ("CAST(NULL AS DOUBLE)", "'disabled'"),
}
_COMPARED = f"SELECT u.as_of, u.code, return_6m - index_return_6m AS o, return_6m - pr AS x FROM uni u JOIN ({_PROXY}) f ON f.code = u.code AND f.date <= u.as_of AND (until IS NULL OR until > u.as_of)"


@query(sql(" UNION ALL ".join(f"SELECT as_of, code, '{mode}' AS mode, {r(value, 'relative')}, {source} AS source FROM ({_COMPARED})" for mode, (value, source) in _MODES.items())))
def benchmark_modes(spark, d):
    """The relative return of each mode; the fund is the first of a list that has bars."""
    bars = T.prices(spark, d)
    rows = screen.with_proxy(universe(spark, d), bars, dates(spark), readers.proxy_series(bars, ["no such fund", "1"]))
    rows = stored(rows.select("as_of", "code", "return_6m", "index_return_6m", "proxy_return_6m"), "benchmarks")
    out = None
    for mode in _MODES:
        one = criteria.resolve_benchmark(rows, mode).withColumn("relative", F.col("relative_return_6m"))
        one = one.select("as_of", "code", F.lit(mode).alias("mode"), *rounded(one, "relative"), F.col("benchmark_source").alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


# --- one security's page --------------------------------------------------------------------------------------------

_LAST = "SELECT code, MAX(date) AS as_of, arg_max(close, date) AS close FROM px GROUP BY 1"
_NEWEST = (
    "SELECT l.code, arg_max(equity / total_assets, disclosure_date) AS equity_ratio FROM fin JOIN (" + _LAST + ") l ON l.code = fin.code AND disclosure_date <= as_of GROUP BY 1"
)
_BARS = "SELECT code, MIN(date) AS first_bar, COUNT(*) AS bars FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM px) WHERE n <= 260 GROUP BY 1"
_FILED = "SELECT code, MIN(disclosure_date) AS first_filing, COUNT(*) AS filings FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY disclosure_date DESC) AS n FROM fin) WHERE n <= 20 GROUP BY 1"
_AHEAD = (
    "SELECT code, MIN(disclosure_date) AS next_date, COUNT(*) AS ahead FROM (SELECT fin.code, disclosure_date, row_number() OVER (PARTITION BY fin.code ORDER BY disclosure_date) AS n "
    f"FROM fin JOIN ({_LAST}) l ON l.code = fin.code AND disclosure_date >= as_of) WHERE n <= 5 GROUP BY 1"
)


@query(
    sql(
        f"SELECT comp.code, name, sector, as_of, {r('l.close', 'close')}, {r('drawdown', 'drawdown_52w')}, {r('equity_ratio')}, bars, first_bar, filings, first_filing, ahead, next_date FROM comp JOIN ({_LAST}) l USING (code) "
        f"JOIN (SELECT code, date, close / high_52w - 1 AS drawdown FROM roll) k ON k.code = comp.code AND k.date = as_of LEFT JOIN ({_NEWEST}) USING (code) JOIN ({_BARS}) USING (code) LEFT JOIN ({_FILED}) USING (code) LEFT JOIN ({_AHEAD}) USING (code)"
    )
)
def detail_page(spark, d):
    filings = T.financials(spark, d)
    earnings = filings.select("code", F.col("disclosure_date").alias("date"))
    df = stock_detail(T.companies(spark, d), T.prices(spark, d), filings, earnings, T.index_series(spark, d))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(c)
    first = lambda c, f, name: F.array_min(F.transform(c, lambda x: x[f])).alias(name)
    return df.select(
        "code", "name", "sector", "as_of", *rounded(df, "close", "drawdown_52w", "equity_ratio"), size("bars"), first("bars", "date", "first_bar"),
        size("filings"), first("filings", "disclosure_date", "first_filing"), size("ahead"), first("ahead", "date", "next_date"),
    )
