"""Operators on small tables: exact values, nulls, and no look-ahead."""

import datetime as dt

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hinode.functions.scalars import coerce_flag, display_code, half_up, normalize_code, scale
from hinode.operators import asof, criteria, decision, fundamentals, history, portfolio, prices, scoring, search, walkforward
from hinode.sources import readers

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def bars(spark, closes, code="1"):
    rows = [(code, day(i), float(c), float(c) * 1.02, float(c) * 0.98, 100.0, float(c) * 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "code string, date date, close double, high double, low double, volume double, turnover double")


def one_date(spark, d):
    return spark.createDataFrame([(d,)], "as_of date")


def test_scalars(spark):
    rows = spark.createDataFrame([("7203", "Yes"), ("72030", "0"), (" 0012 ", "maybe"), ("x", None)], "c string, f string")
    got = rows.select(normalize_code(F.col("c")).alias("n"), display_code(normalize_code(F.col("c"))).alias("s"), coerce_flag(F.col("f")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("72030", "7203", True), ("72030", "7203", False), ("00120", "0012", None), (None, None, None)]
    got = spark.createDataFrame([(0.5,), (None,), (9.0,)], "x double").select(scale(F.col("x"), 0, 1, 8).alias("a"), scale(F.col("x"), 0, 1, 8, True).alias("b"), half_up(F.col("x"), 0).alias("c")).collect()
    assert [tuple(r) for r in got] == [(4.0, 4.0, 1.0), (0.0, 0.0, None), (8.0, 0.0, 9.0)]


def test_features_ignore_the_future(spark):
    closes = [100 + i % 7 for i in range(60)]
    as_of = one_date(spark, day(39))
    known = prices.price_features(bars(spark, closes[:40]), as_of).first()
    poisoned = prices.price_features(bars(spark, closes[:40] + [1e6] * 20), as_of).first()
    assert known == poisoned and known.session_no == 40
    assert known.return_6m == pytest.approx(closes[39] / closes[0] - 1)
    assert known.index_return_6m is None and known.relative_return_6m is None


def test_filings_are_read_once_and_dealt_by_code_before_the_dates(spark, tmp_path):
    rows = [(str(c), dt.date(2020 + y, 5, d), kind, 2020 + y, kind == "FY", 100.0 + y + d, 5.0 + d, 4.0, 0.1, 2.0, 80.0, 40.0, 9.0, None, 6.0 + d, 1.0, None, None, 0.3) for c in range(3) for y in range(4) for d, kind in ((1, "FY"), (9, "FY"), (9, "2Q"))]
    schema = "code string, disclosure_date date, statement_type string, fiscal_year int, is_full_year_actual boolean, sales double, operating_profit double, operating_cf double, eps double, book_value_per_share double, total_assets double, equity double, cash double, interest_bearing_debt double, forecast_operating_profit double, actual_annual_dividend_per_share double, forecast_annual_dividend_per_share double, next_forecast_annual_dividend_per_share double, actual_payout_ratio double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "filings"))
    dates = spark.createDataFrame([(dt.date(2021, 5, 5),), (dt.date(2024, 1, 1),)], "as_of date")
    found = fundamentals.financial_features(spark.read.parquet(str(tmp_path / "filings")), dates)
    assert str(tmp_path / "filings") not in "".join(found.inputFiles())
    newest = {(r.as_of.year, r.code): (r.financial_history_years, r.financial_disclosure_date, r.operating_profit_latest, r.forecast_revision_from) for r in found.collect()}
    # the newest filing of the last year counts; of one day, FY stands behind 2Q; guidance for another year is no revision
    assert newest == {(a, str(c)): x for c in range(3) for a, x in ((2021, (2, dt.date(2021, 5, 1), 6.0, None)), (2024, (3, dt.date(2023, 5, 9), 14.0, 7.0)))}


def test_short_histories_are_dropped(spark):
    assert prices.price_features(bars(spark, range(1, 30)), one_date(spark, day(100))).count() == 0


def test_trend_of_a_rise_and_a_fall(spark):
    up = prices.trend_indicators(bars(spark, [100 * 1.01**i for i in range(220)])).where(F.col("session_no") == 220).first()
    down = prices.trend_indicators(bars(spark, [100 * 0.99**i for i in range(220)])).where(F.col("session_no") == 220).first()
    assert (up.trend_state, down.trend_state) == ("uptrend", "clear downtrend")
    assert up.rsi14 is None and down.rsi14 == pytest.approx(0.0)


def test_attribution_values(spark):
    rows = spark.createDataFrame([(-0.4, 0.0, -0.2, 8), (-0.4, -0.2, -0.1, 8), (-0.1, -0.4, -0.2, 8), (-0.4, 0.1, 0.1, 8), (0.1, -0.2, 0.0, 8), (-0.4, -0.2, None, 8), (-0.4, -0.2, -0.1, 4), (None, -0.2, -0.1, 8)], "return_6m double, sector_return_6m_median double, index_return_6m double, sector_peer_count_6m int")
    v2 = [r.external_shock_attribution for r in scoring.add_attribution(rows).collect()]
    assert v2 == [0.0, 0.5, 1.0, 0.0, None, 0.5, None, None]
    v1 = scoring.add_attribution(rows, "v1_legacy").collect()
    assert [r.external_shock_attribution for r in v1][:4] == [pytest.approx(0.5), pytest.approx(0.5), 1.0, 0.0] and v1[5].external_shock_attribution is None
    assert [r.external_shock_attribution_reason for r in v1][4:] == ["no fall", "no comparison", "too few peers", "no comparison"]


def test_scores_stay_in_bounds_and_null_is_no_points(spark):
    names = "sales_cagr_3y operating_margin operating_cf_positive_ratio_3y equity_ratio forecast_op_growth per pbr per_vs_sector pbr_vs_sector drawdown_52w relative_return_6m operating_profit_latest".split()
    best = (0.2, 0.3, 1.0, 0.8, 0.5, 1.0, 0.1, 0.1, 0.1, -0.9, -0.9, 1.0)
    rows = spark.createDataFrame([best, (None,) * 12], ", ".join(f"{n} double" for n in names))
    a, b = scoring.add_scores(rows).collect()
    assert (a.quality_score, a.valuation_score, a.dislocation_score, a.quantitative_score, a.review_penalty) == (40.0, 20.0, 25.0, 85.0, 28.0)
    assert a.red_flags == ["event not approved", "no source"]
    assert (b.quantitative_score, b.score) == (0.0, 0.0)


def test_revision_keeps_the_last_different_guidance(spark):
    rows = [("1", day(0), "FY", 2023, 100.0), ("1", day(90), "1Q", 2024, 75.0), ("1", day(180), "2Q", 2024, 75.0)]
    filings = spark.createDataFrame(rows, "code string, disclosure_date date, statement_type string, fiscal_year int, forecast_operating_profit double").withColumn("as_of", F.lit(day(200)))
    r = fundamentals.forecast_revisions(filings).first()
    assert (r.forecast_revision_target_year, r.forecast_revision_from, r.forecast_revision_rate) == (2024, 100.0, -0.25)


def test_forward_returns_count_sessions_strictly_after(spark):
    rows = [("1", d, c) for d, c in zip([dt.date(2026, 1, 8), dt.date(2026, 1, 9), dt.date(2026, 1, 12), dt.date(2026, 1, 13), dt.date(2026, 1, 14)], [100.0, 101.0, 110.0, 120.0, 125.0], strict=True)]
    px = spark.createDataFrame(rows, "code string, date date, close double")
    anchors = spark.createDataFrame([("1", dt.date(2026, 1, 9), 101.0), ("1", dt.date(2026, 1, 11), 101.0), ("2", dt.date(2026, 1, 9), 5.0), ("1", dt.date(2026, 1, 14), 125.0)], "code string, as_of date, entry_price double")
    got = {(r["code"], r["as_of"]): r for r in asof.forward_returns(anchors, px, (1, 3)).collect()}
    r = got["1", dt.date(2026, 1, 9)]
    assert r.return_3d == pytest.approx(125 / 101 - 1) and r.actual_days_3d == 5 and r.return_1d == pytest.approx(110 / 101 - 1)
    assert got["1", dt.date(2026, 1, 11)].return_1d == pytest.approx(110 / 101 - 1)
    assert got["2", dt.date(2026, 1, 9)].return_1d is None and got["1", dt.date(2026, 1, 14)].return_1d is None
    late = asof.forward_returns(anchors.limit(1), px, (1,), delay=2).first()
    assert late.return_1d == pytest.approx(125 / 120 - 1)
    assert asof.calendar_returns(anchors.limit(1), px, (2,)).first().calendar_return_2d == pytest.approx(110 / 101 - 1)


def test_gap_dedupe_and_stars(spark):
    rows = spark.createDataFrame([("1", day(n)) for n in (0, 10, 29, 35, 50, 80)], "code string, analysis_date date")
    assert sorted(r.analysis_date for r in asof.spaced_events(rows, 30).collect()) == [day(0), day(35), day(80)]
    marks = ["△", "◎☆", "◎☆", "◎", "◎☆", "◎☆"]
    made = [("1", day(i), None if i == 3 else 100.0, m, "ok", None, None) for i, m in enumerate(marks)]
    evaluations = spark.createDataFrame(made, "code string, evaluation_date date, latest_price double, intuitive_symbol string, latest_trend string, legacy_star string, reversal_star string").withColumn("latest_market_date", F.lit(None).cast("date"))
    assert [r.star_date for r in history.star_events(evaluations).collect()] == [day(1)]
    assert history.star_events(evaluations, "reversal").count() == 0


def test_episodes_are_runs_of_replay_numbers(spark):
    events = spark.createDataFrame([("1", 1), ("1", 2), ("1", 4), ("2", 2)], "code string, snapshot_no int").withColumn("as_of", F.date_add(F.lit(DAY), F.col("snapshot_no")))
    rows = walkforward.add_episodes(events)
    assert {r.episode_id for r in rows.collect()} == {"1:1", "1:4", "2:2"}
    assert walkforward.first_of_episode(rows).count() == 3


def test_percent_ranks_share_ties(spark):
    rows = spark.createDataFrame([(DAY, v, v, v) for v in (1.0, 2.0, 2.0, None)], "as_of date, volatility_60d double, average_intraday_range_20d double, average_turnover_20d double")
    got = sorted(r.activity_score for r in criteria.activity_score(rows).collect())
    assert got == pytest.approx([0.0, 100 / 3, 100 * 2.5 / 3, 100 * 2.5 / 3])


def test_invalidation_priorities(spark):
    c = "array<struct<metric:string,operator:string,threshold:double,enabled:boolean>>"
    reviews = [("1", "", [("m", "<", 10.0, True)]), ("2", "", [("m", "<", 10.0, True)]), ("3", "text", []), ("4", "", []), ("5", "", [("m", ">=", 99.0, True), ("k", "<", 1.0, False)])]
    features = spark.createDataFrame([("1", 0.05), ("2", None), ("5", 0.5)], "code string, m double")
    got = history.invalidation_status(spark.createDataFrame(reviews, f"code string, free_text string, conditions {c}"), features, ("m",), ("m",))
    assert {r.code: r.status for r in got.collect()} == {"1": "breached", "2": "unevaluable", "3": "manual review", "4": "not configured", "5": "clear"}


def test_orders_stay_within_the_total(spark):
    rows = spark.createDataFrame([(str(i), 500.0 + i, float(i)) for i in range(12)], "code string, close double, score double")
    got = portfolio.order_proposals(rows, max_position=0.2, risk=0.05).collect()
    assert sum(r.amount for r in got) <= 1_800_000 and all(r.quantity % 100 == 0 and r.quantity > 0 for r in got)
    assert got[0].code == "11"


def test_backtest_follows_a_plain_loop(spark):
    closes = {"1": [10, 11, 12, 13, 14, 15], "2": [20, 19, 18, 17, 16, 15], "3": [5, 5, 5, 5, 5, 5]}
    px = spark.createDataFrame([(c, day(i), float(v)) for c, some in closes.items() for i, v in enumerate(some)], "code string, date date, close double")
    picks = {1: ["1", "2"], 4: ["2", "3"]}
    signals = spark.createDataFrame([(day(d), c, 10.0 - i) for d, some in picks.items() for i, c in enumerate(some)], "signal_date date, code string, score double")
    got = {r.date: r.equity for r in portfolio.backtest_curve(signals, px, 2, 10_000.0, 0.001).collect()}
    cash, held = 10_000.0, {}
    for i in range(6):
        if i in picks:
            cash += sum(q * closes[c][i] for c, q in held.items()) * 0.999
            target, held = cash / 2, {}
            for c in picks[i]:
                held[c] = target * 0.999 // closes[c][i]
            cash -= sum(q * closes[c][i] * 1.001 for c, q in held.items())
        assert got[day(i)] == pytest.approx(cash + sum(q * closes[c][i] for c, q in held.items()))


def test_gap_dedupe_and_signals_cover_all_years(spark):
    from hinode.queries import QUERIES, signals
    from hinode.sources import driver_tables

    root = "/root/testdata/sf0.001"
    if not Path(root).is_dir():
        pytest.skip("no driver tables here")
    bars = sorted({(r.code, r.date) for r in driver_tables.prices(spark, root).select("code", "date").collect()})
    kept, last = [], {}
    for code, date in bars:
        if code not in last or (date - last[code]).days >= 30:
            last[code] = date
            kept.append((code, date))
    assert sorted((r.code, r.analysis_date) for r in QUERIES["gap_dedupe_fold"](spark, root).collect()) == kept
    years = {r.y for r in signals(spark, root).selectExpr("year(signal_date) AS y").distinct().collect()}
    assert years >= {d.year for _, d in bars if d.year > 1996}


def test_search_names(spark):
    rows = spark.createDataFrame([("72030", "トヨタ自動車株式会社"), ("67580", "ソニーグループ"), ("12340", "Alpha Beta Holdings")], "code string, name string")
    first = lambda q: search.search_companies(rows, q).first()
    assert (first("とよた").code, first("7203").match_type, first("ｱﾙﾌｧ"), first("alpha beta").match_type) == ("72030", "code", None, "name prefix")


def test_funnel_never_grows(spark):
    import random

    rng = random.Random(1)
    names = sorted({k for _, some in criteria.STAGES for k in some})
    rows = spark.createDataFrame([tuple(rng.random() < 0.9 for _ in names) + (False, False, False) for _ in range(200)], ", ".join(f"pass_{n} boolean" for n in names) + ", attribution_below boolean, attribution_missing_failed boolean, attribution_skipped boolean")
    counts = [r.n for r in criteria.funnel(rows).orderBy("place").collect()][:9]
    assert counts[0] == 200 and counts == sorted(counts, reverse=True)


def test_readiness_without_evidence(spark):
    r = decision.readiness(spark.createDataFrame([("1",)], "code string")).first()
    assert r.evidence_score == 0 and {c.status for c in r.checks} == {"unknown"}


def test_contracts_and_stores(spark, tmp_path):
    raw = spark.createDataFrame([("2024-01-05", "7203", "1", "2", "3", "x")], "date string, code string, close string, high string, low string, volume string")
    row = readers.check_contract(raw, "prices").first()
    assert (row.date, row.code, row.close, row.volume) == (dt.date(2024, 1, 5), "72030", 1.0, None)
    with pytest.raises(readers.ContractError):
        readers.check_contract(raw.drop("close"), "prices")
    readers.write_bundle({"bars": bars(spark, [1, 2, 3])}, str(tmp_path / "bundle"))
    assert readers.read_bundle(spark, str(tmp_path / "bundle"))["bars"].count() == 3
    for n in (1, 2, 1):
        readers.write_day(bars(spark, [1] * n), str(tmp_path / "days"), "day", f"2024-01-0{n}")
    assert readers.read_days(spark, str(tmp_path / "days"), "day", "2024-01-02").count() == 2
    assert readers.covered_window("covers 2024-02-01 to 2024-03-01", "2024-01-01", "2024-12-31") == ("2024-02-01", "2024-03-01")


def test_upsert_and_collapse(spark):
    old = spark.createDataFrame([("1", 1, 10.0), ("2", 1, 20.0)], "code string, stamp int, x double")
    new = spark.createDataFrame([("2", 2, 21.0, "n"), ("3", 2, 30.0, "n")], "code string, stamp int, x double, note string")
    got = history.upsert(old, new, ["code"], "stamp")
    assert sorted((r.code, r.x, r.note) for r in got.collect()) == [("1", 10.0, None), ("2", 21.0, "n"), ("3", 30.0, "n")]
    days = spark.createDataFrame([(day(0), "a"), (day(1), "a"), (day(2), "b"), (day(3), "a")], "d date, v string")
    assert sorted(r.d for r in history.collapse_repeats(days, "d", ["v"]).collect()) == [day(0), day(2), day(3)]


def test_streaming_transitions(spark, tmp_path):
    from hinode.streaming import incremental

    schema = "code string, evaluation_date date, latest_price double, is_star boolean"
    rows = [("1", day(i), None if i == 2 else 1.0, s) for i, s in enumerate([False, True, False, True, False, True])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.star_transitions(incremental.read_days_as_stream(spark, str(tmp_path / "in"), schema))
    q = stream.writeStream.format("memory").queryName("stars").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.evaluation_date for r in spark.table("stars").collect()) == [day(1), day(5)]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


QUICK = ("rolling_feature_store", "financial_last3", "forecast_revision", "event_strength_argmax", "trend_state", "calendar_forward_return", "star_events", "evaluation_pivot", "gap_dedupe_fold", "invalidation_rules", "scalar_functions", "matched_controls", "demo_screen", "star_rule_comparison", "evaluation_summary", "inferred_status", "detail_filings", "order_preview", "sector_reference", "signal_backtest", "news_items")


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import math
    import os

    from hinode.queries import ORACLES, QUERIES

    root = "/root/testdata/sf0.001"
    if not os.path.isdir(root):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 4) + 0.0
        return v

    got = QUERIES[name](spark, root)
    names = sorted(got.columns)
    cursor = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})")
    expected = [tuple(map(plain, r)) for r in cursor.fetchall()]
    assert sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=str) == sorted(expected, key=str)
