"""The decision level and the badge: exact values, with cases in which a looser or stricter rule would differ."""

import pytest
from pyspark.sql import functions as F

from hinode.operators import decision

GOOD = {
    "drawdown_52w": -0.30, "relative_return_6m": -0.12, "sales_cagr_3y": 0.04, "operating_margin": 0.12, "equity_ratio": 0.55,
    "operating_cf_positive_ratio_3y": 1.0, "forecast_op_growth": 0.05, "dividend_yield": 0.035, "payout_ratio": 0.45,
    "forecast_dividend_change_rate": 0.05, "target_upside": 0.20,
}
TURNED = {
    "trend_score": 5, "return_20d": 0.03, "close": 110.0, "sma20": 105.0, "sma50": 100.0, "sma20_rising": True, "score_before": -4,
}


def judged(spark, cases, quote=None):
    names = {k: "string" if k == "benchmark_source" else "boolean" if k == "sma20_rising" else "double" for c in cases for k in c}
    names |= {k: "boolean" if k == "sma20_rising" else "double" for k in TURNED}
    rows = [tuple(None if c.get(k) is None else c[k] if t != "double" else float(c[k]) for k, t in names.items()) for c in cases]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{k} {t}" for k, t in names.items()))
    return sorted(decision.badge(decision.readiness(df, quote)).collect(), key=lambda r: r.i)


def test_levels(spark):
    many = {**GOOD, **TURNED}
    weak = {"drawdown_52w": 0.0, "relative_return_6m": 0.10, "sales_cagr_3y": -0.2, "payout_ratio": 0.95, "forecast_dividend_change_rate": -0.5}
    cases = [
        ({**GOOD, "trend_score": 2}, 100, "consider"),
        # three failures that are not hard cost points, but don't stop
        ({**many, "payout_ratio": 0.95, "forecast_dividend_change_rate": -0.3, "target_upside": -0.2}, 85, "consider"),  # 100 of 118 points
        # a failed structural check alone stops, whatever the score
        ({**many, "cash_conversion_ratio": 0.1}, 94, "stop"),
        ({**many, "operating_margin_change_3y": -0.3}, 95, "stop"),
        ({**many, "forecast_revision_rate": -0.3}, 94, "stop"),
        ({**many, "sector_relative_return_6m": -0.3}, 95, "stop"),
        ({**many, "trend_score": -3}, 90, "stop"),
        # failed sales cost points and don't stop
        ({**many, "sales_cagr_3y": -0.15}, 92, "consider"),
        # points between 55 and 75, and below
        ({"equity_ratio": 0.5, "drawdown_52w": 0.0}, 50, "stop"),
        ({"equity_ratio": 0.5, "operating_margin": 0.1, "drawdown_52w": 0.0}, 65, "research"),
        ({**weak, "equity_ratio": 0.5}, 22, "stop"),
        ({}, 0, "stop"),
    ]
    got = judged(spark, [c for c, *_ in cases])
    assert [(r.evidence_score, r.level) for r in got] == [(s, level) for _, s, level in cases]


def test_hard_failures_and_downtrend_stop(spark):
    hard = {"drawdown_52w": -0.40, "sales_cagr_3y": -0.15, "operating_margin": -0.05, "equity_ratio": 0.15, "operating_cf_positive_ratio_3y": 0.0, "forecast_op_growth": -0.40}
    down = {"drawdown_52w": -0.30, "sales_cagr_3y": 0.03, "operating_margin": 0.08, "equity_ratio": 0.5, "operating_cf_positive_ratio_3y": 1.0, "forecast_op_growth": 0.02, "trend_score": -6, "return_20d": -0.14, "rsi14": 27, "volume_ratio_20d": 1.8}
    got = judged(spark, [hard, down])
    assert [r.level for r in got] == ["stop", "stop"] and got[0].failures == 5
    assert [c.key for c in got[1].checks if c.status == "fail"] == ["trend", "momentum", "rsi"]


@pytest.mark.parametrize("quote, level", [(True, "consider"), (False, "research"), (None, "research")])
def test_a_quote_is_needed_to_consider(spark, quote, level):
    assert judged(spark, [GOOD], F.lit(quote).cast("boolean"))[0].level == level


def test_a_source_that_is_no_benchmark_makes_the_comparison_unknown(spark):
    sources = ["index", "proxy", "none", "disabled", "", None]
    got = judged(spark, [{"relative_return_6m": -0.12, "equity_ratio": 0.3, "benchmark_source": s} for s in sources])
    status = [next(c.status for c in r.checks if c.key == "relative") for r in got]
    assert status == ["pass", "pass", "unknown", "unknown", "pass", "pass"]
    assert [r.evidence_score for r in got] == [70, 70, 50, 50, 70, 70]


def test_star_needs_quality_and_all_five_signs_of_a_turn(spark):
    whole = {**GOOD, **TURNED}
    turns = [{}, {"trend_score": 4}, {"return_20d": -0.001}, {"close": 104.0}, {"sma20_rising": False}, {"sma20": 99.0}]
    got = judged(spark, [{**whole, **t} for t in turns])
    assert [(r.legacy_star, r.reversal_star, r.badge) for r in got] == [(True, True, "◎☆")] + [(True, False, "◎")] * 5


def test_star_is_withheld_for_concerns(spark):
    whole = {**GOOD, **TURNED}
    concerns = [{"cash_conversion_ratio": 0.6}, {"payout_ratio": None}, {"target_upside": -0.2}, {"sales_cagr_3y": -0.01}, {"payout_ratio": 0.95}]
    got = judged(spark, [{**whole, **x} for x in concerns])
    assert [(r.legacy_star, r.level, r.badge) for r in got] == [(False, "consider", "◎")] * 5


def test_badges_of_lesser_rows(spark):
    cases = [
        ({**GOOD, "trend_score": 1, "score_before": -4}, "◎"),
        ({**GOOD, "trend_score": 1, "score_before": 0}, "○"),
        ({**GOOD, "trend_score": None}, "○"),
        ({"equity_ratio": 0.5, "operating_margin": 0.1, "drawdown_52w": 0.0}, "△"),
        ({"equity_ratio": 0.1}, "×"),
        ({"drawdown_52w": 0.0}, "×"),
    ]
    assert [r.badge for r in judged(spark, [c for c, _ in cases])] == [b for _, b in cases]
