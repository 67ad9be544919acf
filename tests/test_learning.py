"""Rule learning: the status of a run, what is learned from a history of good and bad securities, and brute force."""

import datetime as dt
import math
import random
import statistics

import pytest

from hinode.operators import learning
from hinode.operators.criteria import ScreenConfig

START = dt.date(2024, 1, 1)
SETTINGS = learning.LearningConfig(enabled=True, auto_apply=True, least_events=40, holdout_sessions=0, cooldown_days=0)
SCREEN = ScreenConfig(min_score=42.0)
HISTORY = (
    "code string, analysis_date date, close double, selected boolean, fail_reasons array<string>, selection_strategy string, "
    + ", ".join(f"{r.column} double" for r in learning.RULES)
)


def measures(**own):
    usual = {
        "equity_ratio": 0.50, "operating_cf_positive_ratio_3y": 1.0, "sales_cagr_3y": 0.04, "operating_margin": 0.10,
        "forecast_op_growth": 0.05, "drawdown_52w": -0.19, "relative_return_6m": -0.12, "quantitative_score": 60.0,
    }
    return [{**usual, **own}[r.column] for r in learning.RULES]


def history(spark, count=100):
    """Securities of which every other one has fallen further and recovers."""
    rows, bars = [], []
    for i in range(count):
        code, day, good = f"{10000 + i}", START + dt.timedelta(days=2 * i), i % 2 == 0
        rows.append((code, day, 100.0, True, [], "value_dislocation", *measures(drawdown_52w=-0.25 if good else -0.19)))
        for days, up, down in ((0, 100.0, 100.0), (30, 105.0, 99.0), (90, 120.0, 96.0), (180, 125.0, 95.0)):
            bars.append((code, day + dt.timedelta(days=days), up if good else down))
    return spark.createDataFrame(rows, HISTORY), spark.createDataFrame(bars, "code string, date date, close double")


def test_a_robust_change_is_applied(spark):
    state = learning.learn(*history(spark), SCREEN, SETTINGS, today=START)
    assert state.status == "auto_applied" and state.mature >= 40 and state.applied_on == START
    assert set(state.overlay) == {"minimum_drawdown_52w"} and state.overlay["minimum_drawdown_52w"] <= -0.21
    assert state.best["check_gain"] >= 0.02 and state.best["train_gain"] >= 0.01
    # of the days 70 % train: 70 events, then 30; half of each are good
    assert (state.best["n_train"], state.best["n_check"], state.best["retention"]) == (35, 15, 0.5)
    assert state.best["check_gain"] == pytest.approx(0.20 - (0.20 - 0.04) / 2)
    changed = learning.with_overlay(SCREEN, {**state.overlay, "minimum_externality": 0.9, "queue": 1})
    assert changed.min_drawdown == state.overlay["minimum_drawdown_52w"] and changed.queue == SCREEN.queue
    assert SCREEN.min_drawdown == -0.18


def test_a_proposal_without_auto_apply_changes_nothing(spark):
    settings = learning.LearningConfig(enabled=True, least_events=40, holdout_sessions=0)
    state = learning.learn(*history(spark), SCREEN, settings)
    assert state.status == "proposal_ready" and state.best and state.overlay == {} and state.applied_on is None


def test_runs_that_end_early(spark):
    few = history(spark, 10)
    state = learning.learn(*few, SCREEN, SETTINGS)
    assert (state.status, state.mature) == ("insufficient_history", 10)
    assert learning.learn(*few, SCREEN, learning.LearningConfig()).status == "disabled"
    waiting = learning.LearningState("auto_applied", overlay={"minimum_drawdown_52w": -0.24}, applied_on=START)
    settings = learning.LearningConfig(enabled=True, cooldown_days=30)
    state = learning.learn(*few, SCREEN, settings, waiting, START + dt.timedelta(days=29))
    assert state.status == "cooldown" and state.overlay == waiting.overlay and state.applied_on == START
    state = learning.learn(*few, SCREEN, settings, waiting, START + dt.timedelta(days=30))
    assert state.status == "insufficient_history" and state.overlay == waiting.overlay
    nothing = [df.limit(0) for df in few]
    assert learning.learn(*nothing, SCREEN, SETTINGS).status == "insufficient_history"
    same = [(f"{i}", START + dt.timedelta(days=i), 100.0, True, [], None, *measures()) for i in range(80)]
    flat = [(f"{i}", START + dt.timedelta(days=i + d), 100.0) for i in range(80) for d in (0, 30, 90, 180)]
    whole = spark.createDataFrame(same, HISTORY), spark.createDataFrame(flat, "code string, date date, close double")
    assert learning.learn(*whole, SCREEN, SETTINGS).status == "no_robust_improvement"


def test_the_last_sessions_are_held_out(spark):
    days = [d for d in (dt.date(2024, 1, 2) + dt.timedelta(days=k) for k in range(800)) if d.weekday() < 5][:400]
    bars = spark.createDataFrame([("1000", d, 100.0 + k) for k, d in enumerate(days)], "code string, date date, close double")
    rows = [("1000", days[k], 100.0, False, [], "value_dislocation", *measures()) for k in (100, 300)]
    settings = learning.LearningConfig(enabled=True, holdout_sessions=60)
    events = learning.mature_events(spark.createDataFrame(rows, HISTORY), bars, settings).collect()
    assert {(r.analysis_date, r.held_out) for r in events} == {(days[100], False), (days[300], True)}
    state = learning.learn(spark.createDataFrame(rows, HISTORY), bars, SCREEN, settings)
    assert (state.status, state.mature, state.before_holdout) == ("insufficient_history", 1, 2)
    # with fewer sessions than are to be held out, all are
    all_held = learning.LearningConfig(enabled=True, holdout_sessions=500)
    assert {r.held_out for r in learning.mature_events(spark.createDataFrame(rows, HISTORY), bars, all_held).collect()} == {True}


def test_events_are_spaced_and_of_the_screen(spark):
    days = [0, 10, 29, 30, 45, 60, 60]
    rows = [("1", START + dt.timedelta(days=d), 100.0 + i, True, [], None, *measures()) for i, d in enumerate(days)]
    rows += [("2", START, 100.0, True, [], "active_trading", *measures()), (None, START, 1.0, True, [], "", *measures()), ("3", None, 1.0, True, [], "", *measures())]
    bars = [("1", START + dt.timedelta(days=d), 100.0) for d in range(0, 400, 5)]
    prices = spark.createDataFrame(bars, "code string, date date, close double")
    settings = learning.LearningConfig(holdout_sessions=0)
    got = sorted(((r.analysis_date - START).days, r.close) for r in learning.mature_events(spark.createDataFrame(rows, HISTORY), prices, settings).collect())
    assert got == [(0, 100.0), (30, 103.0), (60, 105.0)]
    unspaced = learning.LearningConfig(holdout_sessions=0, gap_days=0)
    assert learning.mature_events(spark.createDataFrame(rows, HISTORY), prices, unspaced).count() == 7


def test_the_history_is_computed_once(spark, tmp_path):
    rows = [(str(c), START + dt.timedelta(days=40 * k), 100.0, True, [], "", *measures()) for c in range(3) for k in range(4)]
    spark.createDataFrame(rows, HISTORY).write.parquet(str(tmp_path / "history"))
    bars = spark.createDataFrame([(str(c), START + dt.timedelta(days=d), 100.0 + d) for c in range(3) for d in range(0, 500, 5)], "code string, date date, close double")
    for gap in (30, 0):
        events = learning.mature_events(spark.read.parquet(str(tmp_path / "history")), bars, learning.LearningConfig(holdout_sessions=0, gap_days=gap))
        assert str(tmp_path / "history") not in "".join(events.inputFiles()) and events.count() == 12


def test_candidates_stay_within_bounds():
    by = {r.key: r for r in learning.RULES}
    assert learning.candidates(by["minimum_drawdown_52w"], -0.18) == [-0.24, -0.21, -0.18, -0.15, -0.12]
    assert learning.candidates(by["minimum_equity_ratio"], 0.68) == [0.58, 0.63, 0.68, 0.7]
    assert learning.candidates(by["quantitative_min_score"], 42) == [48.0]
    assert learning.candidates(by["minimum_operating_cf_positive_ratio_3y"], 0.6667) == [0.3334, 0.5, 0.6667, 0.8334, 1.0]
    assert not {"minimum_externality", "minimum_temporary_probability", "minimum_catalyst_probability"} & set(by)


def random_events(rng, n):
    labels = [r.label for r in learning.RULES] + ["market"]
    rows = []
    for i in range(n):
        own = {
            "equity_ratio": rng.choice([0.1, 0.2, 0.25, 0.3, 0.35, 0.4, None]),
            "operating_cf_positive_ratio_3y": rng.choice([0.0, 1 / 3, 2 / 3, 1.0, None]),
            "sales_cagr_3y": rng.choice([-0.2, -0.07, -0.05, 0.0, 0.01, None, float("nan")]),
            "operating_margin": rng.uniform(-0.1, 0.2),
            "forecast_op_growth": rng.choice([None, -0.4, -0.2, 0.1]),
            "drawdown_52w": rng.uniform(-0.4, 0.0),
            "relative_return_6m": rng.choice([None, -0.2, -0.08, 0.05]),
            "quantitative_score": rng.uniform(35, 70),
        }
        failed = rng.sample(labels, rng.choice([0, 1, 1, 2]))
        returns = [rng.gauss(0.02 - (own["drawdown_52w"] or 0) * rng.random(), 0.2) if rng.random() < 0.9 else None for _ in range(3)]
        rows.append((START + dt.timedelta(days=rng.randrange(60)), rng.random() < 0.4, failed, *returns, *own.values()))
    return rows


def by_hand(rows, current, settings):
    """Every rule and candidate by itself, over lists of returns."""
    names = [r.column for r in learning.RULES]
    out = {}
    for rule in learning.RULES:
        at = 6 + names.index(rule.column)
        fit = [r for r in rows if (r[1] or (r[2] and set(r[2]) <= {rule.label})) and r[4] is not None]
        days = sorted({r[0] for r in fit})
        if len(days) < 2:
            continue
        split = days[min(max(int(len(days) * settings.train_share), 1), len(days) - 1)]

        def passing(threshold, train, h):
            def ok(x):
                if x is None or math.isnan(x):
                    return rule.null_passes
                return x >= threshold if rule.direction == ">=" else x <= threshold

            return [r[3 + h] for r in fit if (r[0] < split) == train and ok(r[at]) and r[3 + h] is not None]

        now = current[rule.key]
        for t in learning.candidates(rule, now):
            bt, ct, bv, cv = (passing(x, train, 1) for train in (True, False) for x in (now, t))
            if min(len(bt), len(ct)) < settings.least_train or min(len(bv), len(cv)) < settings.least_check:
                continue
            share = lambda v: sum(x > 0 for x in v) / len(v)
            gains = statistics.mean(ct) - statistics.mean(bt), statistics.mean(cv) - statistics.mean(bv), share(cv) - share(bv)
            worse = any(
                min(len(b), len(c)) >= max(5, settings.least_check // 2) and statistics.mean(c) < statistics.mean(b) - settings.decline
                for b, c in ((passing(now, False, h), passing(t, False, h)) for h in (0, 2))
            )
            accepted = t != now and len(cv) / len(bv) >= settings.retention and gains[0] >= settings.gain / 2
            accepted = accepted and gains[1] >= settings.gain and gains[2] >= settings.positive_gain and not worse
            score = gains[1] + 0.25 * gains[2] + 0.15 * gains[0]
            out[rule.key, t] = (len(ct), len(cv), pytest.approx(gains[0], abs=1e-9), pytest.approx(gains[1], abs=1e-9), accepted, pytest.approx(score, abs=1e-9))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_figures_against_lists(spark, seed):
    rng = random.Random(seed)
    rows = random_events(rng, 900)
    schema = "analysis_date date, selected boolean, fail_reasons array<string>, return_30d double, return_90d double, return_180d double, "
    events = spark.createDataFrame(rows, schema + ", ".join(f"{r.column} double" for r in learning.RULES)).repartition(5)
    settings = learning.LearningConfig(gain=0.001, positive_gain=-0.02, decline=0.02)
    current = learning.current_thresholds(ScreenConfig(min_score=50.0))
    got = learning.evaluate_rules(events, current, settings).collect()
    expected = by_hand(rows, current, settings)
    assert {(r.rule, r.candidate): (r.n_train, r.n_check, r.train_gain, r.check_gain, r.accepted, r.score) for r in got} == expected
    assert len(got) == len(expected) > 20
    best = learning.best_proposal(learning.evaluate_rules(events, current, settings)).first()
    taken = [r for r in got if r.accepted]
    assert (best is None) == (not taken) and (best is None or best.score == max(r.score for r in taken))
