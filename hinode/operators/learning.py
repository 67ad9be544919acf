"""Screening thresholds learned out of sample from the screen's own history.

Every rule's candidate thresholds are cuts of one axis, so an event's value falls into one of a few buckets, and the
counts, sums and positives of every candidate are cumulative sums over buckets. One aggregation over the events, partial
in each task, gives the figures of all rules, candidates, parts and horizons; nothing is sorted and no event is judged
once a candidate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import finite
from hinode.operators.asof import calendar_outcomes, keep_last, spaced_events
from hinode.operators.criteria import ScreenConfig
from hinode.operators.review import eligible_for_rule
from hinode.sources.store import stored


@dataclass(frozen=True)
class Rule:
    """A learnable threshold: its key in stored overlays, the measure, the direction that passes, the name under which the
    screen reports its failure, the field of ScreenConfig, step and bounds of candidates, and whether null passes."""

    key: str
    column: str
    direction: str
    label: str
    field: str
    step: float
    low: float
    high: float
    null_passes: bool = False
    decimals: int = 4


#: Fixed: the rules that may be learned, with steps, bounds and decimals; thresholds of reviews by hand may not.
RULES = (
    Rule("minimum_equity_ratio", "equity_ratio", ">=", "equity_ratio", "min_equity_ratio", 0.05, 0.15, 0.70),
    Rule("minimum_operating_cf_positive_ratio_3y", "operating_cf_positive_ratio_3y", ">=", "cf_history", "min_cf_ratio", 1 / 6, 0.0, 1.0),
    Rule("minimum_sales_cagr_3y", "sales_cagr_3y", ">=", "sales_trend", "min_sales_cagr", 0.02, -0.15, 0.20, True),
    Rule("minimum_operating_margin", "operating_margin", ">=", "margin", "min_margin", 0.02, -0.05, 0.30),
    Rule("maximum_forecast_op_decline", "forecast_op_growth", ">=", "forecast", "max_forecast_decline", 0.05, -0.50, 0.30, True),
    Rule("minimum_drawdown_52w", "drawdown_52w", "<=", "drawdown", "min_drawdown", 0.03, -0.50, -0.08),
    Rule("minimum_relative_underperformance_6m", "relative_return_6m", "<=", "relative", "min_relative", 0.03, -0.35, 0.0, True),
    Rule("quantitative_min_score", "quantitative_score", ">=", "score", "min_score", 3.0, 48.0, 85.0, False, 1),
)
#: Fixed: calendar days after which outcomes are taken, and those that must confirm what the primary one shows.
HORIZONS, CONFIRMED_BY = (30, 90, 180), (30, 180)
#: Fixed: events of these strategies take part.
STRATEGIES = ("", "value_dislocation")


@dataclass(frozen=True)
class LearningConfig:
    """Settings of the learning; the defaults are the reference's."""

    enabled: bool = False
    auto_apply: bool = False
    primary: int = 90
    least_events: int = 100
    holdout_sessions: int = 60
    least_train: int = 20
    least_check: int = 10
    train_share: float = 0.70
    gap_days: int = 30
    gain: float = 0.02
    positive_gain: float = 0.0
    retention: float = 0.35
    decline: float = 0.01
    cooldown_days: int = 30


def candidates(rule: Rule, current: float) -> list[float]:
    """Up to five thresholds: the current one and two steps to each side, within the bounds, in this order, without repeats."""
    tried = [round(min(rule.high, max(rule.low, current + k * rule.step)), rule.decimals) for k in (-2, -1, 0, 1, 2)]
    return list(dict.fromkeys(tried))


def current_thresholds(config: ScreenConfig) -> dict[str, float]:
    """The thresholds of a screen by the rules' keys."""
    return {r.key: float(getattr(config, r.field)) for r in RULES}


def with_overlay(config: ScreenConfig, overlay: dict[str, float]) -> ScreenConfig:
    """The screen with learned thresholds; keys that aren't learnable are left out."""
    known = {r.key: r.field for r in RULES}
    return replace(config, **{known[k]: float(v) for k, v in overlay.items() if k in known})


def holdout_start(prices: DataFrame, sessions: int) -> Column:
    """The first of the last `sessions` market days (of all, if there are fewer), as a scalar."""
    days = prices.where("date IS NOT NULL").select(F.to_date("date").alias("day")).distinct()
    return days.orderBy(F.desc("day")).limit(sessions).agg(F.min("day").alias("day")).scalar()


def mature_events(analysis: DataFrame, prices: DataFrame, config: LearningConfig = LearningConfig()) -> DataFrame:
    """Analysis rows at least `gap_days` apart with their outcomes and `held_out`.

    analysis: code, analysis_date, close, selected, fail_reasons, the rules' measures. Of the rows of one code and day the
    least counts. Only rows whose primary outcome is known are returned; `held_out` marks those whose outcome falls into
    the last sessions, which no rule may see.
    """
    rows = analysis.where("code IS NOT NULL AND analysis_date IS NOT NULL")
    if "selection_strategy" in rows.columns:
        rows = rows.where(F.coalesce("selection_strategy", F.lit("")).isin(*STRATEGIES))
    if config.gap_days > 0:
        rows = stored(keep_last(rows, ["code", "analysis_date"], [F.struct(*rows.columns)]), "analysis")
        rows = rows.join(spaced_events(rows, config.gap_days), ["code", "analysis_date"], "left_semi")
    # an anchor's row is read for its targets and for their outcomes
    rows = calendar_outcomes(stored(rows, "spaced"), prices, HORIZONS, "analysis_date", "close")
    rows = rows.where(F.col(f"return_{config.primary}d").isNotNull())
    if config.holdout_sessions <= 0:
        return rows.withColumn("held_out", F.lit(False))
    before = F.col(f"outcome_date_{config.primary}d") < holdout_start(prices, config.holdout_sessions)
    return rows.withColumn("held_out", ~F.coalesce(before, F.lit(False)))


def _cuts(rule: Rule, current: float) -> list[float]:
    """The current threshold and the candidates from the loosest to the strictest."""
    return sorted({current, *candidates(rule, current)}, reverse=rule.direction == "<=")


def _bucket(rule: Rule, current: float) -> Column:
    """How many of the cuts a row passes; they are nested, so it passes the first so many."""
    x = finite(F.col(rule.column))
    cuts = _cuts(rule, current)
    passed = sum((F.when(x >= t if rule.direction == ">=" else x <= t, 1).otherwise(0) for t in cuts), F.lit(0))
    return F.when(x.isNull(), len(cuts) if rule.null_passes else 0).otherwise(passed)


def rule_figures(events: DataFrame, current: dict[str, float], config: LearningConfig = LearningConfig()) -> DataFrame:
    """rule_no, cut_no, part (train, check), and n_{h}, sum_{h}, up_{h} of the events that pass each cut.

    An event takes part in a rule if it was selected or failed for that rule alone. The days of these events, each once,
    split them: the first `train_share` of days train, the rest check; a rule with events of a single day has no rows.
    """
    used = [(i, r) for i, r in enumerate(RULES) if r.key in current and r.column in events.columns]
    asked = F.array(
        *[
            F.struct(F.lit(i).alias("rule_no"), eligible_for_rule(events, r.label).alias("ok"), _bucket(r, current[r.key]).alias("bucket"))
            for i, r in used
        ]
    )
    returns = [f"return_{h}d" for h in HORIZONS]
    rows = events.where(F.col(f"return_{config.primary}d").isNotNull())
    long = rows.select("analysis_date", *returns, F.explode(asked).alias("a")).where("a.ok")
    long = long.select("a.rule_no", "a.bucket", "analysis_date", *returns)
    days = long.select("rule_no", "analysis_date").distinct()  # as many as there are days, for each rule
    per_rule = Window.partitionBy("rule_no")
    nth = F.row_number().over(per_rule.orderBy("analysis_date")) - 1
    days = days.withColumns({"nth": nth, "days": F.count("*").over(per_rule)}).where("days >= 2")
    split = F.least(F.greatest(F.floor(F.col("days") * config.train_share), F.lit(1)), F.col("days") - 1)
    splits = days.where(F.col("nth") == split).select("rule_no", F.col("analysis_date").alias("split_day"))
    stats = [
        f(F.col(f"return_{h}d")).alias(f"{name}_{h}")
        for h in HORIZONS
        for name, f in (("n", F.count), ("sum", F.sum), ("up", lambda c: F.count_if(c > 0)))
    ]
    part = F.when(F.col("analysis_date") < F.col("split_day"), "train").otherwise("check")
    cells = long.join(F.broadcast(splits), "rule_no")  # a row for each rule
    cells = cells.groupBy("rule_no", part.alias("part"), "bucket").agg(*stats)
    passed = F.explode(F.sequence(F.lit(1), "bucket"))
    cumulative = cells.where("bucket > 0").select("*", passed.alias("cut_no"))  # at most six cuts
    names = [f"{name}_{h}" for h in HORIZONS for name in ("n", "sum", "up")]
    return cumulative.groupBy("rule_no", "cut_no", "part").agg(*[F.sum(n).alias(n) for n in names])


def evaluate_rules(events: DataFrame, current: dict[str, float], config: LearningConfig = LearningConfig()) -> DataFrame:
    """A row for each rule and candidate with enough events in both parts: figures of candidate and current threshold, gains,
    whether it is accepted, and its score.

    Accepted is another threshold that keeps enough events, gains at least half of `gain` in training and all of it in the
    check, loses no positives there, and isn't contradicted by the other horizons where these have enough events.
    """
    spark = events.sparkSession
    tried = [
        (i, r.key, r.column, order, float(current[r.key]), t, _cuts(r, current[r.key]).index(t) + 1, _cuts(r, current[r.key]).index(current[r.key]) + 1)
        for i, r in enumerate(RULES)
        if r.key in current and r.column in events.columns
        for order, t in enumerate(candidates(r, current[r.key]))
    ]
    schema = "rule_no int, rule string, metric string, place int, current double, candidate double, cut_no int, now_no int"
    tried_df = spark.createDataFrame(tried, schema)
    figures = rule_figures(events, current, config)
    names = [f"{name}_{h}" for h in HORIZONS for name in ("n", "sum", "up")]
    wide = figures.groupBy("rule_no", "cut_no").pivot("part", ["train", "check"]).agg(*[F.first(n).alias(n) for n in names])
    columns = [f"{p}_{n}" for p in ("train", "check") for n in names]
    now = wide.select("rule_no", F.col("cut_no").alias("now_no"), *[F.col(c).alias(f"now_{c}") for c in columns])
    # a few dozen rows from here on
    both = tried_df.join(wide, ["rule_no", "cut_no"]).join(now, ["rule_no", "now_no"])
    c = F.col
    mean = lambda side, h: F.when(c(f"{side}_n_{h}") > 0, c(f"{side}_sum_{h}") / c(f"{side}_n_{h}"))
    up = lambda side, h: F.when(c(f"{side}_n_{h}") > 0, c(f"{side}_up_{h}") / c(f"{side}_n_{h}"))
    p = config.primary
    enough = (F.least(f"train_n_{p}", f"now_train_n_{p}") >= config.least_train) & (F.least(f"check_n_{p}", f"now_check_n_{p}") >= config.least_check)
    worse = F.lit(False)
    for h in CONFIRMED_BY:
        counted = F.least(f"check_n_{h}", f"now_check_n_{h}") >= max(5, config.least_check // 2)
        worse = worse | F.coalesce(counted & (mean("check", h) < mean("now_check", h) - config.decline), F.lit(False))
    rows = both.where(enough).select(
        "rule_no", "place", "rule", "metric", "current", "candidate",
        c(f"train_n_{p}").alias("n_train"), c(f"check_n_{p}").alias("n_check"),
        mean("train", p).alias("train_mean"), mean("check", p).alias("check_mean"),
        mean("now_train", p).alias("now_train_mean"), mean("now_check", p).alias("now_check_mean"),
        up("check", p).alias("check_up"), up("now_check", p).alias("now_check_up"),
        *[m(side, h).alias(f"{side}_{name}_{h}") for h in CONFIRMED_BY for side in ("check", "now_check") for name, m in (("mean", mean), ("up", up))],
        (c(f"check_n_{p}") / c(f"now_check_n_{p}")).alias("retention"), (~worse).alias("confirmed"),
    )
    gains = {
        "train_gain": c("train_mean") - c("now_train_mean"),
        "check_gain": c("check_mean") - c("now_check_mean"),
        "positive_gain": c("check_up") - c("now_check_up"),
    }
    rows = rows.withColumns(gains)
    accepted = (
        (c("candidate") != c("current")) & (c("retention") >= config.retention) & (c("train_gain") >= config.gain / 2)
        & (c("check_gain") >= config.gain) & (c("positive_gain") >= config.positive_gain) & c("confirmed")
    )
    score = c("check_gain") + 0.25 * c("positive_gain") + 0.15 * c("train_gain")
    return rows.withColumns({"accepted": accepted, "score": score})


def best_proposal(evaluations: DataFrame) -> DataFrame:
    """The accepted candidate of the highest score, the first of equals; no row if there is none."""
    return evaluations.where("accepted").orderBy(F.desc("score"), "rule_no", "place").limit(1)


@dataclass(frozen=True)
class LearningState:
    """What a run found: its status, the counts behind it, the best proposal, and the overlay that holds from now on."""

    status: str
    mature: int = 0
    before_holdout: int = 0
    best: dict | None = None
    overlay: dict[str, float] | None = None
    applied_on: date | None = None


def learn(
    analysis: DataFrame,
    prices: DataFrame,
    screen: ScreenConfig,
    config: LearningConfig = LearningConfig(),
    previous: LearningState = LearningState("none"),
    today: date | None = None,
) -> LearningState:
    """One run: disabled, cooldown, insufficient_history, no_robust_improvement, proposal_ready or auto_applied.

    The thresholds in force are the screen's with the previous overlay. A proposal is applied to the overlay only with
    auto_apply, one rule a run, and then the next run waits for the cooldown.
    """
    overlay = dict(previous.overlay or {})
    keep = {"overlay": overlay, "applied_on": previous.applied_on}
    if not config.enabled:
        return LearningState("disabled", **keep)
    today = today or date.today()
    if previous.applied_on and (today - previous.applied_on).days < config.cooldown_days:
        return LearningState("cooldown", best=previous.best, **keep)
    events = mature_events(analysis, prices, config)
    n, held = events.agg(F.count("*"), F.count_if("held_out")).first()
    counts = {"mature": n - held, "before_holdout": n}
    if n - held < config.least_events:
        return LearningState("insufficient_history", **counts, **keep)
    rows = evaluate_rules(events.where("NOT held_out"), current_thresholds(with_overlay(screen, overlay)), config)
    best = best_proposal(rows).first()
    if best is None:
        return LearningState("no_robust_improvement", **counts, **keep)
    if not config.auto_apply:
        return LearningState("proposal_ready", best=best.asDict(), **counts, **keep)
    keep = {"overlay": overlay | {best["rule"]: best["candidate"]}, "applied_on": today}
    return LearningState("auto_applied", best=best.asDict(), **counts, **keep)
