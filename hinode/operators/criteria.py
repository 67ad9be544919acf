"""Hard filters with an audit column per rule, the funnel, shortlists, and variants as a dimension of the plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import joined_reasons, passes
from hinode.operators.ranking import percent_ranks, unpivot
from hinode.operators.scoring import add_attribution, add_scores
from hinode.sources.store import stored

#: Fixed: the value of selection_strategy in stored rows that stands for the value screen.
VALUE = "value_dislocation"


@dataclass(frozen=True)
class ScreenConfig:
    """Thresholds of a screen; presets and learned overlays are `replace`d copies."""

    markets: tuple[str, ...] = ("Prime", "Standard", "Growth")
    strategy: str = VALUE
    min_turnover: float = 50_000_000.0
    min_price: float = 200.0
    min_equity_ratio: float = 0.30
    min_cf_ratio: float = 0.6667
    min_sales_cagr: float = -0.05
    require_sales_history: bool = False
    min_margin: float = 0.0
    min_drawdown: float = -0.18
    benchmark_mode: str = "auto"
    use_relative: bool = True
    min_relative: float = -0.08
    relative_when_missing: str = "skip"
    min_attribution: float = 0.0
    attribution_when_missing: str = "skip"
    attribution_method: str = "v2_sector_absolute"
    score_mode: str = "legacy_depth"
    max_forecast_decline: float = -0.20
    require_forecast: bool = False
    use_guard: bool = True
    min_cash_conversion: float = 0.70
    min_margin_change: float = -0.03
    min_revision: float = -0.10
    min_sector_relative: float = -0.15
    require_dividend: bool = False
    min_dividend: float = 0.0
    min_yield: float = 0.0
    max_yield: float = 0.10
    max_payout: float = 0.80
    exclude_dividend_cut: bool = False
    min_volatility: float = 0.35
    min_range: float = 0.025
    min_activity: float = 50.0
    min_score: float = 70.0
    queue: int = 50


#: Presets: overrides of the defaults.
PRESETS = {
    "balanced": {},
    "strict": {"min_equity_ratio": 0.40, "min_margin": 0.05, "min_drawdown": -0.25, "min_score": 75.0},
    "active": {"strategy": "active_trading"},
}


def with_overrides(config: ScreenConfig, **overrides) -> ScreenConfig:
    return replace(config, **overrides)


FIRST_CHECKS = ("market", "liquidity", "price")
FINANCE_CHECKS = ("equity_ratio", "operating_profit", "cf_history", "sales_trend", "margin")
PRICE_CHECKS = ("drawdown", "relative")
CHECKS = (*FIRST_CHECKS, *FINANCE_CHECKS, *PRICE_CHECKS, "attribution", "forecast")
ACTIVE_CHECKS = (*FIRST_CHECKS, "volatility", "range", "activity")


#: Fixed: the measures of activity and their parts.
ACTIVITY = {"volatility_60d": 0.45, "average_intraday_range_20d": 0.35, "average_turnover_20d": 0.20}


def activity_score(rows: DataFrame) -> DataFrame:
    """45/35/20 blend of percentile ranks of volatility, range and turnover; ties share their mean rank, null ranks 0."""
    rows = stored(rows.withColumn("activity_row", F.monotonically_increasing_id()), "activity")  # numbers are kept as written
    long = unpivot(rows, ["as_of", "activity_row"], tuple(ACTIVITY))
    ranks = percent_ranks(long, ["as_of", "measure"], "value")
    ranked = long.join(ranks, ["as_of", "measure", "value"])
    each = [F.max(F.when(F.col("measure") == m, F.col("percent_rank"))).alias(f"rank_{m}") for m in ACTIVITY]
    joined = rows.join(ranked.groupBy("activity_row").agg(*each), "activity_row", "left").drop("activity_row")
    total = sum((part * F.coalesce(f"rank_{m}", F.lit(0.0)) for m, part in ACTIVITY.items()), F.lit(0.0))
    return joined.withColumn("activity_score", 100.0 * total).drop(*[f"rank_{m}" for m in ACTIVITY])


def resolve_benchmark(rows: DataFrame, mode: str) -> DataFrame:
    """Which relative return counts: the index's, a proxy fund's, whichever is there (auto), or none."""
    for name in ("proxy_return_6m",):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    official, proxy = F.col("return_6m") - F.col("index_return_6m"), F.col("return_6m") - F.col("proxy_return_6m")
    choice = {"official": (official, "index"), "proxy": (proxy, "proxy")}
    if mode in choice:
        value, label = choice[mode]
        source = F.when(value.isNotNull(), label).otherwise("none")
    elif mode == "disabled":
        value, source = F.lit(None).cast("double"), F.lit("disabled")
    else:
        value, source = F.coalesce(official, proxy), F.when(official.isNotNull(), "index").when(proxy.isNotNull(), "proxy").otherwise("none")
    return rows.withColumn("relative_return_6m", value).withColumn("benchmark_source", source).withColumn("benchmark_return_6m", F.when(source == "index", F.col("index_return_6m")).when(source == "proxy", F.col("proxy_return_6m")))


def apply_criteria(rows: DataFrame, config: ScreenConfig, min_attribution: Column | None = None, method: Column | None = None, use_relative: Column | None = None, score_mode: Column | None = None) -> DataFrame:
    """pass_* of every rule, scores, hard_pass, selected, and the failed rules as an array.

    The last four parameters take columns, so that many variants can be one plan over the same features.
    """
    c = F.col
    minimum = F.lit(config.min_attribution) if min_attribution is None else min_attribution
    relative_on = F.lit(config.use_relative and config.benchmark_mode != "disabled") if use_relative is None else use_relative
    rows = resolve_benchmark(rows, config.benchmark_mode)
    rows = add_attribution(add_attribution(rows, config.attribution_method if method is None else method), name="external_shock_attribution_v2")
    rows = add_scores(rows, config.score_mode if score_mode is None else score_mode)
    share = c("external_shock_attribution")
    value = config.strategy == VALUE
    # ranks over all securities of a date are for the strategy that reads them
    rows = rows.withColumn("activity_score", F.lit(None).cast("double")) if value else activity_score(rows)
    unknown = F.lit(config.attribution_when_missing == "skip")
    relative_ok = F.when(~relative_on, True).when(c("relative_return_6m").isNull(), F.lit(config.relative_when_missing == "skip")).otherwise(c("relative_return_6m") <= config.min_relative)
    missing_ok = lambda name, test: c(name).isNull() | test
    dividend = c("forecast_annual_dividend_per_share")
    rows = rows.withColumn("dividend_yield", F.when(c("close") > 0, dividend / c("close")))
    guard = {
        "cash_conversion": missing_ok("cash_conversion_ratio", c("cash_conversion_ratio") >= config.min_cash_conversion),
        "margin_stability": missing_ok("operating_margin_change_3y", c("operating_margin_change_3y") >= config.min_margin_change),
        "revision": missing_ok("forecast_revision_rate", c("forecast_revision_rate") >= config.min_revision),
        "sector_relative": missing_ok("sector_relative_return_6m", c("sector_relative_return_6m") >= config.min_sector_relative),
    }
    if not config.use_guard:
        guard = {k: F.lit(True) for k in guard}
    dividends = [
        dividend.isNotNull(), dividend >= config.min_dividend, c("dividend_yield") >= config.min_yield, c("dividend_yield") <= config.max_yield,
        missing_ok("payout_ratio", c("payout_ratio") <= config.max_payout),
        missing_ok("forecast_dividend_change_rate", c("forecast_dividend_change_rate") >= 0) if config.exclude_dividend_cut else F.lit(True),
    ]
    every = lambda some: F.forall(F.array(*some), lambda x: x)
    tests = {
        "market": c("market").isin(*config.markets),
        "liquidity": c("average_turnover_20d") >= config.min_turnover,
        "price": c("close") >= config.min_price,
        "equity_ratio": c("equity_ratio") >= config.min_equity_ratio,
        "operating_profit": c("operating_profit_latest") > 0,
        "cf_history": F.lit(True) if config.min_cf_ratio <= 0 else c("operating_cf_positive_ratio_3y") >= config.min_cf_ratio,
        "sales_trend": c("sales_cagr_3y") >= config.min_sales_cagr if config.require_sales_history else missing_ok("sales_cagr_3y", c("sales_cagr_3y") >= config.min_sales_cagr),
        "margin": c("operating_margin") >= config.min_margin,
        "drawdown": c("drawdown_52w") <= config.min_drawdown,
        "relative": relative_ok,
        "attribution": (F.when(minimum <= 0, True).when(share.isNull(), unknown).otherwise(share >= minimum)) if value else F.lit(True),
        "forecast": c("forecast_op_growth") >= config.max_forecast_decline if config.require_forecast else missing_ok("forecast_op_growth", c("forecast_op_growth") >= config.max_forecast_decline),
        **guard,
        "guard": every([passes(x) for x in guard.values()]),
        "dividend": every([passes(x) for x in dividends]) if config.require_dividend else F.lit(True),
        "volatility": c("volatility_60d") >= config.min_volatility,
        "range": c("average_intraday_range_20d") >= config.min_range,
        "activity": c("activity_score") >= config.min_activity,
        "score": c("quantitative_score") >= config.min_score,
    }
    rows = rows.withColumns({f"pass_{k}": passes(v) for k, v in tests.items()})
    ok = lambda names: every([c(f"pass_{k}") for k in names])
    hard = (*CHECKS, "guard", "dividend")
    return rows.withColumns({
        "hard_pass": ok(hard),
        "selected": ok(ACTIVE_CHECKS) if not value else ok((*hard, "score")),
        "strategy_score": c("activity_score") if not value else c("quantitative_score"),
        "fail_reasons": joined_reasons([(k, ~c(f"pass_{k}")) for k in (*hard, "score")]),
        "pass_reasons": joined_reasons([(k, c(f"pass_{k}")) for k in (*hard, "score")]),
        "guard_failures": joined_reasons([(k, ~c(f"pass_{k}")) for k in guard]),
        "attribution_skipped": passes((minimum > 0) & share.isNull()) & F.lit(value and config.attribution_when_missing == "skip"),
        "attribution_below": passes((minimum > 0) & (share < minimum)) & F.lit(value),
        "attribution_missing_failed": passes((minimum > 0) & share.isNull()) & F.lit(value and config.attribution_when_missing == "fail"),
    })


STAGES = (
    ("all", ()), ("market, liquidity, price", FIRST_CHECKS), ("finances", (*FIRST_CHECKS, *FINANCE_CHECKS)), ("price fall", (*FIRST_CHECKS, *FINANCE_CHECKS, *PRICE_CHECKS)),
    ("attribution", CHECKS[:-1]), ("forecast", CHECKS), ("guard", (*CHECKS, "guard")), ("dividend", (*CHECKS, "guard", "dividend")), ("score", (*CHECKS, "guard", "dividend", "score")),
)
ACTIVE_STAGES = (("all", ()), ("market, liquidity, price", FIRST_CHECKS), ("volatility", ACTIVE_CHECKS[:4]), ("range", ACTIVE_CHECKS[:5]), ("activity", ACTIVE_CHECKS))


def funnel(table: DataFrame, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """How many are left after each stage, and how attribution treated those without a value: one aggregation."""
    stages = STAGES if config.strategy == VALUE else ACTIVE_STAGES
    counts = [F.count_if(F.forall(F.array(F.lit(True), *[F.col(f"pass_{k}") for k in names]), lambda x: x)).alias(f"s{i}") for i, (_, names) in enumerate(stages)]
    extra = () if stages is ACTIVE_STAGES else (("attribution below minimum", "attribution_below"), ("attribution unknown, failed", "attribution_missing_failed"), ("attribution unknown, passed", "attribution_skipped"))
    counts += [F.count_if(F.col(c)).alias(f"d{i}") for i, (_, c) in enumerate(extra)]
    one = table.agg(*counts)
    rows = [F.struct(F.lit(i).alias("place"), F.lit(label).alias("stage"), F.col(f"s{i}").alias("n")) for i, (label, _) in enumerate(stages)]
    rows += [F.struct(F.lit(len(stages) + i).alias("place"), F.lit(label).alias("stage"), F.col(f"d{i}").alias("n")) for i, (label, _) in enumerate(extra)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def shortlist(table: DataFrame, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Of each date the selected with the highest strategy score, then turnover, then code, with their place."""
    w = Window.partitionBy("as_of").orderBy(F.desc("strategy_score"), F.desc("average_turnover_20d"), "code")
    return table.where("selected").withColumn("place", F.row_number().over(w)).where(F.col("place") <= config.queue)


def near_misses(table: DataFrame, n: int = 30) -> DataFrame:
    """Of each date the best that were not selected, with their place."""
    w = Window.partitionBy("as_of").orderBy(F.desc("strategy_score"), "code")
    return table.where("NOT selected").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def screen_variants(prepared: DataFrame, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Selected of each of the 16 attribution variants, with the variant as a column over the same features."""
    spark = prepared.sparkSession
    grid = spark.createDataFrame([(m, x, r) for m in ("v2_sector_absolute", "v1_legacy") for x in (0.0, 0.3, 0.5, 0.7) for r in (True, False)], "method string, minimum double, relative boolean")
    base = prepared.withColumn("real_as_of", F.col("as_of")).join(F.broadcast(grid))  # 16 rows
    base = base.withColumn("as_of", F.struct("real_as_of", "method", "minimum", "relative"))
    table = apply_criteria(base, with_overrides(config, min_relative=-0.08), F.col("minimum"), F.col("method"), F.col("relative"))
    return table.groupBy("real_as_of", "method", "minimum", "relative").agg(F.count_if("selected").alias("selected"), F.avg(F.when(F.col("hard_pass"), F.col("quantitative_score"))).alias("mean_score")).withColumnRenamed("real_as_of", "as_of")


def score_mode_variants(prepared: DataFrame, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Selected and their mean score in both dislocation modes."""
    modes = prepared.sparkSession.createDataFrame([("legacy_depth",), ("external_explained",)], "mode string")
    base = prepared.withColumn("real_as_of", F.col("as_of")).join(F.broadcast(modes)).withColumn("as_of", F.struct("real_as_of", "mode"))  # two rows
    table = apply_criteria(base, config, score_mode=F.col("mode"))
    return table.groupBy("real_as_of", "mode").agg(F.count_if("selected").alias("selected"), F.avg("quantitative_score").alias("mean_score")).withColumnRenamed("real_as_of", "as_of")


def attribution_diagnostics(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Why attribution is unknown, among all and among those that pass every other check."""
    others = F.forall(F.array(*[F.col(f"pass_{k}") for k in CHECKS if k != "attribution"]), lambda x: x)
    cohorts = F.array_compact(F.array(F.lit("all"), F.when(others, F.lit("before the gate"))))
    by = by or []
    return table.where("external_shock_attribution IS NULL").select(*by, F.explode(cohorts).alias("cohort"), F.col("external_shock_attribution_reason").alias("reason")).groupBy(*by, "cohort", "reason").agg(F.count("*").alias("n"))


def fail_reason_counts(table: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent failed rules."""
    return table.select(F.explode("fail_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)
