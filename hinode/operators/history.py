"""Dated history: star events, outcomes, condition performance, evaluation counts, upserts and fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import coerce_flag, passes
from hinode.operators.asof import as_of_backward, as_of_merge, forward_outcomes, keep_last, sessions
from hinode.sources.store import stored

#: Fixed rules: name, column, direction, threshold.
CONDITIONS = (
    ("sales growth 3%", "sales_cagr_3y", ">=", 0.03), ("margin 10%", "operating_margin", ">=", 0.10), ("equity 40%", "equity_ratio", ">=", 0.40), ("drawdown 20%", "drawdown_52w", "<=", -0.20),
    ("10% behind the market", "relative_return_6m", "<=", -0.10), ("guidance up", "forecast_op_growth", ">=", 0.0), ("cash conversion 80%", "cash_conversion_ratio", ">=", 0.80),
    ("margin loss under 3pt", "operating_margin_change_3y", ">=", -0.03), ("revision under 10%", "forecast_revision_rate", ">=", -0.10), ("15% of sector", "sector_relative_return_6m", ">=", -0.15),
    ("half explained", "external_shock_attribution", ">=", 0.50), ("yield 3%", "dividend_yield", ">=", 0.03), ("volatility 35%", "volatility_60d", ">=", 0.35), ("range 2.5%", "average_intraday_range_20d", ">=", 0.025),
)


#: Fixed texts of notes that say why a price could not be had.
BULK_NOTES = ("100件以上", "bulk limit")
FAILED_NOTES = ("外部株価履歴を取得できませんでした", "no price history")


def infer_status(rows: DataFrame) -> DataFrame:
    """status and reason of evaluations that lack them, from trend text, note, price and symbol, in this order."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    status, reason, trend, symbol = text("evaluation_status"), text("unassessed_reason"), text("latest_trend"), text("intuitive_symbol")
    assessed = status.isin("same_day", "backfilled")
    kept = (status == "unassessed") & (reason != "")
    note = text("decision_note") if "decision_note" in rows.columns else F.lit("")
    said = lambda texts: F.exists(F.array(*[note.contains(t) for t in texts]), lambda x: x)
    limit, failed = trend.startswith("not run") | said(BULK_NOTES), trend.startswith("unavailable") | said(FAILED_NOTES)
    price = F.col("latest_price")
    only_symbol = (symbol != "") & (trend == "") & price.isNull()
    done = only_symbol | (price.isNotNull() & (symbol != ""))
    new_status = F.when(assessed | kept, status).when(limit | failed, "unassessed").when(done, "same_day").otherwise("unassessed")
    new_reason = F.when(assessed, "").when(kept, reason).when(limit, "bulk limit").when(failed, "quote failed").when(done, "").when(price.isNull(), "quote failed").otherwise("other")
    return rows.withColumn("status", new_status).withColumn("reason", new_reason)


def star_events(evaluations: DataFrame, mode: str = "displayed") -> DataFrame:
    """Evaluations at which a security becomes a star: the flag turns from false to true.

    Rows without a price, or whose trend says that none could be had, neither count nor reset the state.
    """
    shown = F.col("intuitive_symbol") == "◎☆"
    flag = {"displayed": shown, "legacy": F.coalesce(coerce_flag(F.col("legacy_star")), shown), "reversal": F.coalesce(coerce_flag(F.col("reversal_star")), F.lit(False))}[mode]
    trend = F.coalesce("latest_trend", F.lit(""))
    valid = evaluations.where(F.col("evaluation_date").isNotNull() & F.col("latest_price").isNotNull() & ~trend.startswith("not run") & ~trend.startswith("unavailable"))
    w = Window.partitionBy("code").orderBy("evaluation_date")
    rows = valid.withColumn("is_star", passes(flag)).withColumn("was_star", F.lag("is_star", 1, False).over(w)).where("is_star AND NOT was_star")
    return rows.withColumn("star_date", F.coalesce("latest_market_date", "evaluation_date")).withColumn("entry_price", F.col("latest_price")).withColumn("star_mode", F.lit(mode)).drop("is_star", "was_star")


def outcome_summary(events: DataFrame, horizons: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """Mean, share above zero and count of matured returns per horizon (and `by`)."""
    by = by or []
    parts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d").alias("r")) for h in horizons])
    rows = events.select(*by, F.explode(parts).alias("x")).select(*by, "x.*")
    n = F.count("r")
    return rows.groupBy(*by, "horizon").agg(n.alias("n"), F.avg("r").alias("mean_return"), F.when(n > 0, F.count_if(F.col("r") > 0) / n).alias("positive_share"))


def enrich_outcomes(events: DataFrame, prices: DataFrame, horizons: tuple[int, ...], basis: str | None = None) -> DataFrame:
    """Star events with their outcomes over sessions of prices.

    An event without a valid entry price enters at the first close on or after its date, and its date becomes that day's;
    without one it stays as it is, with null outcomes. `basis` is set on events that have an entry.
    """
    valid = prices.where("date IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)").select("code", "date", "close")
    given = passes((F.col("entry_price") > 0) & ~F.isnan("entry_price"))
    rows = as_of_merge(events, valid, ["code"], "star_date", "date", forward=True)
    entry = F.when(given, F.col("entry_price")).otherwise(F.col("_found.close"))
    day = F.when(given, F.col("star_date")).otherwise(F.coalesce("_found.date", "star_date"))
    rows = rows.withColumns({"entry_price": entry, "star_date": day}).select(*events.columns)
    made = forward_outcomes(rows, sessions(prices), horizons, date="star_date")
    return made if basis is None else made.withColumn("basis", F.when(F.col("entry_price").isNotNull(), F.lit(basis)))


def reconcile_outcomes(rebuilt: DataFrame, saved: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Rebuilt events with the saved entry price, returns and elapsed days where they are not null and of the same basis. Of
    saved rows of one event the greatest counts."""
    names = ["entry_price", *[f"{k}_{h}d" for h in horizons for k in ("return", "actual_days")]]
    names = [n for n in names if n in rebuilt.columns and n in saved.columns]
    stored = keep_last(saved, ["code", "star_date"], [F.struct("basis", *names).desc()])
    stored = stored.select("code", "star_date", F.col("basis").alias("saved_basis"), *[F.col(n).alias(f"saved_{n}") for n in names])
    joined = rebuilt.join(stored, ["code", "star_date"], "left")
    same = passes(F.col("saved_basis") == F.col("basis"))
    kept = {n: F.coalesce(F.when(same, F.col(f"saved_{n}")), F.col(n)) for n in names}
    return joined.withColumns(kept).select(*rebuilt.columns) if kept else joined.select(*rebuilt.columns)


def condition_performance(events: DataFrame, analysis: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Outcomes of events whose newest snapshot by their date met each condition; conditions nobody met appear with 0."""
    wanted = ["code", "analysis_date", *[c for _, c, *_ in CONDITIONS]]
    rows = as_of_backward(events.select("code", "star_date", *[f"return_{h}d" for h in horizons]), analysis.select(*wanted), "code", "star_date", "analysis_date").where("analysis_date_r IS NOT NULL")
    met = [F.struct(F.lit(k).alias("condition"), F.lit(i).alias("place"), passes(F.col(f"{c}_r") >= t if op == ">=" else F.col(f"{c}_r") <= t).alias("met")) for i, (k, c, op, t) in enumerate(CONDITIONS)]
    long = rows.withColumn("m", F.explode(F.array(*met))).select("m.*", *[f"return_{h}d" for h in horizons])
    stats = [F.count_if("met").alias("matching"), F.count("*").alias("events")]
    for h in horizons:
        r = F.when(F.col("met"), F.col(f"return_{h}d"))
        stats += [F.count(r).alias(f"n_{h}d"), F.avg(r).alias(f"mean_{h}d"), F.when(F.count(r) > 0, F.count_if(r > 0) / F.count(r)).alias(f"positive_{h}d")]
    return long.groupBy("place", "condition").agg(*stats)


def daily_counts(evaluations: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """A row per day with the count of each status."""
    return evaluations.groupBy("evaluation_date").pivot("status", list(statuses)).count().na.fill(0)


def symbol_counts(evaluations: DataFrame, order: tuple[str, ...] = ("◎☆", "◎", "○", "△", "×")) -> DataFrame:
    """Counts of the symbols in their fixed order, with absent ones as 0."""
    spark = evaluations.sparkSession
    fixed = spark.createDataFrame([(i, s) for i, s in enumerate(order)], "place int, symbol string")
    counted = evaluations.groupBy(F.col("intuitive_symbol").alias("symbol")).agg(F.count("*").alias("n"))
    return fixed.join(counted, "symbol", "left").na.fill(0, ["n"])


def upsert(history: DataFrame, new: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Both tables by name, missing columns null, the last row of each key by its stamp; new rows win ties."""
    both = history.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, [F.desc_nulls_last(stamp), F.desc("is_new")]).drop("is_new")


def attach_evaluations(analysis: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Analysis rows with the last evaluation of their date and code; without one they are unassessed."""
    last = keep_last(evaluations, ["evaluation_date", "code"], [F.desc_nulls_last("evaluated_at")])
    found = last.select(F.col("evaluation_date").alias("analysis_date"), "code", "intuitive_symbol", "status")
    return analysis.join(found, ["analysis_date", "code"], "left").withColumn("final", F.coalesce(F.nullif(F.trim("intuitive_symbol"), F.lit("")), F.lit("unassessed")))


def day_fingerprints(rows: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of each day's rows."""
    h = F.xxhash64(*columns)
    return rows.groupBy(day).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 20)).alias("s"))


def portable_fingerprints(rows: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """day, n, s1, s2: a fingerprint of each day's rows that other engines can make as well, from two parts of the md5 of
    their texts. It knows no order, and those of two sets of rows of a day add up. Nulls are told apart from empty texts."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    part = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    return rows.groupBy(day).agg(F.count("*").alias("n"), F.sum(part(1)).alias("s1"), F.sum(part(9)).alias("s2"))


def collapse_repeats(rows: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """Days whose rows equal those of the day before are dropped: only the head of each run stays."""
    prints = day_fingerprints(rows, day, columns)
    w = Window.orderBy(day)  # one row per day
    before = F.lag(F.struct("n", "x", "s")).over(w)
    heads = prints.withColumn("same", F.struct("n", "x", "s").eqNullSafe(before)).where("NOT same").select(day)
    return rows.join(heads, day, "left_semi")


def invalidation_status(reviews: DataFrame, features: DataFrame, metrics: tuple[str, ...], percent: tuple[str, ...]) -> DataFrame:
    """Status of each review's structured conditions against the newest features.

    reviews: code, free_text, conditions array<struct<metric, operator, threshold, enabled>>; thresholds of `percent`
    metrics are in percent. Breached goes before unevaluable, clear, manual review and not configured.
    """
    long = features.select("code", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual")) for m in metrics])).alias("f")).select("code", "f.*")
    asked = reviews.select("code", "free_text", F.explode_outer(F.filter("conditions", lambda c: c["enabled"] & c["metric"].isin(*metrics))).alias("c")).select("code", "free_text", "c.*")
    rows = asked.join(long, ["code", "metric"], "left")
    limit = F.when(F.col("metric").isin(*percent), F.col("threshold") / 100.0).otherwise(F.col("threshold"))
    a, op = F.col("actual"), F.col("operator")
    hit = F.when(op == "<", a < limit).when(op == "<=", a <= limit).when(op == ">", a > limit).when(op == ">=", a >= limit).when(op == "==", a == limit)
    counted = rows.groupBy("code").agg(
        F.count("metric").alias("n_conditions"), F.count_if(passes(hit)).alias("n_breached"), F.count_if(F.col("metric").isNotNull() & a.isNull()).alias("n_unknown"), F.first("free_text").alias("free_text")
    )
    c = F.col
    status = F.when(c("n_breached") > 0, "breached").when(c("n_unknown") > 0, "unevaluable").when(c("n_conditions") > 0, "clear").when(F.trim(F.coalesce("free_text", F.lit(""))) != "", "manual review").otherwise("not configured")
    return counted.select("code", "n_conditions", "n_breached", "n_unknown", status.alias("status"))


def star_rule_comparison(evaluations: DataFrame, returns: Callable[[DataFrame], DataFrame], horizons: tuple[int, ...]) -> DataFrame:
    """Events, matured returns, mean and share above zero of each horizon, by the old and the new rule of a star."""
    events = star_events(evaluations, "legacy").unionByName(star_events(evaluations, "reversal"))
    stats = [F.count("*").alias("events")]
    for h in horizons:
        x = F.col(f"return_{h}d")
        stats += [F.count(x).alias(f"n_{h}d"), F.avg(x).alias(f"mean_{h}d"), F.when(F.count(x) > 0, F.count_if(x > 0) / F.count(x)).alias(f"positive_{h}d")]
    return returns(events.select("star_mode", "code", "star_date", "entry_price")).groupBy("star_mode").agg(*stats)


def condition_heatmap(performance: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """condition, horizon, mean in % and count: a cell without matured events is null."""
    cells = [F.struct(F.lit(h).alias("horizon"), F.when(F.col(f"n_{h}d") > 0, 100.0 * F.col(f"mean_{h}d")).alias("mean_percent"), F.col(f"n_{h}d").alias("n")) for h in horizons]
    return performance.select("place", "condition", F.explode(F.array(*cells)).alias("c")).select("place", "condition", "c.*")


def condition_bubbles(performance: DataFrame, horizon: int) -> DataFrame:
    """Mean and share above zero, in %, of the conditions that have matured events at a horizon."""
    n = F.col(f"n_{horizon}d")
    return performance.where(n > 0).select("place", "condition", (100.0 * F.col(f"mean_{horizon}d")).alias("mean_percent"), (100.0 * F.col(f"positive_{horizon}d")).alias("positive_percent"), n.alias("n"))


def security_bubbles(events: DataFrame, across: int, up: int) -> DataFrame:
    """Mean returns of two horizons per security over the events that have both, with all its events as `stars`."""
    x, y = F.col(f"return_{across}d"), F.col(f"return_{up}d")
    paired = x.isNotNull() & y.isNotNull()
    mean = lambda c: 100.0 * F.avg(F.when(paired, c))
    return events.groupBy("code").agg(mean(x).alias("x_percent"), mean(y).alias("y_percent"), F.count("*").alias("stars"), F.count_if(paired).alias("comparable")).where("comparable > 0")


def first_codes(rows: DataFrame, size: int = 20) -> DataFrame:
    """All rows of the first `size` codes: a batch for a slow source that can be taken up again."""
    codes = rows.where(F.trim("code") != "").select("code").distinct().orderBy("code").limit(max(1, size))
    return rows.join(F.broadcast(codes), "code", "left_semi")  # size rows


ASSESSED = ("same_day", "backfilled", "not assessable")


def search_history(rows: DataFrame, text: str = "", finals: tuple[str, ...] = (), statuses: tuple[str, ...] = (), reasons: tuple[str, ...] = ()) -> DataFrame:
    """Rows by evaluation, status, reason (assessed rows need none) and a text in code or name, whatever its case."""
    if finals:
        rows = rows.where(F.col("intuitive_symbol").isin(*finals))
    if text.strip():
        wanted = text.strip().lower()
        rows = rows.where(F.lower("code").contains(wanted) | F.lower("name").contains(wanted))
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    if reasons:
        rows = rows.where(F.col("reason").isin(*reasons) | F.col("status").isin(*ASSESSED))
    return rows


def stars_only(rows: DataFrame, symbol: str = "intuitive_symbol") -> DataFrame:
    return rows.where(F.col(symbol).startswith("◎☆"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part / whole * 1000.0 + 0.5) / 10.0).cast("string")


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row of texts: how many, the most frequent evaluation, how many of each class, and what is unassessed and why."""
    known = F.nullif(F.trim("intuitive_symbol"), F.lit(""))
    # a row for each security and class; all figures are sums over these
    kinds = rows.groupBy("code", known.alias("symbol"), "status", F.coalesce("reason", F.lit("")).alias("reason"))
    kinds = stored(kinds.agg(F.count("*").alias("k"), F.min("evaluation_date").alias("first"), F.max("evaluation_date").alias("last")), "evaluation-kinds")
    top = kinds.where("symbol IS NOT NULL").groupBy("symbol").agg(F.sum("k").alias("k")).agg(F.max_by(F.struct("symbol", "k"), F.struct("k", "symbol")).alias("top"))
    why = kinds.where("status = 'unassessed' AND reason <> ''").groupBy("reason").agg(F.sum("k").alias("k")).agg(F.max_by("reason", F.struct("k", "reason")).alias("why"))
    held = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    symbol = F.col("symbol")
    one = kinds.agg(
        held(F.lit(True)).alias("n"), F.count_distinct("code").alias("codes"), F.min("first").alias("first"), F.max("last").alias("last"),
        held(symbol.isin("◎☆", "◎")).alias("high"), held(symbol.isin("○", "△")).alias("watch"), held(symbol == "×").alias("avoid"), held(F.col("status") == "unassessed").alias("open"),
    )
    one = one.join(top).join(why)  # one row each
    c = F.col
    span = F.when(c("first") == c("last"), c("first").cast("string")).otherwise(F.concat_ws(" to ", c("first").cast("string"), c("last").cast("string")))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return one.select(
        F.when(c("n") == 0, "no records").otherwise(say(c("n"), " records of ", c("codes"), " securities, ", span)).alias("extent"),
        say("most often ", c("top.symbol"), ", ", c("top.k"), " times (", _percent(c("top.k"), c("n")), "%)").alias("most"),
        say(c("high"), " high, ", c("watch"), " to watch, ", c("avoid"), " to avoid").alias("classes"),
        F.when(c("open") > 0, say(c("open"), " unassessed (", _percent(c("open"), c("n")), "%)", F.coalesce(F.concat(F.lit(", mostly "), c("why")), F.lit("")))).alias("unassessed"),
    )


def star_summary(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of texts: the star events, the horizon with the highest mean return, and how many horizons are above zero."""
    best = outcomes.where("n > 0").agg(F.max_by(F.struct("horizon", "mean_return", "n"), F.struct("mean_return", "horizon")).alias("b"), F.count("*").alias("matured"), F.count_if(F.col("mean_return") > 0).alias("rising"))
    one = events.agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes")).join(best)  # one row each
    c = F.col
    mean = (F.floor(c("b.mean_return") * 1000.0 + 0.5) / 10.0).cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return one.select(
        say(c("n"), " events of ", c("codes"), " securities").alias("extent"),
        F.when(c("matured") > 0, say("best after ", c("b.horizon"), " sessions: ", mean, "% over ", c("b.n"), " events")).otherwise("no horizon has matured").alias("best"),
        say(c("rising"), " of ", c("matured"), " horizons above zero").alias("rising"),
    )


def same_basis_only(outcomes: DataFrame, basis: str, horizons: tuple[int, ...]) -> DataFrame:
    """Outcomes whose returns of another basis are null; all carry the basis afterwards."""
    same = passes(F.col("basis") == basis)
    names = [f"{k}_{h}d" for h in horizons for k in ("return", "actual_days")]
    return outcomes.withColumns({n: F.when(same, F.col(n)) for n in names if n in outcomes.columns}).withColumn("basis", F.lit(basis))


def same_rows(one: DataFrame, other: DataFrame, columns: list[str]) -> bool:
    """Whether two tables hold the same rows in these columns, whatever their order."""
    return tuple(_print(one, columns)) == tuple(_print(other, columns))


def _print(rows: DataFrame, columns: list[str]):
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftrightunsigned(h, 20)), F.lit(0))).first()
