"""Order sizing and the signal backtest: running state as folds over bounded arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_proposals(candidates: DataFrame, capital: float = 3_000_000.0, max_total: float = 0.60, max_positions: int = 6, max_position: float = 0.10, risk: float = 0.008, stop: float = 0.22, lot: int = 100, tranches: tuple = ((0.0, 0.4), (0.07, 0.3), (0.15, 0.3))) -> DataFrame:
    """Whole-lot orders of the best candidates (code, close, score) in tranches, within the total that may be invested.

    Lots are split by largest remainder. The running total is a fold over at most max_positions x tranches orders; with a
    column as_of there is one for each date.
    """
    by = [c for c in ("as_of",) if c in candidates.columns]
    if not by:
        best = candidates.orderBy(F.desc("score"), "code").limit(max_positions).withColumn("as_of", F.lit(None).cast("date"))
    else:
        best = candidates
    nth = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "code"))
    rows = best.withColumn("place", nth).where(F.col("place") <= max_positions)
    quantity = F.least(F.lit(capital * risk) / (F.col("close") * stop), F.lit(capital * max_position) / F.col("close"))
    rows = rows.withColumn("lots", F.floor(quantity / lot)).where("lots > 0")
    total = sum(w for _, w in tranches)
    parts = F.array(*[F.struct(F.lit(i + 1).alias("tranche"), F.lit(d).alias("discount"), F.lit(w / total).alias("share")) for i, (d, w) in enumerate(tranches)])
    rows = rows.withColumn("p", F.explode(parts)).select("as_of", "place", "code", "close", "lots", "p.*").withColumn("raw", F.col("lots") * F.col("share")).withColumn("base", F.floor("raw"))
    order = Window.partitionBy("as_of", "place").orderBy(F.desc(F.col("raw") - F.col("base")), "tranche")
    left = F.col("lots") - F.sum("base").over(Window.partitionBy("as_of", "place"))
    rows = rows.withColumn("extra", F.when(F.row_number().over(order) <= left, 1).otherwise(0))
    rows = rows.select("as_of", "place", "code", "tranche", F.bround(F.col("close") * (1.0 - F.col("discount")), 1).alias("limit_price"), ((F.col("base") + F.col("extra")) * lot).cast("double").alias("quantity")).where("quantity > 0")
    limit = capital * max_total
    cell = "struct<place:int,code:string,tranche:int,limit_price:double,quantity:double>"
    zero = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("skip"), F.array().cast(f"array<{cell}>").alias("out"))

    def step(s, o):
        room = F.floor((limit - s["used"]) / o["limit_price"] / lot) * lot
        fit = F.when(s["used"] + o["limit_price"] * o["quantity"] > limit, F.greatest(room.cast("double"), F.lit(0.0))).otherwise(o["quantity"])
        open_ = (s["used"] < limit) & (s["skip"] != o["place"])
        taken = F.struct(o["place"].alias("place"), o["code"].alias("code"), o["tranche"].alias("tranche"), o["limit_price"].alias("limit_price"), fit.alias("quantity")).cast(cell)
        buys = F.struct((s["used"] + o["limit_price"] * fit).alias("used"), s["skip"].alias("skip"), F.concat(s["out"], F.array(taken)).alias("out"))
        stops = F.struct(s["used"].alias("used"), o["place"].alias("skip"), s["out"].alias("out"))
        return F.when(~open_, s).when(fit > 0, buys).otherwise(stops)

    orders = rows.groupBy("as_of").agg(F.sort_array(F.collect_list(F.struct("place", "tranche", "code", "limit_price", "quantity"))).alias("orders"))
    folded = orders.select("as_of", F.explode(F.aggregate("orders", zero, step, lambda s: s["out"])).alias("o")).select("as_of", "o.*")
    return folded.select(*by, "code", "tranche", "limit_price", F.col("quantity").cast("long").alias("quantity"), (F.col("limit_price") * F.col("quantity")).alias("amount"), (F.col("limit_price") * (1.0 - stop)).alias("stop_price"))


def backtest_positions(signals: DataFrame, prices: DataFrame, top_n: int = 6, capital: float = 3_000_000.0, cost: float = 0.001) -> DataFrame:
    """Per rebalance date: cash left after buying and what was bought, each with its price then and at the next one.

    signals: signal_date, code, score. All is sold and bought anew at the day's close; a missing price is worth nothing.
    The recurrence of cash is a fold over the rebalance dates, each with at most top_n securities.
    """
    w = Window.partitionBy("signal_date").orderBy(F.desc("score"), "code")
    top = signals.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top_n)
    dates = signals.select("signal_date").distinct().join(prices.select(F.col("date").alias("signal_date")).distinct(), "signal_date", "left_semi")
    nexts = dates.withColumn("next_signal", F.lead("signal_date").over(Window.orderBy("signal_date")))  # one row per rebalance
    now = prices.select(F.col("date").alias("signal_date"), "code", F.col("close").alias("price"))
    later = prices.select(F.col("date").alias("next_signal"), "code", F.col("close").alias("next_price"))
    picks = top.join(nexts, "signal_date").join(now, ["signal_date", "code"]).where("price > 0").join(later, ["next_signal", "code"], "left")
    held = picks.groupBy("signal_date").agg(F.sort_array(F.collect_list(F.struct("n", "code", "price", F.coalesce("next_price", F.lit(0.0)).alias("next_price")))).alias("picks"))
    line = nexts.join(held, "signal_date", "left").agg(F.sort_array(F.collect_list(F.struct("signal_date", "next_signal", "picks"))).alias("line"))
    lot = "array<struct<code:string,quantity:double>>"
    item = f"struct<signal_date:date,next_signal:date,cash:double,lots:{lot}>"
    zero = F.struct(F.lit(capital).alias("value"), F.array().cast(f"array<{item}>").alias("out"))

    def step(s, r):
        target = s["value"] / F.size(r["picks"])
        bought = F.transform(r["picks"], lambda p: F.struct(p["code"].alias("code"), F.floor(target * (1.0 - cost) / p["price"]).cast("double").alias("quantity"), p["price"].alias("price"), p["next_price"].alias("next_price")))
        bought = F.coalesce(bought, F.array().cast("array<struct<code:string,quantity:double,price:double,next_price:double>>"))
        cash = s["value"] - F.aggregate(bought, F.lit(0.0), lambda a, p: a + p["quantity"] * p["price"] * (1.0 + cost))
        sold = F.aggregate(bought, F.lit(0.0), lambda a, p: a + p["quantity"] * p["next_price"])
        lots = F.transform(bought, lambda p: F.struct(p["code"].alias("code"), p["quantity"].alias("quantity")))
        entry = F.struct(r["signal_date"].alias("signal_date"), r["next_signal"].alias("next_signal"), cash.alias("cash"), lots.alias("lots")).cast(item)
        return F.struct((cash + sold * (1.0 - cost)).alias("value"), F.concat(s["out"], F.array(entry)).alias("out"))

    return line.select(F.explode(F.aggregate("line", zero, step, lambda s: s["out"])).alias("x")).select("x.*")


def backtest_curve(signals: DataFrame, prices: DataFrame, top_n: int = 6, capital: float = 3_000_000.0, cost: float = 0.001) -> DataFrame:
    """date, equity, cash, daily_return, drawdown of every market session."""
    positions = backtest_positions(signals, prices, top_n, capital, cost)
    days = prices.select("date").distinct()
    on = (F.col("date") >= F.col("signal_date")) & (F.col("next_signal").isNull() | (F.col("date") < F.col("next_signal")))
    days = days.join(F.broadcast(positions), on, "left")  # one row per rebalance
    lots = days.select("date", "cash", F.explode_outer("lots").alias("l")).select("date", "cash", "l.code", "l.quantity")
    valued = lots.join(prices.select("date", "code", "close"), ["date", "code"], "left").groupBy("date").agg(F.first("cash").alias("cash"), F.sum(F.col("quantity") * F.coalesce("close", F.lit(0.0))).alias("held"))
    curve = valued.select("date", F.coalesce("cash", F.lit(capital)).alias("cash"), (F.coalesce("cash", F.lit(capital)) + F.coalesce("held", F.lit(0.0))).alias("equity"))
    w = Window.orderBy("date")  # the market calendar: one row per session
    curve = curve.withColumn("daily_return", F.coalesce(F.col("equity") / F.lag("equity").over(w) - 1.0, F.lit(0.0)))
    return curve.withColumn("drawdown", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1.0)


def backtest_metrics(curve: DataFrame, capital: float = 3_000_000.0) -> DataFrame:
    """One row: final equity, returns, volatility, drawdown and Sharpe ratio."""
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1 / 365.25))
    final, sd = F.max_by("equity", "date"), F.stddev_samp("daily_return")
    return curve.agg(
        final.alias("final_equity"), (final / capital - 1.0).alias("total_return"), (F.pow(final / capital, 1.0 / years) - 1.0).alias("cagr"), (sd * F.sqrt(F.lit(252.0))).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"), F.when(sd > 0, F.avg("daily_return") / sd * F.sqrt(F.lit(252.0))).alias("sharpe"),
    )
