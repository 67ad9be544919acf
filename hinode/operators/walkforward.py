"""Point-in-time replay: schedule, cohorts, matched controls, episodes and their summaries.

The replay date is a column (as_of) throughout, so a replay of many dates is one partitioned plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import passes
from hinode.operators.ranking import group_quantiles, unpivot
from hinode.sources.store import stored

REGIMES = ("falling", "flat", "rising", "unknown")


def replay_dates(prices: DataFrame, snapshots: int, spacing: int, history: int = 252, future: int = 10) -> DataFrame:
    """as_of and snapshot_no: market sessions stepped back by `spacing` from the last with `future` sessions after it."""
    calendar = prices.where("date IS NOT NULL").select("date").distinct()
    # the market calendar: one row per session, some 250 a year
    numbered = calendar.select("date", F.row_number().over(Window.orderBy("date")).alias("no"), F.count("*").over(Window.partitionBy()).alias("total"))
    back = F.col("total") - future - F.col("no")
    chosen = numbered.where((F.col("total") >= history + future) & (F.col("no") >= history) & (back >= 0) & (back % spacing == 0) & (back < spacing * snapshots))
    return chosen.select(F.col("date").alias("as_of"), F.row_number().over(Window.orderBy("date")).alias("snapshot_no"))


def cohort_audit(prices: DataFrame, filings: DataFrame, master: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per replay date: securities with prices and filings by then, how many of them the master knows, how many not."""
    dates = F.broadcast(as_of.select("as_of"))
    traded = prices.join(dates, F.col("date") <= F.col("as_of")).select("as_of", "code").distinct()
    filed = filings.join(dates, F.col("disclosure_date") <= F.col("as_of")).select("as_of", "code").distinct()
    known = master.select("code", F.lit(True).alias("in_master")).distinct()
    seen = traded.join(filed, ["as_of", "code"], "left_semi").join(known, "code", "left")
    return seen.groupBy("as_of").agg(F.count("*").alias("observable"), F.count_if("in_master").alias("covered"), F.count_if(F.col("in_master").isNull()).alias("missing"))


MATCH_ON = ("market_cap", "drawdown_52w", "volatility_60d", "per_vs_sector", "pbr_vs_sector")


#: Rows of a pool, and targets, that one task compares.
POOL_ROWS, TARGET_ROWS = 4096, 1024


def match_scales(pool: DataFrame) -> DataFrame:
    """day_no and s_{measure}: the interquartile range of each measure of a pool, or its standard deviation; null if both
    are 0. With fewer than four values it is their range."""
    names = tuple(f"m_{c}" for c in MATCH_ON)
    long = unpivot(pool, ["day_no"], names)
    quartiles = group_quantiles(long, ["day_no", "measure"], "value", (0.0, 0.25, 0.75, 1.0))
    spread = F.when(F.col("total") >= 4, F.col("q_2") - F.col("q_1")).otherwise(F.col("q_3") - F.col("q_0"))
    spreads = quartiles.groupBy("day_no").agg(*[F.max(F.when(F.col("measure") == n, spread)).alias(f"i_{n[2:]}") for n in names])
    deviations = pool.groupBy("day_no").agg(*[F.stddev_samp(n).alias(f"d_{n[2:]}") for n in names])
    both = deviations.join(spreads, "day_no", "left")
    scale = [F.when(F.col(f"i_{c}") > 0, F.col(f"i_{c}")).when(F.col(f"d_{c}") > 0, F.col(f"d_{c}")).alias(f"s_{c}") for c in MATCH_ON]
    return both.select("day_no", *scale)


def _distances(pool: pd.DataFrame, targets: pd.DataFrame) -> np.ndarray:
    """A row for each target: its distance to each row of the pool, NaN where fewer than two measures are shared."""
    total, seen = np.zeros((len(targets), len(pool))), np.zeros((len(targets), len(pool)), int)
    for c in MATCH_ON:
        scale = targets[f"s_{c}"].to_numpy(float)[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = np.abs(pool[f"m_{c}"].to_numpy(float)[None, :] - targets[f"m_{c}"].to_numpy(float)[:, None]) / scale
        known = ~np.isnan(gap) & (scale > 0)
        total += np.where(known, gap, 0.0)
        seen += known
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(seen >= 2, total / seen, np.nan)


def _nearest(rows: pd.DataFrame, count: int) -> pd.DataFrame:
    """Of one block of a pool and of targets: each target's first `count` by tier, distance and code."""
    targets, pool = rows[rows["is_target"]], rows[~rows["is_target"]].sort_values("code", kind="stable")
    found = []
    for at in range(0, len(targets), 256):
        some = targets.iloc[at : at + 256]
        distance = _distances(pool, some)
        alike = lambda c: some[c].notna().to_numpy()[:, None] & (some[c].to_numpy()[:, None] == pool[c].to_numpy()[None, :])
        tier = np.where(alike("sector"), 1, np.where(alike("market"), 2, 3))
        least = some["least_tier"].to_numpy()[:, None]
        distance = np.where(tier < least, np.nan, distance)
        # order by tier, then distance; equal ones stay in order of code
        order = np.lexsort((distance, np.where(np.isnan(distance), 9, tier)), axis=1)[:, :count]
        row, col = np.repeat(np.arange(len(some)), order.shape[1]), order.ravel()
        ok = ~np.isnan(distance[row, col])
        row, col = row[ok], col[ok]
        found.append(
            pd.DataFrame(
                {
                    "day_no": some["day_no"].to_numpy()[row],
                    "target": some["code"].to_numpy()[row],
                    "code": pool["code"].to_numpy()[col],
                    "tier": tier[row, col],
                    "distance": distance[row, col],
                }
            )
        )
    return pd.concat(found) if found else pd.DataFrame(columns=["day_no", "target", "code", "tier", "distance"])


def _nearest_in_blocks(pool: DataFrame, targets: DataFrame, by: list[str], count: int) -> DataFrame:
    """day_no, target, code, tier, distance: each target's nearest within the rows of equal `by`.

    Both sides are dealt to blocks, and each block of targets meets each block of the pool in a task of its own, which hands
    on `count` rows a target at most; only these are ranked together.
    """
    blocks = lambda df, rows, name: df.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    grid = blocks(pool, POOL_ROWS, "pool_blocks").join(blocks(targets, TARGET_ROWS, "target_blocks"), by)
    block = lambda name: F.pmod(F.xxhash64("code"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    names = [*dict.fromkeys(["day_no", "code", "sector", "market", *by])]
    measures = [f"m_{c}" for c in MATCH_ON]
    none = [F.lit(None).cast("double").alias(f"s_{c}") for c in MATCH_ON]
    pools = pool.join(grid, by).select(*names, *measures, *none, F.lit(1).alias("least_tier"), F.lit(False).alias("is_target"), block("pool_blocks").alias("pool_block"), every("target_blocks").alias("target_block"))
    asked = targets.join(grid, by).select(*names, *measures, *[f"s_{c}" for c in MATCH_ON], "least_tier", F.lit(True).alias("is_target"), every("pool_blocks").alias("pool_block"), block("target_blocks").alias("target_block"))
    schema = "day_no int, target string, code string, tier int, distance double"
    near = pools.unionByName(asked).groupBy(*by, "pool_block", "target_block").applyInPandas(lambda pdf: _nearest(pdf, count), schema)
    w = Window.partitionBy("day_no", "target").orderBy("tier", "distance", "code")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)


def matched_controls(table: DataFrame, count: int = 5) -> DataFrame:
    """For each selected row of a replay date its nearest non-selected ones: same sector first, then market, then rest.

    Distances are mean absolute differences in units of the pool's interquartile range, over the measures both have (two
    at least). A target meets its own sector first; only targets that this leaves short go on, to the rest of the date.
    Within a sector or a date, blocks of bounded size are compared, each of which keeps `count` rows a target.
    """
    value = {c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(c, F.lit(0.0)))) if c == "market_cap" else F.col(c) for c in MATCH_ON}
    day_no = F.row_number().over(Window.orderBy("as_of")).cast("int")  # replay dates, times variants
    days = table.select("as_of").distinct().withColumn("day_no", day_no)
    rows = table.select("as_of", "code", "sector", "market", "selected", *[value[c].cast("double").alias(f"m_{c}") for c in MATCH_ON])
    rows = stored(rows.join(F.broadcast(days), "as_of").drop("as_of"), "matching")
    days = stored(days, "matching-days")
    chosen = passes(F.col("selected"))
    pool = rows.where(~chosen).drop("selected")
    targets = rows.where(chosen).drop("selected").join(match_scales(pool), "day_no")
    own = _nearest_in_blocks(pool.where("sector IS NOT NULL"), targets.where("sector IS NOT NULL").withColumn("least_tier", F.lit(1)), ["day_no", "sector"], count)
    own = stored(own, "same-sector")
    taken = own.groupBy("day_no", F.col("target").alias("code")).agg(F.count("*").cast("int").alias("taken"))
    short = targets.join(taken, ["day_no", "code"], "left").na.fill(0, ["taken"]).where(F.col("taken") < count)
    short = short.withColumn("least_tier", F.lit(2))
    more = _nearest_in_blocks(pool, short, ["day_no"], count)
    more = more.join(short.select("day_no", F.col("code").alias("target"), "taken"), ["day_no", "target"])
    more = more.withColumn("place", F.col("place") + F.col("taken")).where(F.col("place") <= count).drop("taken")
    found = own.unionByName(more).join(F.broadcast(days), "day_no")
    return found.select("as_of", "target", "code", "tier", "place", "distance")


def add_episodes(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """episode_id: runs of adjacent replay numbers of one code (within each value of `by`)."""
    w = Window.partitionBy(*by, "code").orderBy("snapshot_no")
    rows = events.withColumn("island", F.col("snapshot_no") - F.row_number().over(w))
    start = F.min("snapshot_no").over(Window.partitionBy(*by, "code", "island"))
    return rows.withColumn("episode_id", F.concat_ws(":", "code", start)).drop("island")


def first_of_episode(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*by, "episode_id").orderBy("as_of", "code")
    return events.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def market_regime(index_return: F.Column) -> F.Column:
    return F.when(index_return.isNull(), "unknown").when(index_return <= -0.05, "falling").when(index_return >= 0.05, "rising").otherwise("flat")


def _stats(value: str) -> list:
    x = F.col(value)
    n = F.count(x)
    share = lambda c: F.when(n > 0, F.count_if(c) / n)
    return [n.alias("n"), F.avg(x).alias("mean_return"), F.median(x).alias("median_return"), share(x > 0).alias("positive_share"), share(x <= -0.05).alias("loss_share")]


def horizon_summary(events: DataFrame, horizons: tuple[int, ...], by: list[str] | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """Per horizon (and `by`): first events of episodes, their controls and the edge over them. key: what tells the
    episodes of several replays in one table apart."""
    by = by or []
    long = lambda df: df.select(*by, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d").alias("r"), F.col(f"control_return_{h}d").alias("c"), F.col(f"selection_edge_{h}d").alias("e")) for h in horizons])).alias("x")).select(*by, "x.*")
    share = lambda c: F.when(F.count(c) > 0, F.count_if(F.col(c) > 0) / F.count(c))
    once = long(first_of_episode(events, key)).groupBy(*by, "horizon").agg(F.count("r").alias("episodes"), F.avg("r").alias("mean_return"), share("r").alias("positive_share"), F.avg("c").alias("control_mean"), F.avg("e").alias("edge"), share("e").alias("edge_positive_share"))
    return long(events).groupBy(*by, "horizon").agg(F.count("r").alias("events")).join(once, [*by, "horizon"], "left").na.fill(0, ["episodes"])


#: Modulus, multipliers and shifts of the mixing of row and sample numbers; products stay within a long.
_PRIME, _MIX = (1 << 31) - 1, ((15, 48271), (13, 69621), (16, 16807))


def _poisson_weight(row: F.Column, sample: F.Column, seed: int) -> F.Column:
    """A weight of Poisson(1) for a row (a number below 2^31) in a sample, by the inverse distribution of a mixed number."""
    x = F.pmod(row + sample * F.lit(1_000_003) + F.lit(seed), F.lit(_PRIME))
    for shift, factor in _MIX:
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor), F.lit(_PRIME))
    u = (x + 0.5) / float(_PRIME)
    weight, chance, total = F.when(u < np.exp(-1.0), 0), np.exp(-1.0), np.exp(-1.0)
    for k in range(1, 12):
        chance /= k
        total += chance
        weight = weight.when(u < float(total), k)
    return weight.otherwise(12)


def bootstrap_edges(events: DataFrame, horizons: tuple[int, ...], samples: int = 2000, seed: int = 20261019) -> DataFrame:
    """horizon, n, low, high, nonpositive_share: a bootstrap interval of the mean edge of first events.

    A Poisson bootstrap: in each resample an event has a weight of its own, drawn from the seed, the resample's number and
    a hash of the event, so tasks sum their events' weights by themselves and only `samples` rows of each task are
    shuffled. Fewer than two events have no interval.
    """
    once = first_of_episode(events)
    row = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("code"), F.col("as_of").cast("string"))), 1, 7), 16, 10).cast("long")
    edges = [F.col(f"selection_edge_{h}d").alias(f"e_{h}") for h in horizons]
    known = F.exists(F.array(*[F.col(f"selection_edge_{h}d").isNotNull() for h in horizons]), lambda x: x)
    rows = once.where(known).select(row.alias("row"), *edges)
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    drawn = drawn.withColumn("w", _poisson_weight(F.col("row"), F.col("sample").cast("long"), seed)).where("w > 0")
    sums = [F.sum(F.col("w") * F.col(f"e_{h}")).alias(f"t_{h}") for h in horizons]
    sums += [F.sum(F.when(F.col(f"e_{h}").isNotNull(), F.col("w"))).alias(f"w_{h}") for h in horizons]
    resampled = drawn.groupBy("sample").agg(*sums)
    means = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(f"t_{h}") / F.col(f"w_{h}")).alias("m")) for h in horizons])
    found = resampled.select(F.explode(means).alias("x")).select("x.*").where("m IS NOT NULL")  # samples times horizons
    nothing = F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)).alias("none")
    found = found.groupBy("horizon").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), nothing)
    counts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"n_{h}").alias("n")) for h in horizons])
    counted = rows.agg(*[F.count(f"e_{h}").alias(f"n_{h}") for h in horizons]).select(F.explode(counts).alias("x")).select("x.*")
    enough = lambda c: F.when(F.col("n") >= 2, c)
    both = counted.where("n > 0").join(found, "horizon")
    return both.select("horizon", "n", enough(F.col("p")[0]).alias("low"), enough(F.col("p")[1]).alias("high"), enough(F.col("none")).alias("nonpositive_share"))


def _by_horizon(rows: DataFrame, horizons: tuple[int, ...], by: list[str], ending: str = "") -> DataFrame:
    """by, horizon and r: a row for each horizon's return."""
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d{ending}").alias("r")) for h in horizons])
    return rows.select(*by, F.explode(each).alias("x")).select(*by, "x.horizon", "x.r")


def cohort_summary(events: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Per horizon nested cohorts: all selected, those with the legacy star, those whose reversal is confirmed."""
    stages = F.array_compact(F.array(F.lit("all"), F.when(passes(F.col("legacy_star")), "legacy star"), F.when(passes(F.col("reversal_star")), "reversal star")))
    once = first_of_episode(events).withColumn("cohort", F.explode(stages))
    return _by_horizon(once, horizons, ["cohort"]).groupBy("horizon", "cohort").agg(F.count("*").alias("members"), *_stats("r"))


def timing_summary(events: DataFrame, horizons: tuple[int, ...], delays: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Per horizon, entry at the selection's close or some sessions later."""
    names = [(F.lit(h), F.lit(d), F.col(f"return_{h}d" + (f"_entry_delay_{d}d" if d else ""))) for h in horizons for d in (0, *delays)]
    parts = F.array(*[F.struct(h.alias("horizon"), d.alias("delay"), r.alias("r")) for h, d, r in names])
    rows = first_of_episode(events).select(F.explode(parts).alias("x")).select("x.*")
    return rows.groupBy("horizon", "delay").agg(*_stats("r"))


def attribution_bands(events: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Per horizon, outcomes by how much of the fall was explained, in bands closed on the right."""
    s = F.col("external_shock_attribution") * 100.0
    band = F.when(s <= 25, "0-25").when(s <= 50, "25-50").when(s <= 75, "50-75").otherwise("75-100")
    rows = first_of_episode(events).where(s.isNotNull()).withColumn("band", band)
    return _by_horizon(rows, horizons, ["band"]).where("r IS NOT NULL").groupBy("horizon", "band").agg(*_stats("r"))


def replay_readiness(prices: DataFrame, horizons: tuple[int, ...], snapshots: int = 8, spacing: int = 20, history: int = 252, delay: int = 5) -> DataFrame:
    """One row: how many sessions there are, which horizons they support, and what one replay or the whole mode needs."""
    one = prices.where("date IS NOT NULL").agg(F.count_distinct("date").cast("int").alias("available_sessions"))
    asked = F.array(*[F.lit(h) for h in sorted(set(horizons))])
    room = F.greatest(F.col("available_sessions") - history - delay, F.lit(0))
    one = one.withColumn("maximum_horizon", room).withColumn("supported_horizons", F.filter(asked, lambda h: h <= F.col("available_sessions") - history - delay))
    future = F.coalesce(F.array_max("supported_horizons"), F.lit(min(horizons, default=0))) + delay
    one = one.withColumn("sessions_for_one", future + history + 1).withColumn("sessions_for_all", F.col("sessions_for_one") + (snapshots - 1) * spacing)
    usable = F.when(F.col("available_sessions") >= history + future, F.least(F.lit(snapshots), F.floor((F.col("available_sessions") - future - history) / spacing) + 1)).otherwise(0)
    return one.withColumn("usable_replays", usable.cast("int")).withColumn("missing_sessions", F.greatest(F.col("sessions_for_all") - F.col("available_sessions"), F.lit(0)))


def result_overview(events: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row of a replay's result: events, episodes and dates, their span, and the matured share of each horizon in %."""
    return events.agg(
        F.count("*").alias("events"), F.count_distinct("episode_id").alias("episodes"), F.count_distinct("as_of").alias("dates"), F.min("as_of").alias("first_date"), F.max("as_of").alias("last_date"),
        *[F.when(F.count("*") > 0, 100.0 * F.count(f"return_{h}d") / F.count("*")).alias(f"matured_{h}d") for h in horizons],
    )


def replay_exclusions(prices: DataFrame, as_of: DataFrame, history: int = 252) -> DataFrame:
    """Per replay date: securities with any bars by then, and how many of them have too few for a replay."""
    counts = prices.where("date IS NOT NULL").join(F.broadcast(as_of.select("as_of")), F.col("date") <= F.col("as_of")).groupBy("as_of", "code").agg(F.count("*").alias("n"))  # replay dates
    return counts.groupBy("as_of").agg(F.count("*").alias("securities"), F.count_if(F.col("n") < history).alias("excluded"))


def matured_summary(events: DataFrame, horizons: tuple[int, ...], by: list[str]) -> DataFrame:
    """Per horizon and `by`: events whose return and edge are known, and the first of each run of adjacent replays among these."""
    parts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d").alias("r"), F.col(f"selection_edge_{h}d").alias("e")) for h in horizons])
    rows = events.select(*by, "code", "snapshot_no", F.explode(parts).alias("x")).select(*by, "code", "snapshot_no", "x.*").where("r IS NOT NULL AND e IS NOT NULL")
    before = F.lag("snapshot_no").over(Window.partitionBy(*by, "horizon", "code").orderBy("snapshot_no"))
    rows = rows.withColumn("starts", ~F.coalesce(F.col("snapshot_no") - before == 1, F.lit(False)))
    once = lambda c: F.when(F.col("starts"), c)
    n = F.count_if("starts")
    return rows.groupBy(*by, "horizon").agg(F.count("*").alias("matured"), n.alias("episodes"), F.avg(once(F.col("e"))).alias("edge"), F.when(n > 0, F.count_if(F.col("starts") & (F.col("r") > 0)) / n).alias("positive_share"))
