"""As-of joins by one ordered pass, and forward returns by session numbers or calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _apart(rows: DataFrame, unknown: Column) -> Column:
    """_apart: null, but a hash of the row if it is unknown; a window by it as well deals such rows and keeps them alone."""
    hashed = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    return F.when(unknown, F.xxhash64(*hashed)).alias("_apart")


def as_of_merge(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    left_time: str,
    right_time: str,
    forward: bool = False,
    bucket: str | None = None,
    name: str = "_found",
) -> DataFrame:
    """Each row of left with `name`, a struct of the nearest row of right of its key at or before its time (at or after,
    if forward); null where there is none.

    Both tables go through one ordering by (key, time), and the last row of right is carried along it: the work is linear
    in their rows, whatever the number of rows that stand before each. With `bucket` (a unit of date_trunc) a key's rows
    are dealt by time as well, so that a hot key isn't in one task; what a bucket leaves is carried on from bucket to
    bucket, in a table with a row for each key and bucket.

    Of rows of right with equal key and time, the greatest by all its columns counts. Rows of left without a key or time
    find nothing and are kept; such rows of right are never found. Left's columns may have any names but `name`.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    unknown = lambda time: F.exists(F.array(*[F.col(c).isNull() for c in [*key, time]]), lambda x: x)
    mine, theirs = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c) for c in right.columns])
    rights = right.where(~unknown(right_time)).select(*keys, F.col(right_time).cast("timestamp").alias("_t"), theirs.alias("_r"))
    # rows of left that find nothing are dealt by a hash of their own and meet no row of right: left is read once
    apart = _apart(left, unknown(left_time))
    lefts = left.select(*keys, F.col(left_time).cast("timestamp").alias("_t"), mine.alias("_l"), apart)
    rows = rights.unionByName(lefts, allowMissingColumns=True)
    names.append("_apart")
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    # rows of right stand before the rows of left of their time, the greatest of them last
    ordered = [time, F.col("_l").isNotNull(), F.col("_r").asc()]
    near = F.last("_r", ignorenulls=True)
    if bucket is None:
        rows = rows.withColumn("found", near.over(Window.partitionBy(*names).orderBy(*ordered)))
    else:
        rows = rows.withColumn("_b", F.date_trunc(bucket, "_t"))
        time_of = F.when(F.col("_r").isNotNull(), F.struct((-F.unix_micros("_t") if forward else F.unix_micros("_t")).alias("t"), "_r"))
        left_over = rows.groupBy(*names, "_b").agg(F.max(time_of).alias("_last"))
        chain = Window.partitionBy(*names).orderBy(F.col("_b").desc() if forward else F.col("_b").asc())
        before = F.last("_last", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1))
        carried = left_over.where("_apart IS NULL").select(*names, "_b", before.getField("_r").alias("_carried"))
        within = near.over(Window.partitionBy(*names, "_b").orderBy(*ordered))
        rows = rows.withColumn("found", within).where("_l IS NOT NULL").join(carried.drop("_apart"), [*names[:-1], "_b"], "left")
        rows = rows.withColumn("found", F.coalesce("found", F.when(F.col("_apart").isNull(), F.col("_carried"))))
    return rows.where("_l IS NOT NULL").select("_l.*", F.col("found").alias(name))


def as_of_backward(
    left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, bucket: str | None = None
) -> DataFrame:
    """Each row of left with the newest row of right of its key at or before its date (right's columns end in _r)."""
    merged = as_of_merge(left, right, [key], left_date, right_date, bucket=bucket)
    found = [F.col(f"_found.{c}").alias(f"{c}_r") for c in right.columns if c != key]
    return merged.select(*left.columns, *found)


def sessions(prices: DataFrame) -> DataFrame:
    """code, date, close and the number of the session within its security."""
    valid = prices.where("date IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)")
    return valid.select("code", "date", "close", F.row_number().over(Window.partitionBy("code").orderBy("date")).alias("session_no"))


def locate(anchors: DataFrame, numbered: DataFrame, date: str) -> DataFrame:
    """anchors with n0, the number of the last session at or before their date (0 before the first)."""
    merged = as_of_merge(anchors, numbered.select("code", "date", "session_no"), ["code"], date, "date")
    return merged.withColumn("n0", F.coalesce("_found.session_no", F.lit(0))).drop("_found")


def _suffix(delay: int) -> str:
    return f"_entry_delay_{delay}d" if delay else ""


def forward_outcomes(
    anchors: DataFrame,
    numbered: DataFrame,
    horizons: tuple[int, ...],
    delays: tuple[int, ...] = (0,),
    date: str = "as_of",
    entry: str = "entry_price",
) -> DataFrame:
    """anchors with return_{h}d and actual_days_{h}d for every horizon: the close of the h-th session strictly after the
    entry against it; for a delay above 0 with the ending _entry_delay_{delay}d, and the close of the delay-th session
    after the anchor as the entry.

    numbered: sessions(). Anchors stand among the sessions of their security in one ordering, behind those of their own
    time, and all horizons and delays are so many sessions further on: bars are dealt and ordered once, none is joined.
    Anchors without a date stand before all sessions. Returns that are not complete yet, or have no valid entry, are null.
    """
    steps = sorted({d + h for d in delays for h in horizons} | {d for d in delays if d})
    mine = F.struct(*[F.col(c) for c in anchors.columns])
    bars = numbered.where("code IS NOT NULL").select(F.col("code").alias("_k"), F.col("date").cast("timestamp").alias("_t"), F.struct("close", "date").alias("_bar"))
    apart = _apart(anchors, F.col("code").isNull())
    asked = anchors.select(F.col("code").alias("_k"), F.col(date).cast("timestamp").alias("_t"), mine.alias("_a"), apart)
    rows = bars.unionByName(asked, allowMissingColumns=True)
    over = "OVER (PARTITION BY _k, _apart ORDER BY _t ASC NULLS FIRST, _a IS NOT NULL)"
    later = [F.expr(f"lead(_bar, {s}) IGNORE NULLS {over}").alias(f"_{s}") for s in steps]
    joined = rows.select("_a", *later).where("_a IS NOT NULL")
    joined = joined.select("_a.*", *[F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in steps for c in ("close", "date")])
    found = []
    for d in delays:
        base, start = (F.col(f"{d}_close"), F.col(f"{d}_date")) if d else (F.col(entry), F.col(date))
        ok = (base > 0) & ~F.isnan(base)
        for h in horizons:
            found.append(F.when(ok, F.col(f"{d + h}_close") / base - 1.0).alias(f"return_{h}d{_suffix(d)}"))
            found.append(F.when(ok, F.datediff(F.col(f"{d + h}_date"), start)).alias(f"actual_days_{h}d{_suffix(d)}"))
    return joined.select(*anchors.columns, *found)


def forward_returns(
    anchors: DataFrame,
    prices: DataFrame,
    horizons: tuple[int, ...],
    date: str = "as_of",
    entry: str = "entry_price",
    delay: int = 0,
    suffix: str = "",
) -> DataFrame:
    """forward_outcomes of one delay over bars, with a suffix of the caller's."""
    found = forward_outcomes(anchors, sessions(prices), horizons, (delay,), date, entry)
    names = {f"{k}_{h}d{_suffix(delay)}": f"{k}_{h}d{suffix}" for h in horizons for k in ("return", "actual_days")}
    return found.withColumnsRenamed(names)


def calendar_outcomes(
    anchors: DataFrame, prices: DataFrame, days: tuple[int, ...], date: str = "as_of", entry: str = "entry_price"
) -> DataFrame:
    """anchors with return_{d}d and outcome_date_{d}d: the first close at or after the date plus d calendar days against
    the entry, and its date. Without a valid entry both are null.

    The targets of all horizons go through one forward merge with the bars.
    """
    valid = prices.where("date IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)").select("code", "date", "close")
    later = F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.date_add("_anchor", d).alias("target")) for d in days]))
    targets = anchors.select("code", F.col(date).alias("_anchor")).where("code IS NOT NULL AND _anchor IS NOT NULL").distinct()
    targets = targets.select("code", "_anchor", later.alias("t")).select("code", "_anchor", "t.days", "t.target")
    merged = as_of_merge(targets, valid, ["code"], "target", "date", forward=True).where("_found IS NOT NULL")
    at = merged.groupBy("code", "_anchor").pivot("days", list(days))
    at = at.agg(F.max("_found.close").alias("close"), F.max("_found.date").alias("date")).withColumnRenamed("_anchor", date)
    joined = anchors.join(at, ["code", date], "left")
    ok = (F.col(entry) > 0) & ~F.isnan(F.col(entry))
    found = []
    for d in days:
        found.append(F.when(ok, F.col(f"{d}_close") / F.col(entry) - 1.0).alias(f"return_{d}d"))
        found.append(F.when(ok, F.col(f"{d}_date")).alias(f"outcome_date_{d}d"))
    return joined.select(*anchors.columns, *found)


def calendar_returns(
    anchors: DataFrame, prices: DataFrame, days: tuple[int, ...], date: str = "as_of", entry: str = "entry_price"
) -> DataFrame:
    """anchors with calendar_return_{d}d: the returns of calendar_outcomes."""
    found = calendar_outcomes(anchors, prices, days, date, entry)
    return found.select(*anchors.columns, *[F.col(f"return_{d}d").alias(f"calendar_return_{d}d") for d in days])


def keep_last(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("keep_no", F.row_number().over(w)).where("keep_no = 1").drop("keep_no")


def spaced_events(events: DataFrame, gap_days: int, date: str = "analysis_date") -> DataFrame:
    """Greedy minimum gap per code: an event stays if it is at least gap_days after the last that stayed.

    The state is the last kept date, so each security's sorted dates are folded; a security has as many as it has events.
    """
    first = F.lit(None).cast("date")
    zero = F.struct(first.alias("last"), F.array().cast("array<date>").alias("kept"))
    step = lambda s, d: F.when(s["last"].isNull() | (F.datediff(d, s["last"]) >= gap_days), F.struct(d.alias("last"), F.concat(s["kept"], F.array(d)).alias("kept"))).otherwise(s)
    folded = events.groupBy("code").agg(F.sort_array(F.collect_set(date)).alias("dates"))
    return folded.select("code", F.explode(F.aggregate("dates", zero, step, lambda s: s["kept"])).alias(date))
