"""The archive of dated security masters as validity intervals of rows.

A master is a full list of securities as of a day. Most rows are equal from day to day, so the archive stores each
distinct row with the first archived day on which it holds and the first later one on which it no longer does; a new day
touches only the rows that differ from its neighbours. Days may come in any order: a day between two others splits the
intervals of rows that it doesn't have, and joins those that it does. A day is archived once, and later ones of its date
are ignored. The archive is two tables of a store, committed together: the days and the intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinode.sources.versions import Store, Version

DAYS, ROWS = "master_days", "master_rows"


def snapshot_day(master: DataFrame, fallback: str | None = None) -> str | None:
    """The day of a master: the latest of its own master_date, else the fallback."""
    if "master_date" in master.columns:
        found = master.agg(F.max(F.to_date(F.col("master_date").cast("string"))).cast("string")).first()[0]
        if found:
            return found
    return fallback


def _neighbours(store: Store, version: Version, day: str) -> tuple[list[str], str | None, str | None]:
    days = store.read(DAYS, version)
    known = sorted(str(r.day) for r in days.select("day").collect()) if days is not None else []  # a row for each archived day
    return known, max((d for d in known if d < day), default=None), min((d for d in known if d > day), default=None)


def archive_master(store: Store, master: DataFrame, day: str, run_id: str = "") -> bool:
    """Adds the master of a day; False if the day is archived already, or the master has no rows with a code.

    master: code and any attributes; all rows of the archive have the attributes of the first one, missing ones are null.
    Rows that repeat count once.
    """
    version = store.version()
    known, before, after = _neighbours(store, version, day)
    fresh = master.drop("master_date").where("code IS NOT NULL").distinct()
    if day in known or fresh.isEmpty():
        return False
    row = store.spark.createDataFrame([(day, run_id)], "day string, run_id string").select(F.to_date("day").alias("day"), "run_id")
    date = lambda text: F.lit(text).cast("date")
    if not known:
        rows = fresh.withColumns({"valid_from": date(day), "valid_until": date(None)})
        store.commit({DAYS: row, ROWS: rows}, {"archived": day}, version)
        return True
    held = store.read(ROWS, version)
    names = [c for c in held.columns if c not in ("valid_from", "valid_until")]
    for c in names:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None))
    fresh = fresh.select(*[F.col(c).cast(held.schema[c].dataType).alias(f"_{c}") for c in names]).distinct().withColumn("_there", F.lit(True))
    since, until = F.col("valid_from"), F.col("valid_until")
    # what a row says of the day: it held before and would hold on, it begins with the next day, or neither
    spans = since.isNotNull() & (since < date(day)) & (until.isNull() | (until > date(day)))
    begins = (since == date(after)) if after else F.lit(False)
    touched = held.withColumn("spans", spans).withColumn("begins", begins)
    still = touched.where("NOT spans AND NOT begins").select(*held.columns)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    both = touched.where("spans OR begins").join(fresh, same, "full")
    c = F.col
    interval = lambda a, b: F.struct(a.alias("valid_from"), b.alias("valid_until"))
    none = F.lit(None).cast("struct<valid_from:date,valid_until:date>")
    ends = F.coalesce(until == date(after), F.lit(False)) if after else F.lit(False)
    # a row that the day lacks ends with it, and begins again with the next day if it held beyond that
    cut = F.array_compact(F.array(interval(since, date(day)), F.when(~ends, interval(date(after), until)) if after else none))
    parts = (
        F.when(c("spans") & c("_there"), F.array(interval(since, until)))
        .when(c("spans"), cut)
        .when(c("begins") & c("_there"), F.array(interval(date(day), until)))
        .when(c("begins"), F.array(interval(since, until)))
        .otherwise(F.array(interval(date(day), date(after))))
    )
    values = [F.coalesce(c(n), c(f"_{n}")).alias(n) for n in names]
    changed = both.select(*values, F.explode(parts).alias("i")).select(*names, "i.valid_from", "i.valid_until")
    store.commit({DAYS: store.read(DAYS, version).unionByName(row), ROWS: still.unionByName(changed)}, {"archived": day}, version)
    return True


def backfill_masters(store: Store, runs: list[tuple[str, DataFrame, str | None, bool]]) -> list[str]:
    """Archives the masters of earlier runs (run_id, companies, cut-off day, certified) that aren't archived yet, and returns
    their days; runs that aren't certified, or have no day, are passed over."""
    made = []
    for run_id, companies, cutoff, certified in runs:
        day = snapshot_day(companies, cutoff) if certified else None
        if day and archive_master(store, companies, day, run_id):
            made.append(day)
    return made


def masters_as_of(store: Store, as_of: DataFrame) -> DataFrame | None:
    """as_of, master_date and the rows of the newest master at or before each date of as_of; dates before the first master
    have none. None without an archive."""
    version = store.version()
    days, rows = store.read(DAYS, version), store.read(ROWS, version)
    if days is None:
        return None
    chosen = as_of.select("as_of").distinct().join(F.broadcast(days), F.col("day") <= F.col("as_of"))  # a row for each archived day
    chosen = chosen.groupBy("as_of").agg(F.max("day").alias("master_date"))
    holds = (F.col("valid_from") <= F.col("master_date")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("master_date")))
    return rows.join(F.broadcast(chosen), holds).drop("valid_from", "valid_until")  # a row for each replay date
