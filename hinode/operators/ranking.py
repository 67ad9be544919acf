"""Exact ranks and quantiles within groups of any size, by range partitions and prefix counts.

A group's distinct values are counted, dealt to ranges of (group, value) and stored with the number of their range. What
stands before a value is then the sum of the ranges before its own, from a table with a row for each group and range, and
a running sum within the range. No task holds more of a group than one range, however large the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinode.sources.store import stored


def unpivot(rows: DataFrame, key: list[str], names: tuple[str, ...]) -> DataFrame:
    """key, measure and value: a row for each of the named columns that isn't null."""
    each = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])
    return rows.select(*key, F.explode(each).alias("m")).select(*key, "m.measure", "m.value").where("value IS NOT NULL")


def same_group(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of groups, which has one row for each group; nulls are a group like others."""
    named = groups.withColumnsRenamed({c: f"_{c}" for c in by})
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(named, equal, how).drop(*[f"_{c}" for c in by])


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, copies, before (how many of the group are smaller) and total (how many the group has); nulls don't count."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("copies"))
    runs = stored(counted.repartitionByRange(*by, value).withColumn("run", F.spark_partition_id()), "value-runs")
    held = runs.groupBy(*by, "run").agg(F.sum("copies").alias("held"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*by, "run", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"), F.sum("held").over(group).alias("total"))
    smaller = Window.partitionBy(*by, "run").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = same_group(runs, held, [*by, "run"]).withColumn("before", F.col("base") + F.coalesce(F.sum("copies").over(smaller), F.lit(0)))
    return placed.select(*by, value, "copies", "before", "total")


def percent_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value and percent_rank: the mean of the places that equal values share, over the number of values."""
    place = F.col("before") + 1 + (F.col("copies") - 1) / 2.0
    return value_counts(rows, by, value).select(*by, value, (place / F.col("total")).alias("percent_rank"))


def group_quantiles(rows: DataFrame, by: list[str], value: str, fractions: tuple[float, ...]) -> DataFrame:
    """by, total, q_{i}: the quantiles of each group, interpolated between the two values that a place lies between."""
    counts = value_counts(rows, by, value)
    found = [F.max("total").alias("total")]
    for i, p in enumerate(fractions):
        place = p * (F.col("total") - 1)
        for name, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            here = (F.col("before") <= at) & (at < F.col("before") + F.col("copies"))
            found.append(F.max(F.when(here, F.col(value))).alias(f"{name}_{i}"))
    one = counts.groupBy(*by).agg(*found)
    out = []
    for i, p in enumerate(fractions):
        place = p * (F.col("total") - 1)
        between = (F.ceil(place) - place) * F.col(f"low_{i}") + (place - F.floor(place)) * F.col(f"high_{i}")
        out.append(F.when(F.ceil(place) == F.floor(place), F.col(f"low_{i}")).otherwise(between).alias(f"q_{i}"))
    return one.select(*by, "total", *out)
