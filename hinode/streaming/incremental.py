"""Streaming forms of the daily increments: star transitions as keyed state, upserts per micro-batch, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hinode.operators.asof import keep_last


def read_days_as_stream(spark: SparkSession, root: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New files of a dated store, once each."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(root)


def star_transitions(evaluations: DataFrame) -> DataFrame:
    """code, evaluation_date, latest_price of evaluations (in order of arrival per code) that turn into a star.

    The state of a code is its last flag; rows without a price leave it as it is.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values("evaluation_date", kind="stable")
        rows = rows[rows["latest_price"].notna()]
        is_star = rows["is_star"].fillna(False).astype(bool)
        starts = is_star & ~is_star.shift(fill_value=bool(was))
        state.update((bool(is_star.iloc[-1]) if len(rows) else bool(was),))
        out = rows[starts]
        yield pd.DataFrame({"code": [key[0]] * len(out), "evaluation_date": out["evaluation_date"].to_numpy(), "latest_price": out["latest_price"].to_numpy()})

    return evaluations.groupBy("code").applyInPandasWithState(step, "code string, evaluation_date date, latest_price double", "was boolean", "append", GroupStateTimeout.NoTimeout)


def upsert_batch(path: str, key: list[str], stamp: str):
    """A foreachBatch function: each batch's last row per key lands in a folder of its own, so a repeated batch is the same."""

    def write(batch: DataFrame, number: int) -> None:
        keep_last(batch, key, [F.desc_nulls_last(stamp)]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_upserts(spark: SparkSession, path: str, key: list[str], stamp: str) -> DataFrame:
    """The last row of each key over all batches."""
    return keep_last(spark.read.parquet(path), key, [F.desc_nulls_last(stamp), F.desc("batch")])


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and value sums by event type and tumbling window, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
