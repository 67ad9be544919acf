import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hinode.operators import prices
from hinode.operators.trailing import trailing


def test_measures_equal_window_frames_over_nulls_and_batches(spark):
    rng = random.Random(3)
    data = [(code, i, rng.choice([None, float("nan"), *[rng.uniform(-9, 9) for _ in range(12)]]), rng.choice([None, rng.uniform(0, 5)])) for code, m in (("a", 70), ("b", 1), ("c", 31), (None, 9)) for i in range(m)]
    w = Window.partitionBy("code").orderBy("day")
    rows = spark.createDataFrame(data, "code string, day int, x double, y double").withColumn("no", F.row_number().over(w))
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    expected = {
        "high": F.max("x").over(last(25)), "low": F.min("x").over(last(7)), "mean": F.avg("y").over(last(20)), "sd": F.stddev_samp("y").over(last(12)), "n": F.count("x").over(last(13)),
        "first": F.first("y", ignorenulls=True).over(last(3)), "last": F.last("y", ignorenulls=True).over(last(2)), "oldest": F.first("y").over(last(10)), "ago": F.lag("y", 4).over(w),
    }
    want = [r.asDict() for r in rows.withColumns(expected).withColumn("later", F.lag("mean", 3).over(w)).orderBy("code", "day").collect()]
    measures = {
        "high": ("max", "x", 25), "low": ("min", "x", 7), "mean": ("avg", "y", 20), "sd": ("sd", "y", 12), "n": ("count", "x", 13),
        "first": ("first", "y", 3), "last": ("last", "y", 2), "oldest": ("oldest", "y", 10), "ago": ("ago", "y", 4), "later": ("ago", "mean", 3),
    }
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("5", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = [r.asDict() for r in trailing(rows, "code", "day", "no", measures).orderBy("code", "day").collect()]
            assert [list(r) for r in got] == [list(r) for r in want]
            for a, b in zip(got, want, strict=True):
                for name in b:
                    same = b[name] if not isinstance(b[name], float) else pytest.approx(b[name], nan_ok=True, rel=1e-12)
                    assert a[name] == same, (name, a, b)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_features_of_bars_have_no_sliding_frames(spark):
    bars = spark.sql("SELECT '1' AS code, DATE '2020-01-01' AS date, 1.0D AS close, 1.0D AS high, 1.0D AS low, 1.0D AS volume, 1.0D AS turnover")
    for df in (prices.rolling_features(bars), prices.trend_indicators(bars)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for n in (13, 19, 49, 59, 125, 199, 251):
            assert f"specifiedwindowframe(RowFrame, -{n}," not in plan


def test_score_before_is_the_last_bar_so_many_days_back_read_once(spark, tmp_path):
    rng = random.Random(5)
    day = dt.date(2020, 1, 1)
    rows = [(c, day + dt.timedelta(days=n), rng.randrange(-6, 7), "x") for c in ("a", "b", None) for n in sorted(rng.sample(range(400), 90))] + [("a", None, 9, "x")]
    spark.createDataFrame(rows, "code string, date date, trend_score int, trend_state string").write.parquet(str(tmp_path / "bars"))
    found = prices.with_before(spark.read.parquet(str(tmp_path / "bars")))
    for r in found.collect():
        back = [x[1:] for x in rows if r.code and r.date and x[0] == r.code and x[1] and x[1] <= r.date - dt.timedelta(days=90)]
        assert (tuple(r._before) if r._before else None) == max(back, default=None)
    bars = spark.read.parquet(str(tmp_path / "bars")).withColumn("next_date", F.lead("date").over(prices.by_code()))
    moved = prices.trend_transition(bars, spark.createDataFrame([(dt.date(2020, 12, 1),)], "as_of date"))
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1 and moved.count() == 3


def test_wanted_rows_are_measured_over_all_rows(spark):
    rng = random.Random(7)
    data = [(code, i, rng.choice([None, rng.uniform(-9, 9), rng.uniform(-9, 9)]), rng.choice([None, False, False, True])) for code, m in (("a", 80), ("b", 1), ("c", 31)) for i in range(m)]
    rows = spark.createDataFrame(data, "code string, day int, x double, ask boolean").withColumn("no", F.row_number().over(Window.partitionBy("code").orderBy("day")))
    measures = {"mean": ("avg", "x", 20), "sd": ("sd", "x", 12), "high": ("max", "x", 25), "n": ("count", "x", 13), "oldest": ("oldest", "x", 10), "later": ("ago", "mean", 3)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for some in (measures, {k: v for k, v in measures.items() if k != "later"}):
                every = trailing(rows, "code", "day", "no", some).where("ask").orderBy("code", "day").collect()
                assert trailing(rows, "code", "day", "no", some, "ask").orderBy("code", "day").collect() == every and every
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bars_are_dealt_by_code_alone_and_return_only_what_stands(spark):
    start = dt.date(2020, 1, 1)
    bars = spark.createDataFrame([(c, start + dt.timedelta(days=2 * i), 1.0 + i % 5, 2.0, 0.5, 1.0, 9.0) for c in "ab" for i in range(60)], "code string, date date, close double, high double, low double, volume double, turnover double")
    index = bars.groupBy("date").agg(F.avg("close").alias("index_close"))
    as_of = spark.createDataFrame([(start + dt.timedelta(days=n),) for n in (61, 62, 63, 900)], "as_of date")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = prices.price_features(bars, as_of, index)
        plan = found._jdf.queryExecution().executedPlan().toString().replace("date_", "")
        assert plan.count("hashpartitioning(code") == 1 and "SortMergeJoin" not in plan
        assert prices.rolling_features(bars, index, as_of).count() == 6
        every = prices.pick_as_of(prices.rolling_features(bars, index), as_of)
        assert found.orderBy("code", "as_of").collect() == every.orderBy("code", "as_of").collect() and every.count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
