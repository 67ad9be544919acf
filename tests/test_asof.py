"""The ordered merge against a plain search, in both directions, with and without buckets, ties and nulls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hinode.operators import asof, history

DAY = dt.date(2023, 11, 20)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def tables(spark, seed):
    rng = random.Random(seed)
    codes = ["hot"] * 6 + ["a", "b", "only left", None]
    left = [(i, rng.choice(codes), day(rng.choice([*range(90), None]))) for i in range(150)]
    right = [(rng.choice([c for c in codes if c != "only left"]), day(rng.choice([*range(20, 80), None])), rng.randrange(6)) for _ in range(80)]
    right += [right[0], right[0], ("hot", day(40), None)]
    return (
        left,
        right,
        spark.createDataFrame(left, "i int, code string, found date").repartition(3),
        spark.createDataFrame(right, "code string, date date, v int").repartition(3),
    )


@pytest.mark.parametrize("bucket", [None, "month", "year"])
@pytest.mark.parametrize("forward", [False, True])
def test_merge_finds_the_nearest(spark, bucket, forward):
    left, right, left_df, right_df = tables(spark, 3)
    merged = asof.as_of_merge(left_df.withColumnRenamed("found", "day"), right_df, ["code"], "day", "date", forward, bucket, name="found")
    got = {r.i: tuple(r.found) if r.found else None for r in merged.collect()}
    assert merged.columns == ["i", "code", "day", "found"] and len(got) == len(left)
    for i, code, when in left:
        fits = [r for r in right if when and code and r[0] == code and r[1] and (r[1] >= when if forward else r[1] <= when)]
        best = (min if forward else max)((r[1] for r in fits), default=None)
        # of equal dates the greatest row, nulls first
        expected = max((r for r in fits if r[1] == best), key=lambda r: (r[2] is not None, r[2] or 0), default=None)
        assert got[i] == expected


def test_backward_join_keeps_rows_and_names(spark):
    left, _, left_df, right_df = tables(spark, 5)
    rows = asof.as_of_backward(left_df, right_df, "code", "found", "date")
    assert rows.columns == ["i", "code", "found", "date_r", "v_r"] and rows.count() == len(left)
    assert not asof.as_of_backward(left_df.limit(0), right_df, "code", "found", "date").count()
    assert asof.as_of_backward(left_df, right_df.limit(0), "code", "found", "date").where("v_r IS NULL").count() == len(left)


def test_merge_has_no_range_join(spark):
    _, _, left_df, right_df = tables(spark, 1)
    plan = asof.as_of_backward(left_df, right_df, "code", "found", "date")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def bars(spark, code, days, closes):
    return spark.createDataFrame([(code, day(d), c) for d, c in zip(days, closes, strict=True)], "code string, date date, close double")


def test_calendar_outcomes_take_the_first_close_on_or_after(spark):
    prices = bars(spark, "1", [0, 29, 31, 33, 95], [100.0, float("nan"), 110.0, 50.0, 120.0])
    anchors = spark.createDataFrame(
        [("1", day(0), 100.0), ("1", day(0), 50.0), ("1", day(3), None), ("1", day(1), -5.0), ("2", day(0), 1.0), (None, day(0), 1.0), ("1", None, 1.0)],
        "code string, as_of date, entry_price double",
    )
    got = sorted(asof.calendar_outcomes(anchors, prices, (30, 90)).collect(), key=str)
    found = {(r.code, r.as_of, r.entry_price): (r.return_30d, r.outcome_date_30d, r.return_90d) for r in got}
    assert len(got) == 7
    assert found["1", day(0), 100.0] == (pytest.approx(0.1), day(31), pytest.approx(0.2))
    assert found["1", day(0), 50.0] == (pytest.approx(1.2), day(31), pytest.approx(1.4))
    assert [v for k, v in found.items() if k[0] != "1" or k[1] is None or k[2] in (None, -5.0)] == [(None, None, None)] * 5


def test_one_look_up_gives_all_horizons_and_delays(spark):
    prices = bars(spark, "1", range(12), [float(100 + 7 * (i % 5)) for i in range(12)])
    anchors = spark.createDataFrame([("1", day(2), 114.0), ("1", day(8), 121.0), ("1", day(-3), 5.0), ("2", day(2), 5.0)], "code string, as_of date, entry_price double")
    whole = asof.forward_outcomes(anchors, asof.sessions(prices), (1, 3, 6), (0, 2))
    closes = {d: 100.0 + 7 * (d % 5) for d in range(12)}
    for r in whole.collect():
        first = (r.as_of - DAY).days if r.code == "1" else 99
        first = max(first, -1)
        for delay, ending in ((0, ""), (2, "_entry_delay_2d")):
            base = closes.get(first + delay) if delay else r.entry_price
            for h in (1, 3, 6):
                end = closes.get(first + delay + h)
                expected = end / base - 1 if end and base else None
                assert r[f"return_{h}d{ending}"] == (None if expected is None else pytest.approx(expected))
    late = asof.forward_returns(anchors, prices, (3,), delay=2, suffix="_late").select("code", "as_of", "return_3d_late")
    same = whole.select("code", "as_of", F.col("return_3d_entry_delay_2d").alias("return_3d_late"))
    assert sorted(map(str, late.collect())) == sorted(map(str, same.collect()))


def test_outcomes_enter_at_the_first_close_if_they_have_no_price(spark):
    prices = bars(spark, "1", [0, 3, 4, 5], [100.0, 110.0, 121.0, 99.0])
    rows = [("1", day(0), 50.0), ("1", day(1), None), ("1", day(3), -1.0), ("1", day(9), None), ("2", day(0), None), ("1", day(4), float("nan"))]
    events = spark.createDataFrame(rows, "code string, star_date date, entry_price double")
    got = sorted(tuple(r) for r in history.enrich_outcomes(events, prices, (1,), "b").select("code", "star_date", "entry_price", "return_1d", "basis").collect())
    ten = pytest.approx(0.1)
    assert got == [
        ("1", day(0), 50.0, pytest.approx(1.2), "b"), ("1", day(3), 110.0, ten, "b"), ("1", day(3), 110.0, ten, "b"),
        ("1", day(4), 121.0, pytest.approx(99 / 121 - 1), "b"), ("1", day(9), None, None, None), ("2", day(0), None, None, None),
    ]
    saved = spark.createDataFrame([("1", day(0), 40.0, 0.7, "b"), ("1", day(0), 41.0, 0.8, "b"), ("1", day(4), 1.0, 9.0, "old")], "code string, star_date date, entry_price double, return_1d double, basis string")
    made = history.enrich_outcomes(events.limit(1), prices, (1,), "b")
    kept = history.reconcile_outcomes(made, saved, (1,)).first()
    assert (kept.entry_price, kept.return_1d, kept.actual_days_1d) == (41.0, 0.8, 3)


def scans(df):
    """How often the plan reads each of its sources."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_merge_and_outcomes_read_both_sides_once(spark, tmp_path):
    left, _, left_df, right_df = tables(spark, 7)
    left_df.write.parquet(str(tmp_path / "left"))
    right_df.withColumn("close", F.lit(1.0)).write.parquet(str(tmp_path / "right"))
    mine, theirs = spark.read.parquet(str(tmp_path / "left")), spark.read.parquet(str(tmp_path / "right"))
    merged = asof.as_of_merge(mine, theirs, ["code"], "found", "date", name="near")
    assert scans(merged) == 2 and merged.count() == len(left)
    anchors = mine.withColumn("entry_price", F.lit(1.0))
    found = asof.forward_outcomes(anchors, asof.sessions(theirs), (1, 3), (0, 2), date="found")
    assert scans(found) == 2 and found.count() == len(left)


def test_outcomes_of_anchors_between_before_and_without_sessions(spark):
    prices = bars(spark, "1", [2, 4, 6, 8], [10.0, 20.0, 30.0, 40.0])
    rows = [("1", day(0)), ("1", day(4)), ("1", day(5)), ("1", None), ("2", day(4)), (None, day(4)), (None, day(4)), ("1", day(9))]
    anchors = spark.createDataFrame([(*r, 10.0, {"k": 1}) for r in rows], "code string, as_of date, entry_price double, note map<string,int>")
    got = sorted(((r.code, r.as_of, r.return_2d, r.actual_days_2d) for r in asof.forward_outcomes(anchors, asof.sessions(prices), (2,)).collect()), key=str)
    late = pytest.approx
    expected = [("1", day(0), late(1.0), 4), ("1", day(4), late(3.0), 4), ("1", day(5), late(3.0), 3), ("1", None, late(1.0), None), ("2", day(4), None, None), (None, day(4), None, None), (None, day(4), None, None), ("1", day(9), None, None)]
    assert len(got) == 8 and all(e in got for e in expected)
