"""Stores: all or nothing, conflicts, crashes, changed days; the archive of masters; ranges that a store lacks."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from hinode.sources import coverage, masters
from hinode.sources.versions import CommitConflict, Store, file_digests, write_csv_bom

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, v int, stamp int")


def test_tables_are_published_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version().number == 0 and store.read("a") is None
    store.commit({"a": rows(spark, ("x", 1, 1)), "b": rows(spark, ("y", 2, 1))}, {"why": "first"})
    second = store.commit({"a": rows(spark, ("x", 3, 2))})
    assert second.number == 2 and [r.v for r in store.read("a").collect()] == [3] and [r.v for r in store.read("b").collect()] == [2]
    first = store.version(1)
    assert [r.v for r in store.read("a", first).collect()] == [1] and first.notes == {"why": "first"}
    with pytest.raises(KeyError):
        store.version(9)


def test_a_lost_writer_leaves_the_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"a": rows(spark, ("x", 1, 1)), "b": rows(spark, ("x", 1, 1))})
    broken = rows(spark, ("x", 2, 2)).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": rows(spark, ("x", 2, 2)), "b": broken})
    assert store.version().number == 1 and [r.v for r in store.read("a").collect()] == [1]
    assert Store(spark, store.root).commit({"a": rows(spark, ("x", 5, 5))}).number == 2
    assert store.vacuum(keep=1) >= 2  # what the lost writer left, and the first version's table
    assert [r.v for r in store.read("a").collect()] == [5] and [r.v for r in store.read("b").collect()] == [1]
    with pytest.raises(KeyError):
        store.version(1)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    base = store.commit({"a": rows(spark, ("x", 1, 1))})
    store.commit({"a": rows(spark, ("x", 2, 1))}, base=base)
    with pytest.raises(CommitConflict):
        store.commit({"a": rows(spark, ("x", 3, 1))}, base=base)
    assert [r.v for r in store.read("a").collect()] == [2]


def test_upserts_keep_the_newest_of_each_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.upsert("a", rows(spark, ("x", 1, 1), ("y", 1, 5), ("y", 2, 4)), ["k"], "stamp")
    store.upsert("a", rows(spark, ("x", 2, 1), ("y", 3, 4), ("z", 4, None)).withColumn("note", F.lit("n")), ["k"], "stamp")
    got = {r.k: (r.v, r.note) for r in store.read("a").collect()}
    assert got == {"x": (2, "n"), "y": (1, None), "z": (4, "n")} and store.read("a").columns == ["k", "v", "stamp", "note"]
    store.upsert("a", rows(spark), ["k"], "stamp")
    assert store.read("a").count() == 3


def dated(spark, *values):
    return spark.createDataFrame(list(values), "d date, code string, v double, run string")


def test_only_changed_days_are_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = [(day(0), "a", 1.0, "r1"), (day(0), "b", 2.0, "r1"), (day(1), "a", 1.0, "r1")]
    assert store.commit_days("s", dated(spark, *first), "d", ("run",)) == ["2024-01-01", "2024-01-02"]
    # another order, another run: nothing differs
    again = [(d, c, v, "r2") for d, c, v, _ in reversed(first)]
    assert store.commit_days("s", dated(spark, *again), "d", ("run",)) == [] and store.version().number == 1
    prints = store.fingerprints("s")
    # a row twice, a new day, an untouched day
    more = [*first, (day(0), "b", 2.0, "r3"), (day(2), "a", None, "r3")]
    assert store.commit_days("s", dated(spark, *more), "d", ("run",)) == ["2024-01-01", "2024-01-03"]
    now = store.fingerprints("s")
    assert now["2024-01-02"] == prints["2024-01-02"] and now["2024-01-01"] != prints["2024-01-01"] and now["2024-01-01"][0] == 3
    assert store.read_days("s").count() == 5 and store.read_days("s", "2024-01-02", "2024-01-02").count() == 1
    assert store.read_days("s", version=store.version(1)).count() == 3
    assert store.read_days("s", "2025-01-01") is None and store.read_days("other") is None
    # a column more is a difference, and older days are read with nulls
    assert store.commit_days("s", dated(spark, first[2]).withColumn("w", F.lit(1)), "d", ("run",)) == ["2024-01-02"]
    assert {r.w for r in store.read_days("s").collect()} == {None, 1}
    with pytest.raises(ValueError):
        store.commit_days("s", dated(spark, (None, "a", 1.0, "r")), "d")
    assert store.commit_days("s", dated(spark), "d") == []


def test_csv_has_the_mark_and_files_their_digests(spark, tmp_path):
    import hashlib

    write_csv_bom(spark.createDataFrame([("トヨタ", 1)], "name string, v int").coalesce(1), f"{tmp_path}/csv")
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_bytes().decode("utf-8-sig").splitlines() == ["name,v", "トヨタ,1"] and part.read_bytes()[:3] == b"\xef\xbb\xbf"
    found = {r.file: r.sha256 for r in file_digests(spark, f"{tmp_path}/csv").collect()}
    assert found[part.name] == hashlib.sha256(part.read_bytes()).hexdigest()


# --- masters --------------------------------------------------------------------------------------------------------


def master(spark, *values):
    return spark.createDataFrame(list(values), "code string, sector string, market string")


def as_of_rows(spark, store, *days):
    asked = spark.createDataFrame([(d,) for d in days], "as_of date")
    out = {d: set() for d in days}
    for r in masters.masters_as_of(store, asked).collect():
        out[r.as_of].add((str(r.master_date), r.code, r.sector, r.market))
    return out


def test_a_late_day_splits_an_interval(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    whole = [("1", "a", "p"), ("2", "b", "p"), ("3", None, "q")]
    assert masters.archive_master(store, master(spark, *whole), "2024-01-01")
    assert masters.archive_master(store, master(spark, *whole), "2024-03-01")
    assert store.read(masters.ROWS).count() == 3  # the same rows on both days are one interval each
    late = [("1", "a", "p"), ("2", "c", "p"), ("2", "c", "p"), (None, "x", "y")]
    assert masters.archive_master(store, master(spark, *late), "2024-02-01", "run 3")
    intervals = {(r.code, r.sector, str(r.valid_from), str(r.valid_until)) for r in store.read(masters.ROWS).collect()}
    assert intervals == {
        ("1", "a", "2024-01-01", "None"),
        ("2", "b", "2024-01-01", "2024-02-01"), ("2", "b", "2024-03-01", "None"), ("2", "c", "2024-02-01", "2024-03-01"),
        ("3", None, "2024-01-01", "2024-02-01"), ("3", None, "2024-03-01", "None"),
    }
    got = as_of_rows(spark, store, day(-1), day(0), day(40), day(70))
    assert got[day(-1)] == set() and {r[1:] for r in got[day(0)]} == {r[1:] for r in got[day(70)]} == set(whole)
    assert got[day(40)] == {("2024-02-01", "1", "a", "p"), ("2024-02-01", "2", "c", "p")}
    # a day is archived once
    assert not masters.archive_master(store, master(spark, ("9", "z", "z")), "2024-02-01")
    assert not masters.archive_master(store, master(spark), "2024-04-01")
    assert {str(r.day): r.run_id for r in store.read(masters.DAYS).collect()}["2024-02-01"] == "run 3"


@pytest.mark.parametrize("seed", [1, 2])
def test_masters_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    snapshots = {}
    for n in range(6):
        codes = [str(c) for c in range(8) if rng.random() < 0.7] or ["0"]
        snapshots[day(10 * n)] = {(c, rng.choice(["a", "b", None]), rng.choice(["p", "q"])) for c in codes}
    order = list(snapshots)
    rng.shuffle(order)
    store = Store(spark, f"file://{tmp_path}/store")
    for d in order:
        assert masters.archive_master(store, master(spark, *snapshots[d]), str(d))
    asked = [day(n) for n in range(-3, 63, 6)]
    got = as_of_rows(spark, store, *asked)
    for d in asked:
        newest = max((s for s in snapshots if s <= d), default=None)
        assert got[d] == ({(str(newest), *r) for r in snapshots[newest]} if newest else set())
    # no two intervals of a row touch: they would be one
    held = sorted((r.code, str(r.sector), r.market, r.valid_from, r.valid_until or dt.date.max) for r in store.read(masters.ROWS).collect())
    for one, two in itertools.pairwise(held):
        assert one[:3] != two[:3] or one[4] < two[3]


def test_backfill_takes_certified_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    one = master(spark, ("1", "a", "p"))
    runs = [
        ("sample", one, "2024-01-01", False), ("r1", one, "2024-01-05", True), ("r2", one.withColumn("master_date", F.lit("2024-02-01")), "2024-02-09", True),
        ("none", one, None, True), ("again", one, "2024-01-05", True),
    ]
    assert masters.backfill_masters(store, runs) == ["2024-01-05", "2024-02-01"]
    assert masters.backfill_masters(store, runs) == [] and store.read(masters.ROWS).count() == 1
    assert masters.masters_as_of(Store(spark, f"file://{tmp_path}/none"), spark.createDataFrame([(day(0),)], "as_of date")) is None


# --- coverage -------------------------------------------------------------------------------------------------------


def ranges_by_hand(days, present):
    out = []
    for missing, some in itertools.groupby(days, key=lambda d: d not in present):
        some = list(some)
        if missing:
            out.append((some[0], some[-1], len(some)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_missing_ranges(spark, seed):
    rng = random.Random(seed)
    calendar = [day(n) for n in range(80) if day(n).weekday() < 5]
    keys = [("a", "x"), ("b", "y"), ("none", "z"), ("gone", "z")]
    present = {k: {d for d in calendar if rng.random() < 0.6} for k in keys[:2]} | {keys[3]: {calendar[5]}}
    seen = [(*k, d) for k, ds in present.items() for d in ds] + [("a", "x", day(5)), ("a", "x", None), ("a", "x", next(iter(present[keys[0]])))]
    cal = spark.createDataFrame([(d,) for d in calendar], "date date")
    df = spark.createDataFrame(seen, "code string, kind string, date date").repartition(3)
    got = {}
    for r in coverage.missing_ranges(df, cal, ["code", "kind"]).collect():
        got.setdefault((r.code, r.kind), []).append((r.first_day, r.last_day, r.days))
    inner = {k: ranges_by_hand([d for d in calendar if min(ds) <= d <= max(ds)], ds) for k, ds in present.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in inner.items() if v}
    bounds = {keys[0]: (day(-9), day(200)), keys[1]: (day(12), day(40)), keys[2]: (day(3), day(9)), keys[3]: (day(300), day(400))}
    windows = spark.createDataFrame([(*k, *b) for k, b in bounds.items()], "code string, kind string, start date, end date")
    got = {}
    for r in coverage.missing_ranges(df, cal, ["code", "kind"], windows).collect():
        got.setdefault((r.code, r.kind), []).append((r.first_day, r.last_day, r.days))
    asked = {k: ranges_by_hand([d for d in calendar if a <= d <= b], present.get(k, set())) for k, (a, b) in bounds.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in asked.items() if v}


def test_window_of_a_plan():
    said = "HTTP 400: Your subscription covers the following dates: 2024-02-01 ~ 2024-03-01."
    got = coverage.resolve_window(said, "2024-01-01", "2024-12-31", "2023-01-01")
    assert (got.price_start, got.price_end, got.financial_start) == ("2024-02-01", "2024-03-01", "2024-02-01") and len(got.notes) == 3
    assert coverage.resolve_window(None, "2024-01-01", "2024-12-31", "2023-01-01").notes == ()
    late = coverage.resolve_window(said, "2024-02-10", "2024-02-11", "2024-02-20")
    assert late.financial_start == "2024-02-11"
    for message, start, end in ((said, "2025-01-01", "2025-02-01"), ("HTTP 500 on 2024-01-01", "2024-01-01", "2024-02-01")):
        with pytest.raises(ValueError):
            coverage.resolve_window(message, start, end, start)
