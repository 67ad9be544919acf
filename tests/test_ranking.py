"""Distributed ranks, quantiles and nearest controls against plain versions, with ties, null groups and many ranges."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from hinode.operators import criteria, fundamentals, ranking, walkforward


def values(seed, n=400):
    rng = random.Random(seed)
    groups = ["a"] * 30 + ["b", "c", None]
    pick = lambda: rng.choice([None, rng.randrange(5) / 4, rng.gauss(0, 3), rng.gauss(0, 3)])
    return [(i, rng.choice(groups), pick()) for i in range(n)]


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set(name, before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_ranks_and_quantiles(spark, many_ranges, seed):
    rows = values(seed)
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(4)
    by = {}
    for _, g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    counts = {(r.g, r.v): (r.copies, r.before, r.total) for r in ranking.value_counts(df, ["g"], "v").collect()}
    assert counts == {(g, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for g, vs in by.items() for v in vs}
    ranks = {(r.g, r.v): r.percent_rank for r in ranking.percent_ranks(df, ["g"], "v").collect()}
    for (g, v), rank in ranks.items():
        vs = by[g]
        assert rank == pytest.approx((sum(x < v for x in vs) + (vs.count(v) + 1) / 2) / len(vs))
    got = {r.g: r for r in ranking.group_quantiles(df, ["g"], "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    assert got.keys() == by.keys()
    expected = df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0)))).alias("p")).collect()
    for r in expected:
        assert [got[r.g][f"q_{i}"] for i in range(4)] == pytest.approx(r.p) and got[r.g].total == len(by[r.g])
        assert got[r.g].q_2 == pytest.approx(statistics.median(by[r.g]))


def test_empty_and_single_values(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert not ranking.percent_ranks(none, ["g"], "v").count() and not ranking.group_quantiles(none, ["g"], "v", (0.5,)).count()
    one = spark.createDataFrame([("a", 2.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in ranking.group_quantiles(one, ["g"], "v", (0.25,)).collect()] == [("a", 1, 2.0)]


def features(spark, n=60):
    rng = random.Random(9)
    some = lambda: rng.choice([None, rng.uniform(-1, 3), rng.uniform(-1, 3), 0.5])
    rows = [(f"2024-01-0{1 + i % 2}", f"{i}", rng.choice(["x", "y", None]), *[some() for _ in range(6)]) for i in range(n)]
    names = ("return_6m", "per", "pbr", *criteria.ACTIVITY)
    return rows, spark.createDataFrame(rows, "as_of string, code string, sector string, " + ", ".join(f"{c} double" for c in names))


def test_sector_context_against_lists(spark, many_ranges):
    rows, df = features(spark)
    for r in fundamentals.add_sector_context(df).collect():
        peers = [x for x in rows if x[0] == r.as_of and x[2] == r.sector]
        known = [x[3] for x in peers if x[3] is not None]
        assert r.sector_peer_count_6m == len(known)
        median = statistics.median(known) if known else None
        assert r.sector_return_6m_median == (None if median is None else pytest.approx(median))
        enough = len(known) >= 5 and r.return_6m is not None
        assert r.sector_relative_return_6m == (pytest.approx(r.return_6m - median) if enough else None)
        pers = [x[4] for x in peers if x[4] is not None]
        middle = statistics.median(pers) if pers else None
        assert r.per_vs_sector == (pytest.approx(r.per / middle) if r.per is not None and middle else None)


def test_no_window_holds_a_date_or_sector(spark):
    _, df = features(spark)
    for made in (fundamentals.add_sector_context(df), criteria.activity_score(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # a window is within one range, or over a table with a row for each group and range
        assert windows and all("run#" in w or "sum(held#" in w for w in windows)
        assert not re.findall(r"(median|percentile)\(", plan)


def controls_by_hand(rows, count):
    import numpy as np

    names = walkforward.MATCH_ON
    measure = lambda r: [np.log1p(max(r["market_cap"], 0.0)) if c == "market_cap" and r[c] is not None else r[c] for c in names]
    found = {}
    for day in {r["as_of"] for r in rows}:
        pool = [r for r in rows if r["as_of"] == day and not r["selected"]]
        scales = []
        for i in range(len(names)):
            v = [measure(r)[i] for r in pool if measure(r)[i] is not None]
            spread = np.subtract(*np.percentile(v, [75, 25])) if len(v) >= 4 else (max(v) - min(v) if v else 0)
            sd = np.std(v, ddof=1) if len(v) > 1 else 0
            scales.append(spread if spread > 0 else sd if sd > 0 else None)
        for t in (r for r in rows if r["as_of"] == day and r["selected"]):
            near = []
            for r in pool:
                gaps = [abs(a - b) / s for a, b, s in zip(measure(r), measure(t), scales, strict=True) if None not in (a, b, s)]
                if len(gaps) >= 2:
                    same = lambda c: t[c] is not None and t[c] == r[c]
                    near.append((1 if same("sector") else 2 if same("market") else 3, sum(gaps) / len(gaps), r["code"]))
            found[day, t["code"]] = [(c, k, pytest.approx(x)) for k, x, c in sorted(near)[:count]]
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 3)])
def test_controls_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(walkforward, "POOL_ROWS", blocks[0])
    monkeypatch.setattr(walkforward, "TARGET_ROWS", blocks[1])
    rng = random.Random(6)
    rows = []
    for day in ("2024-01-01", "2024-02-01"):
        for i in range(90):
            own = {c: rng.choice([None, rng.uniform(-2, 2), 1.0]) for c in walkforward.MATCH_ON}
            sector, market = rng.choice(["a", "a", "b", "rare", None]), rng.choice(["p", "q", None])
            rows.append({"as_of": day, "code": f"{i:03d}", "sector": sector, "market": market, "selected": rng.choice([True, False, False, None]), **own})
    schema = "as_of string, code string, sector string, market string, selected boolean, " + ", ".join(f"{c} double" for c in walkforward.MATCH_ON)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {}
    for r in sorted(walkforward.matched_controls(df, 4).collect(), key=lambda r: r.place):
        got.setdefault((r.as_of, r.target), []).append((r.code, r.tier, r.distance))
    assert got == controls_by_hand(rows, 4)
