"""Views, imports, snapshots and replays on small tables, and the entry without the optional subpackage."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinode.operators import history, review, search, walkforward
from hinode.queries import QUERIES
from hinode.sources import readers

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_broker_exports_in_both_encodings(spark, tmp_path):
    text = "銘柄コード,銘柄名,PER (予想),現在値\n7203,トヨタ,10.5,2000\n7203,again,1,1\n12,short,,\n67580,ソニー,-,x\n"
    (tmp_path / "a.csv").write_bytes(text.encode("cp932"))
    (tmp_path / "b.csv").write_bytes(text.replace("7203", "9984").replace("67580", "1301").encode("utf-8-sig"))
    rows = {r.code: r for r in readers.read_broker_csv(spark, f"{tmp_path}/*.csv").collect()}
    assert set(rows) == {"72030", "67580", "99840", "13010"} and rows["67580"].price is None and rows["67580"].name == "ソニー"
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(Exception, match="no column of codes"):
        readers.read_broker_csv(spark, f"{tmp_path}/c.csv").collect()


def test_snapshots_that_say_the_same_are_not_written(spark, tmp_path):
    root = str(tmp_path / "analysis")
    one = spark.createDataFrame([("1", 1.0), ("2", None)], "code string, score double")
    two = spark.createDataFrame([("2", None), ("1", 1.0)], "code string, score double")
    assert readers.write_snapshot(one, root, "2024-01-01", "2024-01-01")
    assert not readers.write_snapshot(two, root, "2024-01-02", "2024-01-01")
    assert readers.write_snapshot(two, root, "2024-01-03", "2024-01-03")
    assert readers.write_snapshot(two.limit(1), root, "2024-01-01", "2024-01-01")  # the same day is replaced
    got = readers.read_days(spark, root, "analysis_date").groupBy("analysis_date").count().collect()
    assert sorted((r.analysis_date, r["count"]) for r in got) == [(day(0), 1), (day(2), 2)]


def test_quotes_compare_calendar_days(spark):
    rows = [("1", dt.datetime(2024, 1, 4, 9), 100.0), ("1", dt.datetime(2024, 1, 5, 9), 108.0), ("1", dt.datetime(2024, 1, 5, 15), 110.0), ("1", dt.datetime(2024, 1, 6), None), ("2", dt.datetime(2024, 1, 5), 7.0)]
    got = {r.code: r for r in review.latest_quotes(spark.createDataFrame(rows, "code string, date timestamp, close double")).collect()}
    assert (got["1"].price, got["1"].previous_close, got["1"].change_pct) == (110.0, 100.0, pytest.approx(0.1))
    assert (got["2"].price, got["2"].previous_close, got["2"].change) == (7.0, None, None)


def test_texts_of_thresholds_and_names(spark):
    rows = spark.createDataFrame([(0.1,), (-2.5,), (30.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(review.threshold_text(F.col("x"))).collect()] == ["0.1", "-2.5", "30", "0", ""]
    shown = spark.createDataFrame([(0.12345, "percent"), (1234567.0, "yen"), (1234.5, "ratio")], "v double, k string").select(review.value_text(F.col("v"), F.col("k"))).collect()
    assert [r[0] for r in shown] == ["12.35%", "¥1,234,567", "1,234.50"]
    names = spark.createDataFrame([(" my list! ",), ("割安株 2024",), ("***",)], "n string").select(review.profile_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["my_list", "割安株_2024", "my_conditions"]


def test_rule_rows_and_sort_keys(spark):
    rows = spark.createDataFrame([(True, ["a", "b"], "10"), (False, ["a"], "9"), (False, ["a", "b"], None), (False, [], "x")], "selected boolean, fail_reasons array<string>, v string")
    assert [r[0] for r in rows.select(review.eligible_for_rule(rows, "a")).collect()] == [True, True, False, False]
    assert [r.v for r in rows.where("v IS NULL OR v <> 'x'").orderBy(*review.sort_order(rows.where("v <> 'x'"), "v")).collect()] == ["9", "10", None]
    assert [r.v for r in rows.orderBy(*review.sort_order(rows, "v", False)).collect()] == ["x", "9", "10", None]


def test_controls_are_the_nearest_of_each_tier(spark):
    rng = np.random.default_rng(3)
    rows = [(day(0), str(k), f"s{k % 5}", f"m{k % 2}", k % 7 == 0, *(None if rng.random() < 0.2 else float(x) for x in rng.random(5))) for k in range(60)]
    table = spark.createDataFrame(rows, "as_of date, code string, sector string, market string, selected boolean, market_cap double, drawdown_52w double, volatility_60d double, per_vs_sector double, pbr_vs_sector double")
    got = {}
    for r in walkforward.matched_controls(table, 5).collect():
        got.setdefault(r.target, []).append((r.place, r.tier, r.code))
    pool = [r for r in rows if not r[4]]
    values = lambda r: [None if r[5] is None else float(np.log1p(max(r[5], 0))), *r[6:]]
    spread = []
    for i in range(5):
        x = np.array([values(r)[i] for r in pool if values(r)[i] is not None])
        spread.append(np.quantile(x, 0.75) - np.quantile(x, 0.25))
    for t in (r for r in rows if r[4]):
        ranked = []
        for p in pool:
            gaps = [abs(a - b) / s for a, b, s in zip(values(p), values(t), spread, strict=True) if a is not None and b is not None]
            if len(gaps) >= 2:
                ranked.append((1 if p[2] == t[2] else 2 if p[3] == t[3] else 3, sum(gaps) / len(gaps), p[1]))
        expected = [(k + 1, tier, code) for k, (tier, _, code) in enumerate(sorted(ranked)[:5])]
        assert sorted(got.get(t[1], [])) == expected


def test_bootstrap_interval_is_about_the_usual_one(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(0.02, 0.1, 300)
    rows = spark.createDataFrame([(day(0), str(k), f"{k}:1", float(v)) for k, v in enumerate(values)], "as_of date, code string, episode_id string, selection_edge_10d double").repartition(5)
    r = walkforward.bootstrap_edges(rows, (10,)).first()
    means = values[rng.integers(0, 300, (4000, 300))].mean(axis=1)
    assert (r.horizon, r.n) == (10, 300) and r.low == pytest.approx(np.quantile(means, 0.025), abs=2e-3) and r.high == pytest.approx(np.quantile(means, 0.975), abs=2e-3)
    again = walkforward.bootstrap_edges(rows.repartition(2), (10,)).first()
    assert again.low == pytest.approx(r.low)


def test_matured_episodes_part_where_a_return_is_missing(spark):
    rows = [("v", "1", 1, 0.1, 0.1), ("v", "1", 2, None, 0.1), ("v", "1", 3, 0.2, 0.3), ("v", "1", 4, -0.1, 0.5), ("v", "2", 4, -0.2, 0.1)]
    df = spark.createDataFrame(rows, "variant string, code string, snapshot_no int, return_10d double, selection_edge_10d double")
    r = walkforward.matured_summary(df, (10,), ["variant"]).first()
    assert (r.matured, r.episodes, r.edge, r.positive_share) == (4, 3, pytest.approx(0.5 / 3), pytest.approx(2 / 3))


def test_summaries_of_nothing_and_of_some(spark):
    rows = spark.createDataFrame([("1", day(0), "◎", "same_day", None), ("1", day(1), "◎", "same_day", None), ("2", day(1), "", "unassessed", "quote failed")], "code string, evaluation_date date, intuitive_symbol string, status string, reason string")
    r = history.evaluation_summary(rows).first()
    assert tuple(r) == ("3 records of 2 securities, 2024-01-01 to 2024-01-02", "most often ◎, 2 times (66.7%)", "2 high, 0 to watch, 0 to avoid", "1 unassessed (33.3%), mostly quote failed")
    assert history.evaluation_summary(rows.limit(0)).first().extent == "no records"


def test_search_compares_only_what_may_be_similar(spark):
    rows = spark.createDataFrame([("1", "Alpha Motors"), ("2", "Alfa Motor"), ("3", "Zzz")], "code string, name string")
    whole = {r.code: r for r in search.search_companies(rows, "alpha motor").collect()}
    assert set(whole) == {"1", "2"} and whole["1"].match_type == "name prefix" and whole["2"].match_type == "similar"


def test_entry_without_the_optional_subpackage():
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('hinode.llm') or name == 'corpus_pipeline':\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "assert e.queries()['latest_quotes'](s, '/root/testdata/sf0.001').count() > 0\n"
    )
    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("no driver tables here")
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]


def test_evaluation_summary_reads_its_rows_once(spark, tmp_path):
    rows = [("1", "2024-01-01", "◎☆", "same_day", None), ("2", "2024-01-02", " ", "unassessed", "late"), ("1", "2024-01-02", "×", "unassessed", ""), ("3", "2024-01-03", "×", "backfilled", None)]
    spark.createDataFrame(rows, "code string, evaluation_date string, intuitive_symbol string, status string, reason string").write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    said = history.evaluation_summary(read)
    assert "intuitive_symbol" not in said._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(said.first()) == ("4 records of 3 securities, 2024-01-01 to 2024-01-03", "most often ×, 2 times (50.0%)", "1 high, 0 to watch, 2 to avoid", "2 unassessed (50.0%), mostly late")
    assert tuple(history.evaluation_summary(read.limit(0)).first())[0] == "no records"


def test_benchmark_modes_compute_their_features_once(spark):
    df = QUERIES["benchmark_modes"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
