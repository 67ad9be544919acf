"""What is kept between runs: snapshots, outcomes, reviews, profiles and learned rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hinode.operators import scoring
from hinode.operators.criteria import ScreenConfig
from hinode.operators.learning import LearningState
from hinode.sources import readers, records
from hinode.sources.versions import Store

DAY = dt.date(2024, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/kept")


def test_feature_snapshots(spark, store):
    assert records.read_features(store) is None
    for n in range(4):
        records.write_features(store, spark.range(n + 1), f"2024-01-0{n + 1}")
    assert records.read_features(store).count() == 4 and records.read_features(store, "2024-01-04").count() == 4
    assert records.read_features(store, "2024-01-03") is None
    assert store.read("features", store.version(3)).count() == 3
    with pytest.raises(KeyError):
        store.version(1)


EVENTS = "code string, star_date date, return_10d double, actual_days_10d int"


def test_outcomes_are_rewritten_only_where_they_change(spark, store):
    made = lambda *rows: spark.createDataFrame(list(rows), EVENTS)
    two = DAY + dt.timedelta(days=1)
    assert records.refresh_outcomes(store, made(("1", DAY, 0.1, 14), ("2", two, None, None)), (10,)) == ["2024-01-01", "2024-01-02"]
    # the rebuilt history no longer reaches back: what was known stays, so nothing changes
    assert records.refresh_outcomes(store, made(("1", DAY, None, 14), ("2", two, None, None)), (10,)) == []
    assert records.refresh_outcomes(store, made(("1", DAY, 0.5, 14), ("2", two, 0.2, 15)), (10,)) == ["2024-01-02"]
    got = {r.code: (r.return_10d, r.basis) for r in records.load_outcomes(store).collect()}
    assert got == {"1": (0.1, records.BASIS), "2": (0.2, records.BASIS)}
    # returns of another basis are dropped, not kept
    assert records.refresh_outcomes(store, made(("1", DAY, None, 14)), (10,), basis="calendar days") == ["2024-01-01"]
    assert {r.return_10d for r in records.load_outcomes(store).where("code = '1'").collect()} == {None}


REVIEW = {
    "schema_version": "1.0", "code": "72030", "name": "n", "approval_status": "approved", "primary_source": {"document_id": "d"},
    "assessment": {"external_factor_degree": 0.6, "temporariness_probability": 1.0, "catalyst_probability": 0.0},
    "structured_invalidation_conditions": [{"metric": "operating_margin", "operator": "<", "threshold": 8.0, "unit": "%", "enabled": True, "note": ""}],
}


def test_reviews(spark, store, tmp_path):
    assert records.load_review(store, "7203") is None
    records.save_review(store, REVIEW)
    records.save_review(store, REVIEW | {"code": "1111", "approval_status": "pending"})
    records.save_review(store, REVIEW | {"name": "later"})
    assert records.load_review(store, "72030")["name"] == "later" and records.load_review(store, "1111")["approval_status"] == "pending"
    assert store.read("reviews").count() == 2
    wrong = [{"approval_status": "draft"}, {"assessment": {"structural_risk": 1.5}}, {"primary_source": None}, {"structured_invalidation_conditions": {}}]
    for change in wrong[:3]:
        with pytest.raises(ValueError):
            records.save_review(store, REVIEW | change)
    assert store.read("reviews").count() == 2
    documents = [REVIEW, *[REVIEW | c for c in wrong[:3]], REVIEW | {"schema_version": "0.9"}, REVIEW | {"approval_status": "pending"}]
    for n, document in enumerate(documents):
        (tmp_path / f"{n}.json").write_text(json.dumps(document | {"name": str(n)}))
    rows = readers.read_reviews(spark, f"{tmp_path}/*.json").select("code", "valid", F.input_file_name().alias("f")).collect()
    assert {r.f[-6] for r in rows if r.valid} == {"0", "5"} and len(rows) == 6
    assert [records.review_code(c) for c in ("72030", "x12", "", None, "  7203-T")] == ["7203", "12", "unknown", "unknown", "7203"]


def test_profiles(spark, store):
    assert records.list_profiles(store) == []
    records.save_profile(store, "strict", "strict", {"min_score": 80.0, "markets": ["Prime"]})
    records.save_profile(store, "B", "balanced", {})
    records.save_profile(store, "strict", "strict", {"min_score": 81.0})
    assert records.list_profiles(store) == ["B", "strict"]
    assert records.load_profile(store, "strict").min_score == 81.0 and records.load_profile(store, "B") == ScreenConfig()
    old = store.spark.createDataFrame([("old", "balanced", "9", None, '{"min_score": 40, "markets": ["Prime"]}'), ("odd", "x", "9", "v9", "{}")], "name string, preset string, saved_at string, score_scale string, overrides string")
    store.upsert("profiles", old, ["name"], "saved_at")
    lifted = records.load_profile(store, "old")
    assert lifted.min_score == 68.0 and lifted.markets == ("Prime",)
    with pytest.raises(ValueError):
        records.load_profile(store, "odd")
    with pytest.raises(ValueError):
        records.save_profile(store, "x", "y", {"no_such": 1})
    with pytest.raises(KeyError):
        records.load_profile(store, "none")


def test_learned_rules(spark, store):
    assert records.load_learning(store).status == "none"
    state = LearningState("auto_applied", 120, 130, {"rule": "minimum_drawdown_52w", "candidate": -0.24}, {"minimum_drawdown_52w": -0.24, "minimum_externality": 0.9}, DAY)
    records.save_learning(store, state)
    records.save_learning(store, LearningState("cooldown", overlay={"minimum_drawdown_52w": -0.24}, applied_on=DAY))
    got = records.load_learning(store)
    assert (got.status, got.overlay, got.applied_on) == ("cooldown", {"minimum_drawdown_52w": -0.24}, DAY)
    records.clear_overlay(store)
    assert records.load_learning(store).overlay == {}
    assert [r.action for r in store.read("audit").orderBy("at").collect()] == ["auto_applied", "cleared"]


def test_a_missing_source_costs_points_only_where_it_is_blank(spark):
    names = ["operating_profit_latest", "forecast_op_growth", "equity_ratio", "sales_cagr_3y", "operating_margin", "operating_cf_positive_ratio_3y", "per", "pbr", "per_vs_sector", "pbr_vs_sector", "drawdown_52w", "relative_return_6m"]
    row = {n: 1.0 for n in names}
    schema = ", ".join(f"{n} double" for n in names) + ", review_status string, source_url string"
    df = spark.createDataFrame([(*row.values(), "approved", u) for u in (None, "", " ", "http://x")], schema)
    got = [r.review_penalty for r in scoring.add_scores(df).collect()]
    assert got == [0.0, 8.0, 8.0, 0.0]
    assert {r.review_penalty for r in scoring.add_scores(df.drop("source_url")).collect()} == {8.0}
