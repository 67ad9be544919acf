"""What a user keeps between runs, in stores with atomic commits: feature snapshots, star outcomes, reviews, profiles, rules."""

from __future__ import annotations

import dataclasses
import json
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinode.operators.criteria import ScreenConfig, with_overrides
from hinode.operators.history import reconcile_outcomes, same_basis_only
from hinode.operators.learning import RULES, LearningState
from hinode.sources.versions import Store, Version

#: Fixed: the basis of outcomes that are kept, versions of documents, the scale of scores and what the old one lacks.
BASIS, SCHEMA, SCALE, ADDED, MOST = "trading_sessions_v1", "1.0", "quantitative_v2", 28.0, 85.0
#: Fixed: the states of a review and its measures, each from 0 to 1 and 0.5 if missing.
STATES = ("approved", "pending", "rejected")
MEASURES = ("external_factor_degree", "temporariness_probability", "catalyst_probability", "structural_risk")


# --- features -------------------------------------------------------------------------------------------------------


def write_features(store: Store, features: DataFrame, as_of: str) -> Version:
    """Publishes a screen's features as the current snapshot, with its date; the last two stay."""
    made = store.commit({"features": features}, {"as_of": as_of, "columns": features.columns})
    store.vacuum(keep=2)
    return made


def read_features(store: Store, as_of: str | None = None) -> DataFrame | None:
    """The current snapshot, or None; with as_of only if it is that day's."""
    version = store.version()
    if as_of is not None and version.notes.get("as_of") != as_of:
        return None
    return store.read("features", version)


# --- outcomes -------------------------------------------------------------------------------------------------------


def save_outcomes(store: Store, events: DataFrame) -> list[str]:
    """Keeps star outcomes by their day and returns the days that were written: those whose rows differ from what is kept."""
    return store.commit_days("star_outcomes", events, "star_date")


def load_outcomes(store: Store) -> DataFrame | None:
    return store.read_days("star_outcomes")


def refresh_outcomes(store: Store, rebuilt: DataFrame, horizons: tuple[int, ...], basis: str = BASIS) -> list[str]:
    """Rebuilt events with the kept returns of this basis where they are known; returns of another basis are dropped.

    Writes the days that this changes, and returns them.
    """
    rebuilt = rebuilt.withColumn("basis", F.lit(basis))
    kept = load_outcomes(store)
    if kept is not None:
        rebuilt = reconcile_outcomes(rebuilt, same_basis_only(kept, basis, horizons), horizons)
    return save_outcomes(store, rebuilt)


# --- reviews --------------------------------------------------------------------------------------------------------


def check_review(document: dict) -> dict:
    """The review, or a ValueError that says what is wrong with it."""
    if document.get("schema_version") != SCHEMA:
        raise ValueError("unknown version of a review")
    if document.get("approval_status", "pending") not in STATES:
        raise ValueError("unknown state of a review")
    assessment = document.get("assessment")
    if not isinstance(document.get("primary_source"), dict) or not isinstance(assessment, dict):
        raise ValueError("a review needs a source and an assessment")
    if not isinstance(document.get("structured_invalidation_conditions") or [], list):
        raise ValueError("conditions must be a list")
    for name in MEASURES:
        if not 0.0 <= float(assessment.get(name, 0.5)) <= 1.0:
            raise ValueError(f"{name} must lie between 0 and 1")
    return document


def review_code(code: object) -> str:
    """The first four digits of a code, all of them if there are fewer, `unknown` without any."""
    digits = "".join(c for c in str(code) if c.isdigit())
    return digits[:4] if len(digits) >= 4 else digits or "unknown"


def save_review(store: Store, document: dict, at: datetime | None = None) -> Version:
    """Keeps a review as the current one of its code."""
    when = (at or datetime.now(timezone.utc)).isoformat()
    kept = document | {"schema_version": SCHEMA, "code": review_code(document.get("code", "")), "updated_at": when}
    rows = [(kept["code"], when, json.dumps(check_review(kept), ensure_ascii=False))]
    return store.upsert("reviews", store.spark.createDataFrame(rows, "code string, updated_at string, document string"), ["code"], "updated_at")


def load_review(store: Store, code: str) -> dict | None:
    """The current review of a code, or None."""
    kept = store.read("reviews")
    found = kept.where(F.col("code") == review_code(code)).first() if kept is not None else None
    return check_review(json.loads(found["document"])) if found else None


# --- profiles -------------------------------------------------------------------------------------------------------


def save_profile(store: Store, name: str, preset: str, overrides: dict, at: datetime | None = None) -> Version:
    """Keeps the overrides of a screen under a name; names that the screen doesn't have are an error."""
    unknown = set(overrides) - {f.name for f in dataclasses.fields(ScreenConfig)}
    if unknown:
        raise ValueError(f"the screen has no {', '.join(sorted(unknown))}")
    rows = [(name, preset, (at or datetime.now(timezone.utc)).isoformat(), SCALE, json.dumps(overrides))]
    schema = "name string, preset string, saved_at string, score_scale string, overrides string"
    return store.upsert("profiles", store.spark.createDataFrame(rows, schema), ["name"], "saved_at")


def list_profiles(store: Store) -> list[str]:
    kept = store.read("profiles")
    return [] if kept is None else [r["name"] for r in kept.orderBy(F.lower("name"), "name").select("name").collect()]  # a user's own


def load_profile(store: Store, name: str, base: ScreenConfig = ScreenConfig()) -> ScreenConfig:
    """The screen with a profile's overrides. A threshold on the old scale of scores, which has no scale noted, is lifted."""
    kept = store.read("profiles")
    found = kept.where(F.col("name") == name).first() if kept is not None else None
    if found is None:
        raise KeyError(name)
    overrides = json.loads(found["overrides"])
    if found["score_scale"] is None and overrides.get("min_score") is not None:
        overrides["min_score"] = min(MOST, float(overrides["min_score"]) + ADDED)
    elif found["score_scale"] not in (None, SCALE):
        raise ValueError("unknown scale of scores")
    plain = {k: tuple(v) if isinstance(v, list) else v for k, v in overrides.items()}
    return with_overrides(base, **plain)


# --- learned rules --------------------------------------------------------------------------------------------------


def save_learning(store: Store, state: LearningState, at: datetime | None = None) -> Version:
    """Keeps the state of a run as the current one, and adds a row to the audit of overlays where the run applied a change."""
    when = (at or datetime.now(timezone.utc)).isoformat()
    text = json.dumps(dataclasses.asdict(state) | {"applied_on": state.applied_on and state.applied_on.isoformat()})
    base, spark = store.version(), store.spark
    tables = {"learning": spark.createDataFrame([(when, text)], "at string, state string")}
    if state.status in ("auto_applied", "cleared"):
        row = spark.createDataFrame([(when, state.status, json.dumps(state.overlay), json.dumps(state.best))], "at string, action string, overlay string, change string")
        audit = store.read("audit", base)
        tables["audit"] = row if audit is None else audit.unionByName(row)
    return store.commit(tables, {"status": state.status}, base)


def load_learning(store: Store) -> LearningState:
    """The current state; its overlay holds learnable keys only."""
    kept = store.read("learning")
    if kept is None:
        return LearningState("none")
    state = json.loads(kept.first()["state"])
    known = {r.key for r in RULES}
    overlay = {k: v for k, v in (state["overlay"] or {}).items() if k in known}
    on = date.fromisoformat(state["applied_on"]) if state["applied_on"] else None
    return LearningState(**state | {"overlay": overlay, "applied_on": on})


def clear_overlay(store: Store) -> Version:
    """Drops all learned thresholds, and says so in the audit."""
    return save_learning(store, dataclasses.replace(load_learning(store), status="cleared", overlay={}))
