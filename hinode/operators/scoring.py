"""Scores and attribution as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinode.functions.scalars import clip, joined_reasons, passes, scale

#: Fixed parts of the scores: column, low, high, points, inverse.
QUALITY = (("sales_cagr_3y", -0.05, 0.10, 8, False), ("operating_margin", 0.0, 0.15, 8, False), ("operating_cf_positive_ratio_3y", 0.34, 1.0, 8, False), ("equity_ratio", 0.20, 0.60, 8, False), ("forecast_op_growth", -0.15, 0.20, 8, False))
VALUATION = (("per", 6.0, 18.0, 5, True), ("pbr", 0.6, 1.8, 5, True), ("per_vs_sector", 0.55, 1.10, 5, True), ("pbr_vs_sector", 0.55, 1.10, 5, True))
EXTERNAL = (("externality", 0.40, 1.0, 5, False), ("temporary_probability", 0.40, 1.0, 5, False), ("catalyst_probability", 0.20, 1.0, 5, False))

MODES = ("legacy_depth", "external_explained")
METHODS = ("v2_sector_absolute", "v1_legacy")


def _sum(parts: tuple) -> Column:
    total = F.lit(0.0)
    for name, low, high, points, inverse in parts:
        total = total + scale(F.col(name), low, high, points, inverse)
    return total


def add_scores(rows: DataFrame, mode: Column | str = "legacy_depth", missing: str = "half") -> DataFrame:
    """Quality, valuation, dislocation, external and penalty parts, the quantitative score (0-85) and the total (0-100).

    mode: a name or a column of names, so that both modes can be a dimension of one plan. Columns of events may be absent.
    A blank source costs points, and so does a table without sources; a null, where no event was joined, doesn't.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    for name, kind in (("externality", "double"), ("temporary_probability", "double"), ("catalyst_probability", "double"), ("review_status", "string"), ("external_shock_attribution_v2", "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if "source_url" not in rows.columns:
        rows = rows.withColumn("source_url", F.lit(""))
    weight = F.when(mode == "external_explained", clip(F.coalesce("external_shock_attribution_v2", F.lit(0.5 if missing == "half" else 0.0)), 0.0, 1.0)).otherwise(1.0)
    fall = lambda c: -F.coalesce(c, F.lit(0.0)) * weight
    rows = (
        rows.withColumn("quality_score", _sum(QUALITY))
        .withColumn("valuation_score", _sum(VALUATION))
        .withColumn("dislocation_score", scale(fall("drawdown_52w"), 0.15, 0.45, 14) + scale(fall("relative_return_6m"), 0.05, 0.30, 11))
        .withColumn("external_event_score", _sum(EXTERNAL))
    )
    flags = (
        ("operating loss", F.col("operating_profit_latest") <= 0, 18.0),
        ("guidance down by a fifth", F.col("forecast_op_growth") < -0.20, 10.0),
        ("equity under a fifth", F.col("equity_ratio") < 0.20, 10.0),
    )
    review = (("event not approved", ~F.col("review_status").eqNullSafe("approved"), 20.0), ("no source", passes(F.trim("source_url") == ""), 8.0))
    points = lambda some: sum((F.when(c, p).otherwise(0.0) for _, c, p in some), F.lit(0.0))
    core = F.col("quality_score") + F.col("valuation_score") + F.col("dislocation_score")
    return (
        rows.withColumn("financial_penalty", points(flags))
        .withColumn("review_penalty", points(review))
        .withColumn("quantitative_score", clip(core - F.col("financial_penalty"), 0.0, 85.0))
        .withColumn("score", clip(core + F.col("external_event_score") - F.col("financial_penalty") - F.col("review_penalty"), 0.0, 100.0))
        .withColumn("red_flags", joined_reasons([(k, c) for k, c, _ in (*flags, *review)]))
    )


def add_attribution(rows: DataFrame, method: Column | str = "v2_sector_absolute", name: str = "external_shock_attribution") -> DataFrame:
    """Share of a security's 6-month fall that its sector (v2) or market and sector (v1) explain; reason when unknown."""
    method = F.lit(method) if isinstance(method, str) else method
    stock, sector, index = F.col("return_6m"), F.col("sector_return_6m_median"), F.col("index_return_6m")
    falling = F.coalesce(stock < 0, F.lit(False))
    peers = F.coalesce((F.col("sector_peer_count_6m") >= 5) & sector.isNotNull(), F.lit(False))
    v1 = method == "v1_legacy"
    valid = falling & peers & (~v1 | index.isNotNull())
    zero = F.lit(0.0)
    explained = F.when(v1, F.greatest(-index, zero) + F.greatest(-(sector - index), zero)).otherwise(F.greatest(-sector, zero))
    share = F.when(valid, clip(F.least(explained, -stock) / -stock, 0.0, 1.0))
    reason = F.when(valid, "").when(stock >= 0, "no fall").when(stock.isNull(), "no comparison").when(~peers, "too few peers").otherwise("no comparison")
    return rows.withColumn(name, share).withColumn(f"{name}_reason", reason)
