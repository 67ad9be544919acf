"""Financial features from filings, strongest events, valuation and sector context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import cagr, ratio
from hinode.operators.ranking import group_quantiles, same_group, unpivot
from hinode.sources.store import stored


def financial_features(filings: DataFrame, as_of: DataFrame) -> DataFrame:
    """One row per (as_of, code): the last three fiscal years, the newest filing, guidance and dividends known by then.

    as_of holds dates for all securities, or with a column code a date for each. Filings are stored once, as all parts read
    them, and dealt by code before they meet the dates: no date makes a filing travel again.
    """
    spark = filings.sparkSession
    nth = F.dense_rank().over(Window.partitionBy("code").orderBy("disclosure_date", "statement_type"))
    filings = stored(filings.withColumn("_filing", nth), "filings")
    filings = filings.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "code")
    if "code" in as_of.columns:
        known = filings.join(as_of.select("code", "as_of"), "code").where(F.col("disclosure_date") <= F.col("as_of"))
    else:
        known = filings.join(F.broadcast(as_of), F.col("disclosure_date") <= F.col("as_of"))  # replay dates: a dozen rows
    key = ["as_of", "code"]
    order = F.col("_filing")

    newest_of_year = Window.partitionBy(*key, "fiscal_year").orderBy(F.desc("disclosure_date"), F.desc("statement_type"))
    by_year = Window.partitionBy(*key).orderBy(F.desc("fiscal_year"))
    annual = known.where("is_full_year_actual AND fiscal_year IS NOT NULL").withColumn("n", F.row_number().over(newest_of_year)).where("n = 1").withColumn("back", F.row_number().over(by_year)).where("back <= 3")
    margin = ratio(F.col("operating_profit"), F.col("sales"))
    positive = F.when(F.col("operating_cf") > 0, 1.0).otherwise(0.0)
    year = F.col("fiscal_year")
    latest = lambda c: F.max_by(c, year)
    annual = annual.groupBy(*key).agg(
        F.count("*").alias("financial_history_years"), F.min_by("sales", year).alias("first_sales"), latest("sales").alias("sales_latest"), latest("operating_profit").alias("operating_profit_latest"),
        latest("operating_cf").alias("operating_cf_latest"), latest("eps").alias("eps"),
        F.max_by(margin, F.when(margin.isNotNull(), year)).alias("last_margin"), F.min_by(margin, F.when(margin.isNotNull(), year)).alias("first_margin"), F.count(margin).alias("margins"),
        F.count("operating_cf").alias("operating_cf_observed_years"), F.avg(positive).alias("cf_share"),
    )
    annual = annual.select(
        *key, "financial_history_years", "sales_latest", "operating_profit_latest", "eps", "operating_cf_observed_years",
        cagr(F.col("first_sales"), F.col("sales_latest"), F.col("financial_history_years") - 1).alias("sales_cagr_3y"),
        ratio(F.col("operating_profit_latest"), F.col("sales_latest")).alias("operating_margin"),
        F.when(F.col("margins") >= 2, F.col("last_margin") - F.col("first_margin")).alias("operating_margin_change_3y"),
        F.when(F.col("operating_cf_observed_years") > 0, F.col("cf_share")).alias("operating_cf_positive_ratio_3y"),
        ratio(F.col("operating_cf_latest"), F.col("operating_profit_latest")).alias("cash_conversion_ratio"),
    )

    held = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))  # noqa: E731  the last that is not null
    dividends = ("actual_annual_dividend_per_share", "forecast_annual_dividend_per_share", "next_forecast_annual_dividend_per_share", "actual_payout_ratio")
    newest = known.groupBy(*key).agg(
        F.max("disclosure_date").alias("financial_disclosure_date"),
        *[F.max_by(c, order).alias(c) for c in ("total_assets", "equity", "cash", "interest_bearing_debt", "book_value_per_share")],
        *[held(c).alias(f"last_{c}") for c in dividends],
    )
    actual, current, following = (F.col(f"last_{c}") for c in dividends[:3])
    dividend = F.coalesce(following, current, actual)
    newest = newest.select(
        *key, "financial_disclosure_date", "book_value_per_share",
        ratio(F.col("equity"), F.col("total_assets")).alias("equity_ratio"),
        (F.col("cash") - F.col("interest_bearing_debt")).alias("net_cash"),
        dividend.alias("forecast_annual_dividend_per_share"),
        F.when(following.isNotNull(), "next guidance").when(current.isNotNull(), "guidance").when(actual.isNotNull(), "actual").otherwise("none").alias("dividend_forecast_source"),
        F.when(following.isNull() & current.isNull(), F.col("last_actual_payout_ratio")).alias("payout_ratio"),
        ratio(dividend, actual).alias("dividend_ratio"),
    )
    newest = newest.withColumn("forecast_dividend_change_rate", F.col("dividend_ratio") - 1.0).drop("dividend_ratio")
    return annual.join(newest, key).join(forecast_revisions(known), key, "left").withColumn("forecast_op_growth", ratio(F.col("forecast_operating_profit"), F.col("operating_profit_latest")) - 1.0)


def forecast_revisions(known: DataFrame) -> DataFrame:
    """The newest operating-profit guidance and the last different one for the same target year.

    known: filings known by each as_of; _filing, if there, is their order within a code, else date and type of the filing.
    """
    key = ["as_of", "code"]
    w = Window.partitionBy(*key)
    order = F.col("_filing") if "_filing" in known.columns else F.struct("disclosure_date", "statement_type")
    target = F.col("fiscal_year") + F.when(F.upper("statement_type") == "FY", 1).otherwise(0)
    rows = known.where("forecast_operating_profit IS NOT NULL").select(*key, order.alias("ord"), target.alias("target"), F.col("forecast_operating_profit").alias("value"))
    rows = rows.withColumn("newest", F.max("ord").over(w)).withColumn("now", F.max_by("value", "ord").over(w)).withColumn("now_target", F.max_by("target", "ord").over(w))
    prior = (F.col("ord") < F.col("newest")) & (F.col("target").eqNullSafe(F.col("now_target")) | F.col("now_target").isNull())
    found = rows.groupBy(*key).agg(
        F.max("now").alias("forecast_operating_profit"), F.max("now_target").alias("forecast_revision_target_year"),
        F.max_by("value", F.when(prior & (F.col("value") != F.col("now")), F.col("ord"))).alias("different"),
        F.max_by("value", F.when(prior, F.col("ord"))).alias("before"),
    )
    start = F.coalesce("different", "before")
    return found.select(*key, "forecast_operating_profit", "forecast_revision_target_year", start.alias("forecast_revision_from"), (ratio(F.col("forecast_operating_profit"), start) - 1.0).alias("forecast_revision_rate"))


def strongest_events(events: DataFrame, as_of: DataFrame, max_age_days: int = 365) -> DataFrame:
    """The strongest event of each security of at most that age, the newest of equals."""
    age = F.datediff(F.col("as_of"), F.col("event_date"))
    known = events.join(F.broadcast(as_of), F.col("event_date") <= F.col("as_of")).withColumn("event_age_days", age).where(F.col("event_age_days") <= max_age_days)
    known = known.withColumn("event_strength", F.col("externality") * F.col("temporary_probability") * (0.6 + 0.4 * F.col("catalyst_probability")))
    w = Window.partitionBy("as_of", "code").orderBy(F.desc("event_strength"), F.desc("event_date"), "event_no")
    return known.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def add_valuation(rows: DataFrame) -> DataFrame:
    """Market value, PER and PBR."""
    return rows.withColumns(
        {
            "market_cap": F.col("close") * F.col("shares_outstanding"),
            "per": ratio(F.col("close"), F.col("eps")),
            "pbr": ratio(F.col("close"), F.col("book_value_per_share")),
        }
    )


SECTOR_PEERS = 5
#: Measures that are set against the median of the sector.
SECTOR_MEASURES = ("return_6m", "per", "pbr")


def add_sector_context(rows: DataFrame) -> DataFrame:
    """Peers of the sector with a 6-month return and their median, and PER and PBR against the sector's medians.

    The relative return needs enough peers. The medians of a date's sectors come from distributed counts of values; rows
    with them are a few for each date and sector.
    """
    rows = stored(rows, "features")
    medians = group_quantiles(unpivot(rows, ["as_of", "sector"], SECTOR_MEASURES), ["as_of", "sector", "measure"], "value", (0.5,))
    of = lambda name, column: F.max(F.when(F.col("measure") == name, F.col(column)))
    context = medians.groupBy("as_of", "sector").agg(
        of("return_6m", "total").alias("sector_peer_count_6m"),
        of("return_6m", "q_0").alias("sector_return_6m_median"),
        of("per", "q_0").alias("sector_per_median"),
        of("pbr", "q_0").alias("sector_pbr_median"),
    )
    joined = same_group(rows, context, ["as_of", "sector"], "left")
    joined = joined.withColumn("sector_peer_count_6m", F.coalesce("sector_peer_count_6m", F.lit(0)))
    enough = F.col("sector_peer_count_6m") >= SECTOR_PEERS
    against = {f"{n}_vs_sector": F.col(n) / F.nullif(F.col(f"sector_{n}_median"), F.lit(0.0)) for n in ("per", "pbr")}
    relative = F.when(enough, F.col("return_6m") - F.col("sector_return_6m_median"))
    return joined.withColumns({**against, "sector_relative_return_6m": relative})
