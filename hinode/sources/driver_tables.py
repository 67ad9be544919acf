"""The driver's star schema as securities: suppliers are companies, their daily line items are bars.

Every value is a deterministic expression of the table's columns, so an SQL engine can restate it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, close, high, low, volume, turnover: one bar per supplier and ship date.

    Line items are dealt by code once: a day of a supplier has hardly more than one, so adding them up before would save
    nothing, and what orders a security's bars afterwards finds them dealt.
    """
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("code"), F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        items.repartition("code")
        .groupBy("code", "date")
        .agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).cast("double").alias("close"),
            F.max(unit).cast("double").alias("high"),
            F.min(unit).cast("double").alias("low"),
            F.sum("l_quantity").cast("double").alias("volume"),
            F.sum("l_extendedprice").cast("double").alias("turnover"),
        )
    )


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, index_close: the whole market's average price of a day."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).cast("double").alias("index_close"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, sector, market, shares_outstanding."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    market = F.when(F.col("n_nationkey") % 3 == 0, "Prime").when(F.col("n_nationkey") % 3 == 1, "Standard").otherwise("Growth")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), market.alias("market"), (F.abs(F.col("s_acctbal").cast("double")) * 100.0 + 1000.0).alias("shares_outstanding"))


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings: an annual one per supplier and year, and a half-year one with revised guidance only."""
    year = F.year(F.col("l_shipdate").cast("date")).alias("fiscal_year")
    sales = F.sum(F.col("l_extendedprice").cast("double") * (1.0 - F.col("l_discount").cast("double"))).alias("sales")
    years = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("bigint").alias("k"), year).agg(sales)
    k, fy, s = F.col("k"), F.col("fiscal_year"), F.col("sales")
    op = s * (((k * 7 + fy * 5) % 23) - 4).cast("double") / 100.0
    annual = years.select(
        k.cast("string").alias("code"),
        F.make_date(fy + 1, F.lit(5), (1 + k % 20).cast("int")).alias("disclosure_date"),
        F.lit("FY").alias("statement_type"),
        fy.cast("int").alias("fiscal_year"),
        F.lit(True).alias("is_full_year_actual"),
        s.alias("sales"),
        op.alias("operating_profit"),
        F.when((k + fy) % 9 != 0, op * (0.4 + ((k + fy) % 7).cast("double") / 10.0) - F.when((k * fy) % 5 == 0, s * 0.03).otherwise(0.0)).alias("operating_cf"),
        (s * 1.5).alias("total_assets"),
        (s * 1.5 * (0.15 + (k % 9).cast("double") * 0.06)).alias("equity"),
        (s * 0.2).alias("cash"),
        F.when(k % 5 != 0, s * 0.1).alias("interest_bearing_debt"),
        (op * 0.6 / 1000.0).alias("eps"),
        (s * 1.5 * (0.15 + (k % 9).cast("double") * 0.06) / 1000.0).alias("book_value_per_share"),
        F.when(k % 11 != 0, op * (0.7 + ((k * 3 + fy) % 6).cast("double") / 10.0)).alias("forecast_operating_profit"),
        F.when(op > 0, op * 0.6 / 1000.0 * 0.3).alias("actual_annual_dividend_per_share"),
        F.when(k % 4 == 0, F.when(op > 0, op * 0.6 / 1000.0 * 0.33)).alias("forecast_annual_dividend_per_share"),
        F.when(k % 6 == 1, F.when(op > 0, op * 0.6 / 1000.0 * 0.25)).alias("next_forecast_annual_dividend_per_share"),
        F.when(op > 0, F.lit(0.3)).alias("actual_payout_ratio"),
    )
    half = years.where((k + fy) % 3 == 0).select(
        k.cast("string").alias("code"),
        F.make_date(fy + 1, F.lit(11), (1 + k % 20).cast("int")).alias("disclosure_date"),
        F.lit("2Q").alias("statement_type"),
        (fy + 1).cast("int").alias("fiscal_year"),
        F.lit(False).alias("is_full_year_actual"),
        (s * 1.5).alias("total_assets"),
        (s * 1.5 * (0.14 + (k % 9).cast("double") * 0.06)).alias("equity"),
        F.when(k % 11 != 0, op * (0.6 + ((k * 5 + fy) % 6).cast("double") / 10.0)).alias("forecast_operating_profit"),
    )
    return annual.unionByName(half, allowMissingColumns=True)


def external_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed events of securities from the event stream."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").cast("bigint").alias("n")).scalar()
    e = table(spark, sf_dir, "events").withColumn("n", suppliers)
    part = lambda m, add: ((F.col("event_id").cast("bigint") * m + add) % 101).cast("double") / 100.0
    return e.select(
        (F.col("user_id").cast("bigint") % F.col("n") + 1).cast("string").alias("code"),
        F.col("ts").cast("date").alias("event_date"),
        F.col("event_type").alias("category"),
        part(7, 3).alias("externality"),
        part(13, 11).alias("temporary_probability"),
        part(29, 5).alias("catalyst_probability"),
        F.col("event_id").cast("bigint").alias("event_no"),
        F.when(F.col("event_id").cast("bigint") % 3 == 0, "approved").otherwise("pending").alias("review_status"),
    )
