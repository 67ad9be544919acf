"""Reviews, quotes and what a page shows: freshness, order gate, texts of thresholds, warnings, peers and recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import passes
from hinode.operators.asof import keep_last

#: Fixed fields of a review that may stay open; they are named, and are no gate.
OPTIONAL_FIELDS = ("reviewer", "decline_factor", "document_id", "summary", "recovery_catalyst", "invalidation_conditions")


def latest_quotes(bars: DataFrame) -> DataFrame:
    """price, previous_close (the last of an earlier day), change and change_pct of each code; bars may be intraday."""
    days = keep_last(bars.where("close IS NOT NULL").withColumn("day", F.to_date("date")), ["code", "day"], [F.desc("date")])
    w = Window.partitionBy("code").orderBy(F.desc("day"))
    two = days.withColumn("n", F.row_number().over(w)).where("n <= 2")
    pick = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    rows = two.groupBy("code").agg(pick(1, "day").alias("market_date"), pick(1, "close").alias("price"), pick(2, "close").alias("previous_close"))
    change = F.col("price") - F.col("previous_close")
    return rows.withColumn("change", change).withColumn("change_pct", F.when(F.col("previous_close") != 0, change / F.col("previous_close")))


def freshness(bars: DataFrame, today: Column, max_age_days: int = 7) -> DataFrame:
    """market_date, age_days and fresh of each code by its newest bar."""
    rows = bars.where("date IS NOT NULL").groupBy("code").agg(F.max(F.to_date("date")).alias("market_date"))
    return rows.withColumn("age_days", F.greatest(F.datediff(today, "market_date"), F.lit(0))).withColumn("fresh", F.col("age_days") <= max_age_days)


def open_fields(reviews: DataFrame) -> DataFrame:
    """Reviews with the names of their optional fields that are blank."""
    blank = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c) for c in OPTIONAL_FIELDS if c in reviews.columns]
    return reviews.withColumn("open_fields", F.array_compact(F.array(*blank)))


def order_preview(candidates: DataFrame) -> DataFrame:
    """allowed and what stands against it: an approved valid review, fresh data and a manual check are needed.

    candidates: approval_status, valid, fresh and manual_done; a null is a no.
    """
    against = [("review not approved", ~passes((F.col("approval_status") == "approved") & F.col("valid"))), ("data not fresh", ~passes(F.col("fresh"))), ("manual check open", ~passes(F.col("manual_done")))]
    rows = candidates.withColumn("against", F.array_compact(F.array(*[F.when(c, label) for label, c in against])))
    return rows.withColumn("allowed", F.size("against") == 0)


def threshold_text(value: Column) -> Column:
    """An editable threshold without needless decimals: at most twelve, no closing zeros, empty for null."""
    number = F.regexp_replace(F.call_function("format_number", value, F.lit("0.############")), r"^-0$", "0")
    return F.coalesce(number, F.lit(""))


def value_text(value: Column, kind: Column) -> Column:
    """A measure as it is shown: percent with two decimals, yen whole, else two decimals, with thousands separated."""
    return F.when(kind == "percent", F.concat(F.call_function("format_number", value * 100.0, F.lit("0.00")), F.lit("%"))).when(kind == "yen", F.concat(F.lit("¥"), F.format_number(value, 0))).otherwise(F.format_number(value, 2))


def eligible_for_rule(rows: DataFrame, label: str) -> Column:
    """Whether a row says something about one rule: selected, or failed for that rule alone."""
    failed = F.col("fail_reasons")
    return passes(F.col("selected")) | ((F.size(failed) > 0) & (F.size(F.array_except(failed, F.array(F.lit(label)))) == 0))


def sort_order(df: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """Sort keys of a column chosen at run time: by number if all its values are numbers, else by text in lower case, nulls last."""
    value = F.col(column)
    numeric = value.cast("string").try_cast("double")
    all_numbers = df.agg(F.coalesce(F.bool_and(F.when(value.isNotNull(), numeric.isNotNull())), F.lit(False))).first()[0]
    key = numeric if all_numbers else F.lower(value.cast("string"))
    return [key.asc_nulls_last() if ascending else key.desc_nulls_last()]


def sector_reference(rows: DataFrame, metrics: tuple[str, ...], least: int = 5) -> DataFrame:
    """The median of each measure in each sector of a date where `least` peers have it."""
    long = rows.select("as_of", "sector", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("as_of", "sector", "x.*")
    return long.where("v IS NOT NULL AND trim(sector) <> ''").groupBy("as_of", "sector", "metric").agg(F.count("*").alias("peers"), F.median("v").alias("median")).where(F.col("peers") >= least)


def recent_rows(rows: DataFrame, date: str, n: int) -> DataFrame:
    """The last n rows of each code."""
    w = Window.partitionBy("code").orderBy(F.desc(date))
    return rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def next_rows(rows: DataFrame, date: str, after: Column, n: int) -> DataFrame:
    """The first n rows of each code from a date on."""
    w = Window.partitionBy("code").orderBy(date)
    return rows.where(F.col(date) >= after).withColumn("ahead", F.row_number().over(w)).where(F.col("ahead") <= n)


def warnings(rows: DataFrame, relative_on: bool = True) -> DataFrame:
    """warnings: what a reader should know of each row, in a fixed order; rows come from the criteria table."""
    c = F.col
    missing = lambda name: c(name).isNull()
    some = [
        (F.lit(not relative_on), "relative rule off"), (F.lit(relative_on) & missing("relative_return_6m"), "no benchmark, relative rule not applied"), (missing("forecast_op_growth"), "no guidance"),
        (missing("cash_conversion_ratio"), "no cash conversion"), (missing("operating_margin_change_3y"), "margins too few"), (missing("forecast_revision_rate"), "no comparable guidance"),
        (missing("sector_relative_return_6m"), "too few peers"), (F.size("guard_failures") > 0, "guard failed"), (missing("operating_cf_positive_ratio_3y"), "cash flow history too short"),
        (F.coalesce("financial_history_years", F.lit(0)) < 3, "under three years of filings"), (missing("forecast_annual_dividend_per_share"), "no dividend data"),
        (c("forecast_annual_dividend_per_share").isNotNull() & missing("payout_ratio"), "no payout ratio"), (c("forecast_dividend_change_rate") < 0, "dividend cut ahead"), (missing("external_shock_attribution"), "attribution unknown"),
    ]
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(passes(x), label) for x, label in some])))


#: Fixed ranges of Japanese script: kana and ideographs.
JAPANESE = r"[\u3040-\u30ff\u3400-\u9fff]"


def contains_japanese(c: Column) -> Column:
    return F.coalesce(c.rlike(JAPANESE), F.lit(False))


def profile_name(c: Column) -> Column:
    """A name fit for a file: runs of other characters become one underscore, at most 80 characters."""
    name = F.regexp_replace(F.trim(c), r"[^0-9A-Za-zぁ-んァ-ヶ一-龠_-]+", "_")
    name = F.substring(F.regexp_replace(name, r"^[_.]+|[_.]+$", ""), 1, 80)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("my_conditions"))


def header_key(c: Column) -> Column:
    """A header of an import without spaces, brackets and signs, in lower case."""
    return F.lower(F.regexp_replace(c, r"[\s\u3000_()%％・/\-]", ""))


_NEWS = "struct<title:string,link:string,url:string,summary:string,publisher:string,providerPublishTime:string,pubDate:string,content:struct<title:string,summary:string,description:string,pubDate:string,displayTime:string,provider:struct<displayName:string,name:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>>>"


def news_items(rows: DataFrame, column: str = "item") -> DataFrame:
    """title, publisher, published, summary and url of news given as JSON in the old or the new shape; without a title none."""
    n = rows.withColumn("n", F.from_json(column, _NEWS))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"n.{x}"), F.lit("")) for x in names])
    return n.select(
        *[c for c in rows.columns if c != column],
        first("title", "content.title").alias("title"), first("publisher", "content.provider.displayName", "content.provider.name").alias("publisher"),
        first("providerPublishTime", "pubDate", "content.pubDate", "content.displayTime").alias("published"), first("summary", "content.summary", "content.description").alias("summary"),
        first("link", "url", "content.canonicalUrl.url", "content.clickThroughUrl.url").alias("url"),
    ).where("title IS NOT NULL")
