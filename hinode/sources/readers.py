"""Sources and sinks: contracts, normalisers of vendor rows, partitioned stores, certified bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hinode.functions.scalars import coerce_flag, finite, normalize_code, passes
from hinode.operators.asof import keep_last


class ContractError(ValueError):
    """A table lacks what its contract asks for."""


CONTRACTS = {
    "companies": "code string, name string, sector string, market string, shares_outstanding double",
    "prices": "date date, code string, close double, high double, low double, volume double",
    "financials": "disclosure_date date, code string, fiscal_year int, sales double, operating_profit double, operating_cf double, total_assets double, equity double",
    "events": "event_date date, code string, category string, externality double, temporary_probability double, catalyst_probability double, evidence string, source_url string, review_status string",
    "signals": "signal_date date, code string, score double",
}
#: Fixed market codes of the vendor's master.
MARKETS = {"0111": "Prime", "0112": "Standard", "0113": "Growth"}


def ensure_columns(df: DataFrame, schema: str) -> DataFrame:
    """df with each column of the schema, absent ones as typed nulls; further columns stay."""
    for name, kind in (c.split() for c in schema.split(", ")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def check_contract(df: DataFrame, kind: str) -> DataFrame:
    """df cast to its contract; a missing column is an error at once, a date that can't be read when it is computed."""
    wanted = [c.split() for c in CONTRACTS[kind].split(", ")]
    missing = [n for n, _ in wanted if n not in df.columns]
    if missing:
        raise ContractError(f"{kind} lacks {', '.join(missing)}")
    out = df
    for name, kind_ in wanted:
        value = F.col(name)
        if name == "code":
            value = normalize_code(value)
        elif kind_ == "date":
            value = F.to_date(value)
        elif kind_ in ("double", "int"):
            value = value.try_cast(kind_)
        out = out.withColumn(name, value)
    return out


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV with header under its contract; codes are read as text so that leading zeros stay."""
    return check_contract(spark.read.option("header", True).option("encoding", "UTF-8").csv(path), kind)


def write_bundle(tables: dict[str, DataFrame], root: str, actual: bool = True) -> None:
    """Tables as zstd Parquet with a manifest of row counts and order-free fingerprints."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
        n, x = spark.read.parquet(f"{root}/{name}").agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first()
        rows.append((name, n, x, actual))
    spark.createDataFrame(rows, "name string, n long, fingerprint long, actual boolean").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def read_bundle(spark: SparkSession, root: str, certified: bool = True) -> dict[str, DataFrame]:
    """The tables of a bundle; a table that differs from its manifest, or sample data where actual is asked, is an error."""
    out = {}
    for r in spark.read.schema("name string, n long, fingerprint long, actual boolean").json(f"{root}/manifest").collect():  # a row per table
        df = spark.read.parquet(f"{root}/{r['name']}")
        n, x = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first()
        if (n, x) != (r["n"], r["fingerprint"]) or certified and not r["actual"]:
            raise ContractError(f"{r['name']} isn't what the manifest certifies")
        out[r["name"]] = df
    return out


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that is there and not null."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def normalize_prices(raw: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Vendor bars: adjusted values with raw ones as fallback, turnover from close times volume, one row per code and date."""
    num = lambda names: finite(first_present(raw, names))
    close, volume = num(["AdjC", "C", "close"]), num(["AdjVo", "Vo", "volume"])
    rows = raw.select(
        F.to_date(first_present(raw, ["Date", "date"])).alias("date"), normalize_code(first_present(raw, ["Code", "code"])).alias("code"), num(["AdjO", "O", "open"]).alias("open"), num(["AdjH", "H", "high"]).alias("high"),
        num(["AdjL", "L", "low"]).alias("low"), close.alias("close"), volume.alias("volume"), F.coalesce(num(["Va", "turnover"]), close * volume).alias("turnover"),
    ).where("date IS NOT NULL AND code IS NOT NULL AND close IS NOT NULL")
    rows = keep_last(rows, ["code", "date"], [F.desc_nulls_last("turnover"), F.desc("close")])
    return rows.join(index, "date", "left") if index is not None else rows


def normalize_companies(raw: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Vendor master with market names and, from the newest filing that has them, shares outstanding."""
    names = F.create_map(*[F.lit(x) for pair in MARKETS.items() for x in pair])
    market = first_present(raw, ["Mkt", "market"])
    rows = raw.select(normalize_code(first_present(raw, ["Code", "code"])).alias("code"), first_present(raw, ["CoName", "name"]).cast("string").alias("name"), F.coalesce(first_present(raw, ["S33Nm", "sector"]).cast("string"), F.lit("")).alias("sector"), F.coalesce(names[market], market.cast("string")).alias("market"), F.to_date(first_present(raw, ["Date", "master_date"])).alias("master_date"))
    rows = keep_last(rows.where("code IS NOT NULL"), ["code"], [F.desc_nulls_last("master_date"), "name"])
    if filings is None:
        return rows.withColumn("shares_outstanding", F.lit(None).cast("double"))
    shares = filings.where("shares_outstanding IS NOT NULL").groupBy("code").agg(F.max_by("shares_outstanding", "disclosure_date").alias("shares_outstanding"))
    return rows.join(shares, "code", "left")


def normalize_financials(raw: DataFrame) -> DataFrame:
    """Vendor summaries read as text: numbers coerced, annual actuals and revisions flagged."""
    num = lambda *names: finite(first_present(raw, list(names)))
    kind = F.upper(F.coalesce(first_present(raw, ["CurPerType", "statement_type"]).cast("string"), F.lit("")))
    sales, op = num("Sales", "sales"), num("OP", "operating_profit")
    return raw.select(
        F.to_date(first_present(raw, ["DiscDate", "disclosure_date"])).alias("disclosure_date"), normalize_code(first_present(raw, ["Code", "code"])).alias("code"), first_present(raw, ["DiscNo", "document_id"]).cast("string").alias("document_id"),
        kind.alias("statement_type"), F.year(F.to_date(first_present(raw, ["CurFYEn", "period_end"]))).alias("fiscal_year"), sales.alias("sales"), op.alias("operating_profit"), num("CFO", "operating_cf").alias("operating_cf"),
        num("TA", "total_assets").alias("total_assets"), num("Eq", "equity").alias("equity"), num("CashEq", "cash").alias("cash"), F.lit(None).cast("double").alias("interest_bearing_debt"), num("EPS", "eps").alias("eps"),
        num("BPS", "book_value_per_share").alias("book_value_per_share"), num("FOP", "forecast_operating_profit").alias("forecast_operating_profit"), num("DivAnn").alias("actual_annual_dividend_per_share"), num("PayoutRatioAnn").alias("actual_payout_ratio"),
        num("FDivAnn").alias("forecast_annual_dividend_per_share"), num("NxFDivAnn").alias("next_forecast_annual_dividend_per_share"), num("NxFPayoutRatioAnn").alias("next_forecast_payout_ratio"), num("ShOutFY").alias("shares_outstanding"),
        ((kind == "FY") & sales.isNotNull() & op.isNotNull()).alias("is_full_year_actual"), (sales.isNull() & op.isNull()).alias("is_revision"),
    ).where("code IS NOT NULL AND disclosure_date IS NOT NULL")


def proxy_series(prices: DataFrame, codes: list[str]) -> DataFrame:
    """date and proxy_close of the first fund, in the order given, that has two bars at least."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, i)])
    found = prices.where(F.col("code").isin(*codes) & F.col("close").isNotNull()).withColumn("place", order[F.col("code")])
    best = found.groupBy("place").agg(F.count("*").alias("n")).where("n >= 2").agg(F.min("place").alias("place"))
    return found.join(best, "place").select("date", F.col("close").alias("proxy_close"), F.col("code").alias("proxy_code"))


def request_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The week days of a range."""
    days = spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b))) AS date", {"a": start, "b": end})
    return days.where(F.weekday("date") < 5)


def covered_window(message: str, start: str, end: str) -> tuple[str, str]:
    """A requested range, clamped to the one that an error message of the vendor names."""
    import re

    named = re.findall(r"\d{4}-\d{2}-\d{2}", message)
    return (max(start, named[0]), min(end, named[-1])) if len(named) >= 2 else (start, end)


def write_day(df: DataFrame, root: str, day: str, value: str) -> None:
    """Replace one day of a store that is partitioned by day, and leave the others."""
    df.withColumn(day, F.lit(value).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)


def read_days(spark: SparkSession, root: str, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Days of a store; the bounds prune partitions, and files with differing columns are joined by name."""
    df = spark.read.option("mergeSchema", True).parquet(root)
    if start:
        df = df.where(F.col(day) >= F.lit(start).cast("date"))
    return df.where(F.col(day) <= F.lit(end).cast("date")) if end else df


def upgrade_scores(rows: DataFrame, added: float = 28.0) -> DataFrame:
    """Scores of the old scale, which had review penalties inside, on the new one."""
    old = F.coalesce(F.col("score_scale") != "quantitative_v2", F.lit(True))
    return rows.withColumn("quantitative_score", F.when(old, F.least(F.col("quantitative_score") + added, F.lit(85.0))).otherwise(F.col("quantitative_score"))).withColumn("score_scale", F.lit("quantitative_v2"))


def master_as_of(masters: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per date the newest dated master at or before it: as_of, master_date and the master's rows."""
    dates = masters.select("master_date").distinct()
    w = Window.orderBy("master_date")  # one row per archived day
    spans = dates.withColumn("until", F.lead("master_date").over(w))
    chosen = as_of.join(spans, (F.col("master_date") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("until") > F.col("as_of")))).select("as_of", "master_date")
    return masters.join(F.broadcast(chosen), "master_date")  # a row per replay date


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review documents with their structured conditions, and `valid`: known version and state, a source and an assessment,
    and measures from 0 to 1 (0.5 where missing)."""
    measures = ("external_factor_degree", "temporariness_probability", "catalyst_probability", "structural_risk")
    schema = (
        "schema_version string, code string, approval_status string, invalidation_conditions string, "
        "primary_source struct<document_id:string,published_at:string,location:string,summary:string>, "
        f"assessment struct<{','.join(f'{m}:double' for m in measures)}>, "
        "structured_invalidation_conditions array<struct<metric:string,operator:string,threshold:double,unit:string,enabled:boolean,note:string>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    sound = [F.coalesce(F.col(f"assessment.{m}"), F.lit(0.5)).between(0, 1) for m in measures]
    # Fixed: the version and the states of a review
    known = (F.col("schema_version") == "1.0") & F.coalesce("approval_status", F.lit("pending")).isin("approved", "pending", "rejected")
    whole = F.col("primary_source").isNotNull() & F.col("assessment").isNotNull()
    valid = passes(F.forall(F.array(known, whole, *sound), lambda x: x))
    return rows.withColumn("code", normalize_code(F.col("code"))).withColumn("valid", valid)


def stored_flags(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({n: coerce_flag(F.col(n)) for n in names})


def normalize_index(raw: DataFrame) -> DataFrame:
    """date and index_close of the market's index, both known, one row per date: the last loaded where `loaded` tells, else the highest."""
    rows = raw.select(F.to_date(first_present(raw, ["Date", "date"])).alias("date"), finite(first_present(raw, ["C", "close"])).alias("index_close"), first_present(raw, ["loaded"]).cast("long").alias("loaded"))
    return keep_last(rows.where("date IS NOT NULL AND index_close IS NOT NULL"), ["date"], [F.desc_nulls_last("loaded"), F.desc("index_close")]).drop("loaded")


def normalize_earnings(raw: DataFrame) -> DataFrame:
    """The calendar of earnings: date, code, name, fiscal_year, quarter and market as text, of rows with a date."""
    text = lambda c: F.coalesce(first_present(raw, [c]).cast("string"), F.lit(""))
    rows = raw.select(F.to_date(first_present(raw, ["Date"])).alias("date"), normalize_code(text("Code")).alias("code"), text("CoName").alias("name"), text("FY").alias("fiscal_year"), text("FQ").alias("quarter"), text("Section").alias("market"))
    return rows.where("date IS NOT NULL")


#: Fixed names of the vendor's disclosure columns.
DISCLOSURE = {"Code": "code", "DiscDate": "published_date", "DiscTime": "published_time", "DiscNo": "document_id", "Title": "title"}


def normalize_disclosures(raw: DataFrame) -> DataFrame:
    """Disclosures with the library's names; other columns stay."""
    rows = raw.withColumnsRenamed({k: v for k, v in DISCLOSURE.items() if k in raw.columns})
    if "code" in rows.columns:
        rows = rows.withColumn("code", normalize_code(F.col("code")))
    return rows.withColumn("published_date", F.to_date("published_date")) if "published_date" in rows.columns else rows


#: Fixed headers of a broker's export that stand for each column.
BROKER_HEADERS = {
    "code": ("銘柄コード", "コード", "証券コード", "code", "ticker"), "name": ("銘柄名", "会社名", "名称", "name"), "market": ("市場", "市場区分", "market"), "price": ("現在値", "株価", "終値", "price", "close"),
    "per": ("PER", "予想PER", "per"), "pbr": ("PBR", "実績PBR", "pbr"), "equity_ratio": ("自己資本比率", "自己資本比率(%)", "equity_ratio"), "sales_growth": ("売上高成長率", "売上成長率", "sales_growth"), "op_growth": ("営業利益成長率", "営業増益率", "op_growth"),
}


def _header(name: str) -> str:
    return "".join(c for c in name.lower() if not c.isspace() and c not in "_()%％・/-")


def read_broker_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exports of a broker's screen: UTF-8 or cp932, headers by their aliases, one row per code of a file.

    A file is decoded by one task, in batches of rows; a file without a column of codes is an error.
    """
    names = list(BROKER_HEADERS)

    def rows(batches):
        import csv
        import io

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                for encoding in ("utf-8-sig", "cp932"):
                    try:
                        text = bytes(content).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        text = bytes(content).decode("utf-8", errors="replace")
                lines = csv.reader(io.StringIO(text))
                found = {_header(h): k for k, h in reversed(list(enumerate(next(lines, []))))}
                at = {n: next((found[_header(a)] for a in BROKER_HEADERS[n] if _header(a) in found), None) for n in names}
                if at["code"] is None:
                    raise ContractError("no column of codes")
                some = [[line[k] if k is not None and k < len(line) else None for k in at.values()] for line in lines]
                yield pd.DataFrame(some, columns=names)

    read = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"{n} string" for n in names))
    known = read.withColumn("code", normalize_code(F.col("code"))).where("length(code) >= 4")
    return known.dropDuplicates(["code"]).withColumns({n: finite(F.col(n)) for n in names[3:]})


def join_master(imported: DataFrame, master: DataFrame, candidates: DataFrame) -> DataFrame:
    """Imported rows with the master's name and sector, and whether they are among the candidates."""
    known = master.select("code", F.col("name").alias("master_name"), "sector").dropDuplicates(["code"])
    flags = candidates.select("code").distinct().withColumn("is_candidate", F.lit(True))
    rows = imported.join(known, "code", "left").join(flags, "code", "left")
    return rows.withColumn("name", F.coalesce("name", "master_name")).withColumn("is_candidate", F.coalesce("is_candidate", F.lit(False))).drop("master_name")


def write_snapshot(df: DataFrame, root: str, day: str, data_as_of: str) -> bool:
    """Writes an analysis day, replacing it if there; a new day that says what the day before said is not written.

    True if the day was written. Days are compared by an order-free fingerprint of their rows and by data_as_of.
    """
    from hinode.operators.history import same_rows

    spark = df.sparkSession
    rows = df.withColumn("data_as_of", F.lit(data_as_of).cast("date"))
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.parquet(root).where(F.col("analysis_date") < F.lit(day).cast("date"))
        last = old.agg(F.max("analysis_date")).first()[0]
        names = sorted(rows.columns)
        if last is not None:
            before = old.where(F.col("analysis_date") == F.lit(last))
            if set(names) <= set(before.columns) and same_rows(before.select(*names), rows.select(*names), names):
                return False
    write_day(rows, root, "analysis_date", day)
    return True
