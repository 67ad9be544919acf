"""Company search over a stored index of postings.

A name's key (normalised text) is cut into letters; the k-th occurrence of a letter is a posting of its own, so the number
of postings that a query and a key share is the number of letters they have in common. That bounds the likeness of the two
from above: a ratio of matching letters can't be higher. Each beginning of a code is a posting as well. Postings are stored
by buckets of their letter: a query reads the buckets of its own letters and digits, counts shared postings, and compares
only the keys whose bound reaches the lowest score. No table of names is scanned.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinode.functions.scalars import display_code
from hinode.sources.store import scratch_path

#: Fixed: company words that a name's key leaves out, in this order.
COMPANY_WORDS = (
    "株式会社", "（株）", "(株)", "有限会社", "合同会社", "ホールディングス",
    "ホールディング", "グループ", "company", "co.,ltd.", "co., ltd.", "co ltd",
)
#: Fixed: what is left out of a key besides.
_OTHER = re.compile("[^0-9a-zぁ-ん一-龯々〆ヵヶ]+")
#: Fixed scores of matches by code, of whole, leading and inner names, and the parts that coverage adds.
CODE, CODE_PREFIX, WHOLE = 1.20, 1.05, 1.0
LEADING, LEADING_PART, INNER, INNER_PART = 0.94, 0.04, 0.86, 0.06
#: Fixed: the most that likeness can score, the bonus for each shared first letter, and its most.
SIMILAR, LETTER, LETTERS = 0.84, 0.025, 0.12
#: Fixed: the lowest score that is shown, for keys of three letters and more, and for shorter ones.
LEAST, LEAST_SHORT = 0.42, 0.58
#: Buckets of the stored postings.
BUCKETS = 64
_KANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}


def search_text(value: str | None) -> str:
    """NFKC, case folded, katakana as hiragana, without company words, punctuation and other scripts."""
    plain = lambda text: unicodedata.normalize("NFKC", text).casefold()
    text = plain(value or "").strip().translate(_KANA)
    for word in COMPANY_WORDS:
        text = text.replace(plain(word).translate(_KANA), "")
    return _OTHER.sub("", text)


@F.pandas_udf(T.StringType())
def _keys(names: pd.Series) -> pd.Series:
    return names.map(search_text)


def search_key(name: str) -> Column:
    """The key of a column of names: an index stores it once, as the column search_key."""
    return _keys(F.col(name))


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def postings(companies: DataFrame) -> DataFrame:
    """gram, nth, code, name, search_key, bucket: a row for each letter of each key, and for each beginning of each code
    (gram # and the beginning)."""
    rows = companies.select(F.col("code").cast("string").alias("code"), "name", search_key("name").alias("search_key"))
    letters = F.posexplode(F.split("search_key", "")).alias("place", "letter")
    spelled = rows.where("search_key <> ''").select("*", letters).where("letter <> ''")
    # the k-th occurrence: how often the letter stands in the key up to here
    upto = F.substring("search_key", F.lit(1), F.col("place") + 1)
    nth = F.length(upto) - F.length(F.replace(upto, F.col("letter"), F.lit("")))
    by_name = spelled.select(F.col("letter").alias("gram"), nth.cast("int").alias("nth"), "code", "name", "search_key")
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda k: F.substring("code", F.lit(1), k))).alias("start")
    by_code = rows.where("length(code) > 0").select("*", starts)
    by_code = by_code.select(F.concat(F.lit("#"), "start").alias("gram"), F.lit(1).alias("nth"), "code", "name", "search_key")
    both = by_name.unionByName(by_code)
    return both.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BUCKETS)).cast("int"))


def write_index(companies: DataFrame, path: str) -> str:
    """Stores the postings of companies (code, name) under path; an index is written once and read by many queries."""
    made = postings(companies).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram", "nth")
    made.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
    return path


def _read(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """The postings of some grams: only the buckets that hold them are read."""
    held = spark.read.schema("gram string, nth int, code string, name string, search_key string, bucket int").parquet(path)
    return held.where(F.col("bucket").isin(*sorted({_bucket(g) for g in grams})) & F.col("gram").isin(*grams))


def search_index(spark: SparkSession, path: str, query: str | None, limit: int = 30) -> DataFrame:
    """code, display_code, name, search_score, match_type of the companies that match best, of equals the first by code as
    it is shown and name.

    A query without letters or digits finds nothing. Names without a key are found by their code only. Repeated rows of the
    index are found as often as they occur; null names have an empty key, and rows without a code are found by name.
    """
    wanted = search_text(query)
    digits = "".join(c for c in unicodedata.normalize("NFKC", query or "") if c.isdigit())
    least = LEAST if len(wanted) >= 3 else LEAST_SHORT
    asked, occurrences = [], {}
    for letter in wanted:
        occurrences[letter] = occurrences.get(letter, 0) + 1
        asked.append((letter, occurrences[letter]))
    schema = "code string, display_code string, name string, search_score double, match_type string"
    if not asked and not digits:
        return spark.createDataFrame([], schema)
    entry = ["code", "name", "search_key"]
    found = []
    if digits:
        canonical = digits + "0" if len(digits) == 4 else digits
        by_code = _read(spark, path, [f"#{digits}"]).where("nth = 1").select(*entry)
        exact = F.col("code") == canonical if len(digits) >= 4 else F.lit(False)
        score, kind = F.when(exact, CODE).otherwise(CODE_PREFIX), F.when(exact, "code").otherwise("code prefix")
        found.append(by_code.withColumns({"score": score, "match_type": kind}))
    if asked:
        key, n = F.col("search_key"), len(wanted)
        ours = F.broadcast(spark.createDataFrame(asked, "gram string, nth int"))  # as many rows as the query has letters
        shared = _read(spark, path, sorted(occurrences)).join(ours, ["gram", "nth"])
        # rows of an index can repeat, and then each of its postings does
        counted = shared.groupBy(*entry).agg(F.count("*").alias("letters"), F.count_distinct("gram", "nth").alias("own"))
        counted = counted.withColumn("copies", (F.col("letters") / F.col("own")).cast("int"))
        length = F.length(key)
        bonus = F.least(F.lit(LETTERS), LETTER * F.least(F.lit(n), length))
        likely = 2.0 * F.col("own") / (length + n) + bonus >= least - 1e-9
        candidates = counted.where((F.col("own") == n) | likely)
        if digits:
            candidates = candidates.where(~F.coalesce(F.startswith("code", F.lit(digits)), F.lit(False)))
        share = F.least(F.lit(1.0), F.lit(float(n)) / length)
        settled = (
            F.when(key == wanted, WHOLE)
            .when(key.startswith(wanted), LEADING + share * LEADING_PART)
            .when(key.contains(wanted), INNER + share * INNER_PART)
        )
        kind = F.when(key == wanted, "name").when(key.startswith(wanted), "name prefix").when(key.contains(wanted), "part of name")

        @F.pandas_udf(T.DoubleType())
        def likeness(keys: pd.Series) -> pd.Series:
            def one(other: str) -> float:
                pairs = enumerate(zip(wanted, other, strict=False))
                first = next((i for i, (a, b) in pairs if a != b), min(n, len(other)))
                return min(SIMILAR, SequenceMatcher(None, wanted, other).ratio() + min(LETTERS, first * LETTER))

            return keys.map(one)

        rows = candidates.withColumns({"score": settled, "match_type": F.coalesce(kind, F.lit("similar"))})
        sure = rows.where("score IS NOT NULL")
        similar = rows.where("score IS NULL").withColumn("score", likeness("search_key"))
        by_name = sure.unionByName(similar).where(F.col("score") >= least)
        copies = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
        found.append(by_name.withColumn("copy", copies).select(*entry, "score", "match_type"))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    rows = rows.select("code", display_code(F.col("code")).alias("display_code"), "name", F.round("score", 4).alias("search_score"), "match_type")
    return rows.orderBy(F.desc("search_score"), "display_code", "name").limit(limit)


def search_companies(companies: DataFrame, query: str | None, limit: int = 30) -> DataFrame:
    """search_index over an index that is made of companies (code, name) for this query alone."""
    spark = companies.sparkSession
    return search_index(spark, write_index(companies, scratch_path(spark, "company-index")), query, limit)
