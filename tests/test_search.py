"""Company search through the index against a comparison with every name."""

import random
import unicodedata
from difflib import SequenceMatcher

import pytest

from hinode.operators import search

COMPANIES = [
    ("72030", "トヨタ自動車"), ("31160", "トヨタ紡織"), ("80150", "豊田通商"), ("83060", "三菱ＵＦＪフィナンシャル・グループ"),
    ("94320", "日本電信電話株式会社"), ("7204", "とよた"), ("99990", None), ("99980", "株式会社"), ("99970", "!!!"), (None, "アルファ"),
    ("12340", "Alpha Beta Co., Ltd."), ("12350", "alpha beta"), ("12350", "alpha beta"), ("12360", "Alphabet Holdings"), ("55550", "1234 Works"),
]


def by_hand(rows, query, limit):
    wanted = search.search_text(query)
    digits = "".join(c for c in unicodedata.normalize("NFKC", query or "") if c.isdigit())
    found = []
    for code, name in rows:
        key, shown = search.search_text(name), code
        if code and len(code) == 5 and code.endswith("0"):
            shown = code[:4]
        if len(digits) >= 4 and code == (digits + "0" if len(digits) == 4 else digits):
            score, kind = 1.20, "code"
        elif digits and code and code.startswith(digits):
            score, kind = 1.05, "code prefix"
        elif not wanted or not key:
            continue
        elif key == wanted:
            score, kind = 1.0, "name"
        elif key.startswith(wanted):
            score, kind = 0.94 + len(wanted) / len(key) * 0.04, "name prefix"
        elif wanted in key:
            score, kind = 0.86 + len(wanted) / len(key) * 0.06, "part of name"
        else:
            same = next((i for i, (a, b) in enumerate(zip(wanted, key)) if a != b), min(len(wanted), len(key)))  # noqa: B905
            score, kind = min(0.84, SequenceMatcher(None, wanted, key).ratio() + min(0.12, same * 0.025)), "similar"
        if score >= (0.42 if len(wanted) >= 3 else 0.58):
            found.append((code, shown, name, round(score, 4), kind))
    # nulls first, as Spark orders them
    found.sort(key=lambda r: (-r[3], r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
    return found[:limit]


def test_keys():
    assert search.search_text("トヨタ 株式会社") == search.search_text("ﾄﾖﾀ") == "とよた"
    assert search.search_text("Ａlpha-Ｂeta CO., LTD.") == "alphabeta" and search.search_text(None) == ""


QUERIES = ["トヨタ", "トヨダ", "三菱ufj", "7203", "123", "12340", "1234", "alpha", "alphabeta", "beta alpha", "と", "電話", "", None, "株式会社", "?!", "豊", "zzz", "72 トヨタ"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(COMPANIES, "code string, name string").repartition(3)
    return search.write_index(df, str(tmp_path_factory.mktemp("index") / "companies"))


@pytest.mark.parametrize("query", QUERIES)
def test_index_finds_what_a_scan_finds(spark, index, query):
    got = [tuple(r) for r in search.search_index(spark, index, query, 30).collect()]
    assert got == by_hand(COMPANIES, query, 30)


def test_many_names_and_ties(spark, tmp_path):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 9)))
    rows = [(f"{rng.randrange(1000, 99999)}", rng.choice([name(), name(), None])) for _ in range(700)]
    path = search.write_index(spark.createDataFrame(rows, "code string, name string"), str(tmp_path / "many"))
    for query in ("abc", "aab", "edcba", "ab", "1", "12", "bad cab", "eeeeeeeeee"):
        got = [tuple(r) for r in search.search_index(spark, path, query, 25).collect()]
        assert got == by_hand(rows, query, 25), query


def test_a_query_reads_its_buckets_only(spark, index):
    plan = search.search_index(spark, index, "トヨ")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    read = search._read(spark, index, ["と", "よ"])
    assert len({r.bucket for r in read.collect()}) <= 2


def test_empty_table(spark, tmp_path):
    path = search.write_index(spark.createDataFrame([], "code string, name string"), str(tmp_path / "none"))
    assert search.search_index(spark, path, "トヨタ").collect() == []
