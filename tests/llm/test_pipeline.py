"""The pipeline's filtering stages against brute force, with null ids, repeated ids and equal rows."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(31)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base = [text(120) for _ in range(8)]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in base]
    rows = [(None, base[0]), (None, base[1]), (None, base[2]), (5, base[3]), (5, base[4]), (5, near[3]), (None, near[1]), (9, near[2]), (2, base[5]), (2, base[5]), (None, base[6]), (None, base[6]), (5, text(3))]
    rows += [(None, None), (None, None), (None, ""), (4, " \n"), (4, " \n"), (8, f'x-api-key: "q7Zk29LmX4vT8b" {base[7]}')]
    return [(k, t, "en", "s", 0) for k, t in rows]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


def shingles(text):
    low = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))} - {()}


def test_near_dedup_keeps_one_row_of_each_group(spark, docs):
    rows = made()
    groups = []
    for r in rows:
        own = shingles(r[1])
        like = [g for g in groups if own and any(100 * len(own & s) >= 80 * len(own | s) for s in (shingles(x[1]) for x in g))]
        groups = [g for g in groups if not any(g is x for x in like)] + [[r, *(x for g in like for x in g)]]
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) if len({r[0] for r in g}) == len(g) else next(r for r in kept if r in g) for g in groups)
    assert len(kept) == len(groups) and kept[0].asDict().keys() == dict.fromkeys(docs.columns).keys()


@pytest.mark.parametrize("size", [40, 300, 3000])
def test_near_dedup_drops_copies_of_eighty_percent(spark, size):
    rng = random.Random(size)
    rows = []
    for k in range(20):
        base = [f"v{rng.randrange(10**6)}" for _ in range(size + 4)]
        more = [f"v{rng.randrange(10**6)}" for _ in range(int(size * 0.22))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + more))]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 40, 2))


def test_decontamination_judges_each_row_by_its_text(spark, docs, tmp_path):
    rows = made()
    items = [" ".join(rows[k][1].split()[20:60]) for k in (0, 3)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    clean = [r for r in rows if all(len(shingles(r[1]) & shingles(i)) < 0.8 * len(shingles(i)) for i in items)]
    assert Counter(map(tuple, got)) == Counter(clean) and len(clean) == len(rows) - 3


def test_secret_scan_keeps_every_row(spark, docs):
    got = corpus_pipeline.secret_scan(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in made())
    assert not any("q7Zk29LmX4vT8b" in (r.text or "") for r in got)


def test_language_id_and_packing_keep_null_and_repeated_ids(spark):
    held = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{held}/documents.parquet").where("length(text) > 200")
    docs = docs.selectExpr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 1 ELSE doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.limit(3))
    told = corpus_pipeline.language_id(spark, docs, held)
    whole, kept = Counter(map(tuple, docs.collect())), Counter((*r[:2], *r[3:]) for r in told.collect())
    assert sum(kept.values()) >= 0.9 * sum(whole.values()) and not kept - Counter((*r[:2], *r[3:]) for r in whole.elements())
