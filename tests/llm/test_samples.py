"""Samples that models are fitted on stay bounded when ids or whole rows repeat."""

import pytest
from pyspark.sql import functions as F

from hinode.llm import langid, toxicity
from hinode.llm.common import SAMPLE_TEXT_BYTES, bounded_sample

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def hot(spark):
    """One id with many texts, one row many times, a null id, a text that is too long, and usual rows."""
    rows = [(7, f"hot words number {i}", "en") for i in range(3000)] + [(8, "the same row", "en")] * 2000
    rows += [(None, f"no id {i}", "en") for i in range(500)] + [(9, "x" * (SAMPLE_TEXT_BYTES + 1), "en")]
    rows += [(100 + i, f"usual words of number {i}", "en" if i % 3 else "de") for i in range(900)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("most", [1, 50, 100_000])
def test_a_hot_id_stays_within_the_bound(hot, most):
    counts = {r["lang"]: r["count"] for r in hot.groupBy("lang").count().collect()}
    got = bounded_sample(hot, "lang", counts, most).collect()
    by = {k: [r.text for r in got if r.lang == k] for k in counts}
    for k, texts in by.items():
        distinct = {(r.doc_id, r.text) for r in hot.where((F.col("lang") == k) & (F.length("text") <= SAMPLE_TEXT_BYTES)).collect()}
        assert len(texts) <= min(most, len(distinct)) and len(texts) >= min(most, len(distinct)) * 0.5
    if most == 100_000:
        assert len(by["en"]) == 3000 + 1 + 500 + 600 and len(by["de"]) == 300
    again = bounded_sample(hot.repartition(2), "lang", counts, most).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_language_model_fits_with_a_hot_id(spark, hot):
    model = langid.train_language_model(hot, per_language=100)
    got = langid.predict_languages(hot.limit(10), model).collect()
    assert model.languages == ("de", "en") and len(got) == 10


def test_toxicity_fits_with_a_hot_id(spark, hot, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda texts, labels: seen.append((texts, labels)))
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 0), (None, 1), (9, 1), *((100 + i, i % 2) for i in range(900))], "doc_id long, toxic int")
    toxicity.train_toxicity_model(hot, labels, per_class=600)
    texts, classes = seen[0]
    assert len(texts) == len(classes) <= 1200 and sum(classes) <= 600
    assert max(map(len, texts)) <= SAMPLE_TEXT_BYTES and texts.count("the same row") <= 1
