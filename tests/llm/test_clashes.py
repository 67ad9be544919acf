"""Extra columns whose names the operators use within, empty tables and long texts, through operators and the pipeline."""

import hashlib

import corpus_pipeline
import pytest

from hinode.llm import fingerprints, secrets

USUAL = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = USUAL + ", spans string, fingerprint string, part int, piece int, score double, lang_pred string, bucket long, id long, component_id long, text_id string"
TEXTS = ["the cat sat on the mat with a hat " * 9, None, "", 'db_password = "q8Zk2Lm9Xw"', "der hund und die katze sind im haus " * 12, "the cat sat on the mat with a hat " * 9]


def rows(extra=True):
    clash = ("s", "f", 1, 2, 0.5, "xx", 3, 4, 5, "t") if extra else ()
    return [(i, t, "de" if i == 4 else "en", "s", 0, *clash) for i, t in enumerate(TEXTS)]


def test_fingerprints_and_secrets_ignore_other_columns(spark):
    plain, clash = spark.createDataFrame(rows(False), USUAL), spark.createDataFrame(rows(), CLASHING)
    for run in (fingerprints.fingerprint_documents, lambda df: secrets.secret_digest(secrets.find_secrets(df))):
        assert sorted(map(str, run(clash).collect())) == sorted(map(str, run(plain).collect()))


@pytest.mark.parametrize("schema", [USUAL, CLASHING])
def test_the_pipeline_takes_other_columns_and_no_rows(spark, tmp_path, schema):
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows(schema == CLASHING), schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 3, 4}  # null and empty texts have no language, and of two copies the first stays
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    items.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_texts_longer_than_a_chunk(spark):
    """Fingerprints of texts of more than a megabyte: the edited text is what it says, and equal texts are equal."""
    long = "".join(f"word{i} " for i in range(200_000))
    table = [(1, long), (2, long), (3, "short"), (4, "é" * 600_000)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[4].fingerprint
    edited = table[3][1][:300_000] + "short"[:300_000]
    assert (got[4].n_chars, got[4].edited_sha256) == (600_000, hashlib.sha256(edited.encode()).hexdigest())
    spans = secrets.find_secrets(spark.createDataFrame([(1, long + ' my_token = "q8Zk2Lm9Xw77"')], "doc_id long, text string")).first().spans
    assert [(s.kind, s.end - s.start) for s in spans if s.kind == "literal"] == [("literal", 12)]
