"""Packing of batches in which no new word is made of letters alone, and of a tokenizer that isn't taken apart."""

import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hinode.llm import packing
from hinode.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BATCHES = {
    "nulls": [None, None],
    "empty": ["", " \n\t"],
    "numbers": ["2024: 42", "3.5, 7"],
    "marks": ["...", "?! --"],
    "late numbers": ["the cat sat", "the cat 42"],
}


def expected(rows, capacity=packing.CAPACITY):
    tok = Tokenizer.from_file(tokenizer_file())
    found = []
    for key, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            found.append((key, piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return sorted(found)


def pieces(df):
    return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())


@pytest.mark.parametrize("name", BATCHES)
def test_batches_without_new_plain_words(spark, name):
    rows = list(enumerate(BATCHES[name]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert pieces(packing.best_fit_pack(docs, tokenizer_file())) == expected(rows)
    assert pieces(corpus_pipeline.packing(spark, docs, "")) == expected(rows)


def test_later_batches_bring_only_numbers():
    tok = Tokenizer.from_file(tokenizer_file())
    encoder = packing.WordEncoder(tokenizer_file())
    for text in ("the cat sat", "the cat 42", "7", "", "the cat"):
        got = encoder.encode(pa.array([text]))
        assert np.frombuffer(got[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_another_tokenizer_is_asked_for_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["The cat's 42 hats.", "", "A  b\n c"]
    got = packing.WordEncoder(path).encode(pa.array(texts))
    tok = Tokenizer.from_file(path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pipeline_packs_what_has_no_letters(spark, tmp_path):
    """Language ID keeps what has letters; the secret scan and packing take texts whose only new words are numbers."""
    rows = [(1, "the cat sat on the mat"), (2, None), (3, "2024: 42"), (4, "the cat 42")]
    docs = [(k, t, "en" if k != 4 else "de", "s", 0) for k, t in rows]
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {1, 4}
