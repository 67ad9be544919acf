"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import decode_documents, encode_documents, token_digest
from .common import read_table
from .decontaminate import find_contamination
from .fingerprints import fingerprint_documents
from .html import extract_pages
from .langid import identify_languages
from .licenses import scan_licenses
from .near_dedup import near_duplicates
from .oracles import NEAR_DUPLICATES, REPEATED_BYTES, SPELLINGS
from .packing import best_fit_pack
from .secrets import find_secrets, secret_digest
from .spelling import group_spellings
from .suffixes import remove_repeats
from .toxicity import score_toxicity
from .whitening import whiten_embeddings


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(read_table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = encode_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return token_digest(decode_documents(encoded, path, public_tokenizers.PATTERN))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(read_table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_best_fit_packing,
    op2_document_fingerprints,
    op3_benchmark_decontamination,
    op4_license_scan,
    op5_minhash_near_dedup,
    op6_html_extraction,
    op7_language_id,
    op8_toxicity,
    op9_secret_scan,
    op10_suffix_dedup,
    op11_byte_bpe,
    op12_spelling_variants,
    op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_minhash_near_dedup": NEAR_DUPLICATES,
        "op10_suffix_dedup": REPEATED_BYTES,
        "op12_spelling_variants": SPELLINGS,
    }
