"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of other characters than letters becomes one break, and n-grams of one to three
characters within words and their edges are hashed to a fixed number of dimensions. Document frequencies come from all
training rows. The weights are fitted on a bounded sample by follow-the-regularised-leader (FTRL-proximal) with an
elastic-net penalty, which keeps most of them at exactly zero; a temperature, fitted on a part of the sample that the
weights have not seen, calibrates the scores.

Defined results: a null text, and a text without a letter, is `und` with score 0; without any labelled row every text
is `und`. Ties go to the language that sorts first. A row with a null doc_id is predicted but never learned from; it
counts as held out. Repeated rows count as often as they occur. An empty table gives no rows; whole texts of any length
are counted; columns other than the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc_mod, mix64

UNDETERMINED = "und"
DIMENSIONS = 1 << 14
#: The most rows of each language that the weights are fitted on; a hash of id and text chooses them.
SAMPLE_PER_LANGUAGE = 1200
#: Code points counted at once in a task, and texts.
CHUNK, CHUNK_TEXTS = 1 << 18, 64

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def count_ngrams(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, dimension, count) of the n-grams of some texts, sorted by text and dimension."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    owner = np.concatenate(([0], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])))
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    c, o, is_letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    keys = []
    one = np.flatnonzero(is_letter)
    keys.append(o[one] * dimensions + (mix64(c[one]) % np.uint64(dimensions)).astype(np.int64))
    two = c[:-1] * np.uint64(0x1_0000_01B3) + c[1:] + np.uint64(1 << 60)
    keys.append(np.where(is_letter[:-1], o[:-1], o[1:]) * dimensions + (mix64(two) % np.uint64(dimensions)).astype(np.int64))
    mid = np.flatnonzero(is_letter[1:-1])
    three = (c[mid] * np.uint64(0x1_0000_01B3) + c[mid + 1]) * np.uint64(0x1_0000_01B3) + c[mid + 2] + np.uint64(1 << 61)
    keys.append(o[mid + 1] * dimensions + (mix64(three) % np.uint64(dimensions)).astype(np.int64))
    counts = np.bincount(np.concatenate(keys), minlength=len(texts) * dimensions)
    at = np.flatnonzero(counts)
    text = at // dimensions
    # a text without a letter has no n-grams of its own
    lettered = np.bincount(o[one], minlength=len(texts)) > 0
    at, text = at[lettered[text]], text[lettered[text]]
    return text, at % dimensions, counts[at]


def _text_chunks(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        if some and (size + len(t) > CHUNK or len(some) >= CHUNK_TEXTS):
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def tfidf(text: np.ndarray, dimension: np.ndarray, count: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """Weights 1 + log(count), times idf, each text's scaled to length 1."""
    x = (1 + np.log(count)) * idf[dimension]
    norm = np.sqrt(np.bincount(text, x * x, minlength=texts))
    return x / np.maximum(norm, 1e-12)[text]


@dataclass(frozen=True)
class LanguageModel:
    """languages in order; idf [dimensions]; weights [dimensions, languages]; bias; temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: np.ndarray, dimension: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        x = tfidf(text, dimension, count, self.idf, texts)
        return np.stack([np.bincount(text, x * self.weights[dimension, k], minlength=texts) for k in range(len(self.languages))], axis=1) + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, -1 for undetermined, and its calibrated probability."""
        text, dimension, count = count_ngrams(texts, len(self.idf))
        logits = self.logits(text, dimension, count, len(texts)) / self.temperature
        p = softmax(logits)
        best = logits.argmax(axis=1)
        known = np.bincount(text, minlength=len(texts)) > 0
        return np.where(known, best, -1), np.where(known, p[np.arange(len(texts)), best], 0.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of (dimensions, values, class) rows by FTRL-proximal, one row after another."""
    z, n = np.zeros((dimensions + 1, classes)), np.zeros((dimensions + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, label = rows[r]
            at, x = np.append(at, dimensions), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(dimensions + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in 0.05 to 20 with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train_language_model(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> LanguageModel | None:
    """Fit on the columns doc_id, text and lang of labelled rows; None if there are none.

    To the driver come a count per language, a document frequency per dimension, and the n-gram counts of at most
    `per_language` rows of each language, whatever ids repeat.
    """
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = tuple(sorted(counts))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            for some in _text_chunks(batch.column(0).to_pylist()):
                df += np.bincount(count_ngrams(some, dimensions)[1], minlength=dimensions)
                total += len(some)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], names=["dimension", "n"])

    found = rows.select("text").mapInArrow(frequencies, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(dimensions + 1)
    df[[r["dimension"] for r in found]] = [r["n"] for r in found]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    chosen = bounded_sample(rows, "lang", counts, per_language)
    chosen = chosen.select("text", "lang", F.pmod(F.xxhash64("order", F.lit(1)), F.lit(5)).alias("fold"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in _text_chunks(batch.column(0).to_pylist()):
                text, dimension, count = count_ngrams(some, dimensions)
                cuts = np.searchsorted(text, np.arange(len(some) + 1))
                out += [(dimension[a:b].tolist(), count[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([a for a, _ in out], pa.list_(pa.int32())), pa.array([b for _, b in out], pa.list_(pa.int32()))], names=["lang", "fold", "dimension", "count"])

    sample = chosen.mapInArrow(counted, "lang string, fold long, dimension array<int>, count array<int>").toArrow()
    train, held = [], []
    whole = sample.combine_chunks()
    lists = [whole.column(k).combine_chunks() if whole.num_rows else pa.array([], pa.list_(pa.int32())) for k in ("dimension", "count")]
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]  # as arrays, not as lists of Python's numbers
    ends = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    for n, (lang, fold) in enumerate(zip(whole.column("lang").to_pylist(), whole.column("fold").to_pylist(), strict=True)):
        at, count = (x[ends[n] : ends[n + 1]].astype(np.int64) for x in flat)
        if len(at):
            x = tfidf(np.zeros(len(at), np.int64), at, count, idf, 1)
            (held if fold == 0 else train).append((at, x, languages.index(lang)))
    order = lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes())  # noqa: E731  the same whatever order the rows came in
    train, held = sorted(train, key=order), sorted(held, key=order)
    weights, bias = fit_ftrl(train, dimensions, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, np.array([y for *_, y in held], dtype=np.int64)))


def predict_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score, from the text alone; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*kept)
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    place, shared = kept.index(text), docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*shared.value.languages, UNDETERMINED]
        for batch in batches:
            best, score = [], []
            for some in _text_chunks(batch.column(place).fill_null("").to_pylist()):
                b, s = shared.value.predict(some)
                best += [names[k] for k in b.tolist()]
                score += s.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    held = F.coalesce(crc_mod("doc_id") == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train_language_model(rows.where(~held), per_language)
    return predict_languages(rows.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
