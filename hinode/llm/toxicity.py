"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (3 to 5, with its edges) and itself. A window of words is the average
of its words' bags, fed to a softmax over two classes; embeddings and softmax are trained jointly in numpy by Adagrad.
A text scores as its most toxic window, so that a few words in a long text are not averaged away; training picks each
text's window anew in every epoch (the first time by the document frequencies of n-grams in either class). Misspelt
words share n-grams with the words they come from. A last logistic fit turns the window's margin into a probability.

Defined results: a null text is an empty one; an empty text scores as a window of no words. Without labelled rows of
both classes every text scores the share of label 1 (0 if there are none). Labels that are null or whose row is missing
are not used; several labels of one row all count. A row with a null doc_id is scored, never learned from, and counts as
held out. An empty table gives no rows. Whole texts are scored; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, mix64, text_bytes

BUCKETS = 1 << 19
DIMENSIONS = 8
WINDOW = 8
#: An n-gram found in fewer words of the sample's texts than this has no embedding, so that no text is learned by heart.
LEAST_FOUND = 5
#: One in so many sample texts is kept from the embeddings, for the last logistic fit.
CALIBRATION = 4
#: The most labelled rows of each class that the model is fitted on; a hash of id and text chooses them.
SAMPLE_PER_CLASS = 2000


def word_grams(words: list[bytes] | pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words' n-grams, word after word, and where each word's begin, with the end."""
    column = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    data, starts = text_bytes(column)
    n = len(column)
    sizes = np.diff(starts) + 2  # with the edges
    to = np.cumsum(sizes)
    at = to - sizes
    flat = np.zeros(int(to[-1]) if n else 0, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[at], inner[to - 1] = False, False
    flat[at], flat[to - 1] = 2, 3
    flat[inner] = data
    owner = np.repeat(np.arange(n), sizes)
    left = to[owner] - np.arange(len(flat))  # characters from here to the word's end
    ids, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    padded = np.concatenate((flat, np.zeros(8, np.uint64)))
    for k in range(1, 6):
        h = h * np.uint64(0x100000001B3) + padded[k - 1 : k - 1 + len(flat)] + np.uint64(1)
        if k >= 3:
            ok = np.flatnonzero(left >= k)
            ids.append(mix64(h[ok]) % np.uint64(buckets))
            owners.append(owner[ok])
    up = np.multiply.accumulate(np.full(int(sizes.max()) if n else 1, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(flat)) - at[owner]
    whole = np.add.reduceat(flat * up[place], at) if n else np.zeros(0, np.uint64)
    ids.append(mix64(whole) % np.uint64(buckets))
    owners.append(np.arange(n))
    every = np.concatenate(owners)
    order = np.argsort(every, kind="stable")
    return np.concatenate(ids)[order].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(every, minlength=n))))


def all_grams(words: pa.Array, buckets: int, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """word_grams of many words, some at a time and in 32 bits, for less memory."""
    ids, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), step):
        some, starts = word_grams(words.slice(at, step), buckets)
        ids.append(some.astype(np.int32))
        ends.append(starts[1:] + ends[-1][-1])
    return np.concatenate(ids), np.concatenate(ends)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's place in the list of distinct words, where each text's words begin, and those distinct words. A word
    that repeats at once counts once."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    keep = np.ones(len(at) + 1, bool)
    keep[1:-1] = at[1:] != at[:-1]
    keep[starts[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep[:-1])))
    return at[keep[:-1]], kept[starts], coded.dictionary.cast(pa.binary())


def top_windows(scores: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the start of the window with the highest mean word score, and that mean; 0 for no words."""
    n, texts = len(scores), len(starts) - 1
    sizes = np.diff(starts)
    best, where = np.zeros(texts), starts[:-1].copy()
    if not n:
        return where, best
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    owner = np.repeat(np.arange(texts), sizes)
    to = np.minimum(np.arange(n) + window, starts[owner + 1])
    means = (sums[to] - sums[:-1]) / np.minimum(window, sizes)[owner]  # a window cut short at the end counts as padded
    filled = np.flatnonzero(sizes)
    best[filled] = np.maximum.reduceat(means, starts[filled])
    hit = np.flatnonzero(means == best[owner])
    first = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
    where[owner[first]] = first
    return where, best


@dataclass(frozen=True)
class ToxicityModel:
    """gram_scores: each n-gram's part of the margin, embedding times softmax difference; slope and offset of the last
    logistic fit, which takes in the softmax's bias."""

    gram_scores: np.ndarray
    slope: float
    offset: float

    def word_scores(self, words: pa.Array) -> np.ndarray:
        ids, starts = all_grams(words, len(self.gram_scores))
        if not len(words):
            return np.zeros(0)
        return np.add.reduceat(self.gram_scores[ids], starts[:-1]) / np.diff(starts)

    def predict(self, texts: pa.Array) -> np.ndarray:
        at, starts, words = split_words(texts)
        margins = top_windows(self.word_scores(words)[at] if len(at) else np.zeros(0), starts)[1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit by Newton steps, lightly penalised."""
    w = np.zeros(2)
    a = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.01 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return float(w[0]), float(w[1])


def fit_toxicity(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax jointly on labelled texts."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel(np.zeros(buckets), 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    at, starts, words = split_words(pa.array(texts, pa.string()))
    ids, cuts = all_grams(words, buckets)
    sizes, gram_counts = np.diff(starts), np.diff(cuts)
    owner = np.repeat(np.arange(len(texts)), sizes)

    # in how many texts of either class each distinct word stands, carried to its n-grams
    pair = np.unique(owner * len(words) + at)
    in_class = [np.bincount(pair[labels[pair // len(words)] == k] % len(words), minlength=len(words)).astype(float) for k in (0, 1)]
    gram_word = np.repeat(np.arange(len(words), dtype=np.int32), gram_counts)
    by_gram = [np.bincount(ids, c[gram_word], minlength=buckets) for c in in_class]
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    gram_scores = np.log((by_gram[1] + 0.5) / (n1 + 1)) - np.log((by_gram[0] + 0.5) / (n0 + 1))
    common = by_gram[0] + by_gram[1] >= LEAST_FOUND
    gram_scores[~common] = 0

    rng = np.random.default_rng(seed)
    # rows of the embedding are stepped jointly with the softmax; they start in the direction that chose the first windows
    emb = rng.normal(0, 0.05, (buckets, dimensions)).astype(np.float32) * common[:, None]
    fold = np.arange(len(labels)) % CALIBRATION == 0
    fold &= fold.sum() > 0 and len(set(labels[fold])) == 2 and len(set(labels[~fold])) == 2
    soft = rng.normal(0, 0.3, (dimensions, 2))
    bias = np.zeros(2)
    seen_emb, seen_soft, seen_bias = np.full(buckets, 1e-3), np.full(soft.shape, 1e-3), np.full(2, 1e-3)
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * len(labels)
    filled = np.flatnonzero((sizes > 0) & ~fold)
    score_of = lambda g: np.add.reduceat(g[ids], cuts[:-1]) / gram_counts
    for epoch in range(epochs):
        first, _ = top_windows(score_of(gram_scores)[at], starts)
        extra = rng.integers(0, 1 << 30, len(texts)) % np.maximum(sizes, 1) + starts[:-1]
        for doc in np.array_split(rng.permutation(filled), max(1, len(filled) // 32)):
            clean = doc[labels[doc] == 0]
            begin = np.concatenate((first[doc], extra[clean]))  # of clean texts also a window by chance
            text = np.concatenate((doc, clean))
            stop = np.minimum(begin + WINDOW, starts[text + 1])
            n_words = stop - begin
            w = np.repeat(begin - (np.cumsum(n_words) - n_words), n_words) + np.arange(n_words.sum())
            row = np.repeat(np.arange(len(begin)), n_words)
            word = at[w]
            k = gram_counts[word]
            g = np.repeat(cuts[word] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            gram, g_row = ids[g], np.repeat(row, k)
            share = np.repeat(1.0 / k, k) / n_words[g_row]
            hidden = np.stack([np.bincount(g_row, share * emb[gram, d], minlength=len(begin)) for d in range(dimensions)], axis=1)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(text)), labels[text].astype(int)] -= 1
            p *= weight[text][:, None]
            back = p @ soft.T
            d_soft, d_bias = hidden.T @ p, p.sum(axis=0)
            live = common[gram]
            gram, share, g_row = gram[live], share[live], g_row[live]
            used, inv = np.unique(gram, return_inverse=True)
            d_emb = np.stack([np.bincount(inv, share * back[g_row, d], minlength=len(used)) for d in range(dimensions)], axis=1)
            seen_emb[used] += (d_emb * d_emb).mean(axis=1)
            emb[used] -= rate * (d_emb / np.sqrt(seen_emb[used])[:, None] + decay * emb[used])
            seen_soft += d_soft * d_soft
            soft -= rate * d_soft / np.sqrt(seen_soft)
            seen_bias += d_bias * d_bias
            bias -= rate * d_bias / np.sqrt(seen_bias)
        gram_scores = (emb @ (soft[:, 1] - soft[:, 0]).astype(np.float32)).astype(np.float32)
    _, margins = top_windows(score_of(gram_scores)[at], starts)
    last = fold if fold.any() else np.ones(len(labels), bool)
    slope, offset = _logistic(margins[last], labels[last])
    return ToxicityModel(gram_scores, slope, offset)


def train_toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Fit on the texts of labelled rows; to the driver come at most `per_class` texts of each class, whatever ids repeat."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    ids = None
    for toxic in (0, 1):  # the ids of least hash, each once: so many rows to send to the documents
        some = wanted.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text IS NOT NULL")
    labelled = texts.join(F.broadcast(ids), "doc_id")  # at most per_class ids of each class
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not counts:
        return fit_toxicity([], np.zeros(0))
    rows = bounded_sample(labelled, "toxic", counts, per_class).toArrow().sort_by([("id", "ascending"), ("order", "ascending"), ("toxic", "ascending")])
    return fit_toxicity(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), dtype=np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the labels of rows that are not held out."""
    held = F.coalesce(crc_mod("doc_id") == 0, F.lit(True))
    model = train_toxicity_model(docs, labels.where(~held), per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                score = shared.value.predict(some.column(2))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
