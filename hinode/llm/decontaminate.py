"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text's shingles are its runs of five words. A test item is found in
a document if the document holds at least the share `threshold` of the item's distinct shingles.

Items are partitioned by size into classes [s, 2s). For a class, each document is cut into blocks of 2s shingles, and two
neighbouring blocks make a window: whatever run of the document holds the item lies in one window, and the window is
at most 4s long, so containment t means a Jaccard similarity of at least t*s / (s + 4s - t*s), 0.19 at t = 0.8. With
HASHES min-hashes, any one of which makes a candidate, a true pair is missed with probability (1 - 0.19)^64, about 1e-6.
The min-hashes of a window are the least of those of its blocks, and those of larger blocks of smaller ones, so each
shingle is hashed once. Candidates are verified by exact containment of the item's shingles in the whole document.
Items of fewer than 4 shingles need every one of them and are looked up by their least shingle; items of fewer than five
words are looked up as runs of just so many words.

The items reach the tasks in slices of at most about ITEM_WORDS words; each slice is one pass over the documents, which
are never shuffled.

Defined results: null or empty texts hold nothing, null or empty items are found nowhere; equal items and repeated
documents are each reported; a null doc_id or item_id is carried through; empty tables give no rows; further columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, shingle_hashes, text_bytes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
#: Words of items that are sent to the tasks at once.
ITEM_WORDS = 2_000_000
_LEAST_CLASS = 4

_FACTORS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_TOP = np.uint64((1 << 64) - 1)
_OUT = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def min_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[HASHES, groups] least hashes of consecutive groups of shingles, none of them empty."""
    return np.stack([np.minimum.reduceat(shingles * f, starts) for f in _FACTORS]) if len(starts) else np.zeros((HASHES, 0), np.uint64)


@dataclass(frozen=True)
class ItemClass:
    """Items of one size class: their numbers and [HASHES, items] min-hashes, each row sorted with the items' order."""

    size: int
    values: np.ndarray
    order: np.ndarray

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share a min-hash."""
        hits = []
        for values, order, found in zip(self.values, self.order, windows, strict=True):
            low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
            at = np.flatnonzero(high > low)
            n = (high - low)[at]
            if len(at):
                place = np.repeat(low[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hits.append(np.stack((np.repeat(at, n), order[place])))
        pairs = np.unique(np.concatenate(hits, axis=1), axis=1) if hits else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]


class ItemIndex:
    """Test items, partitioned by size, with their shingles."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words, counts = word_hashes(data, offsets)
        runs, n = shingle_hashes(words, counts, SHINGLE)
        cuts = np.cumsum(n)[:-1]
        self.ids = ids
        self.sets = [np.unique(s) for s in np.split(runs, cuts)] if ids else []
        sizes = np.array([len(s) for s in self.sets], np.int64)
        full = counts >= SHINGLE
        self.classes = []
        size = _LEAST_CLASS
        while len(sizes) and size <= sizes[full].max(initial=0):
            chosen = np.flatnonzero(full & (sizes >= size) & (sizes < 2 * size))
            if len(chosen):
                ends = np.cumsum(sizes[chosen])
                values = min_hashes(np.concatenate([self.sets[i] for i in chosen]), ends - sizes[chosen])
                order = np.argsort(values, axis=1)
                self.classes.append(ItemClass(size, np.take_along_axis(values, order, 1), chosen[order]))
            size *= 2
        # items whose shingles must all be there, by their least one; for each number of words in a run
        self.direct: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in range(1, SHINGLE + 1):
            chosen = np.flatnonzero(full & (sizes < _LEAST_CLASS) if width == SHINGLE else counts == width)
            if len(chosen):
                # a run shorter than a shingle is hashed as a document's run of just so many words
                least = np.array([self.sets[i][0] for i in chosen]) if width == SHINGLE else shingle_hashes(np.concatenate([words[o : o + width] for o in (np.cumsum(counts) - counts)[chosen]]), counts[chosen], width)[0]
                if width < SHINGLE:
                    for i, h in zip(chosen, least, strict=True):
                        self.sets[i] = np.array([h])
                order = np.argsort(least)
                self.direct[width] = (least[order], chosen[order])

    def matches(self, words: np.ndarray, counts: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of some documents."""
        runs, n = shingle_hashes(words, counts, SHINGLE)
        n = np.where(counts >= SHINGLE, n, 0)
        runs = runs[np.repeat(counts >= SHINGLE, shingle_hashes_count(counts))]
        starts = np.cumsum(n) - n
        found = set()
        blocks = hashes = None
        width = 2 * self.classes[0].size if self.classes else 0
        for items in self.classes:
            if blocks is None:
                blocks = -(-n // width)
                inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                hashes = min_hashes(runs, np.repeat(starts, blocks) + inner * width)
            while width < 2 * items.size:  # two blocks make a larger one
                first = np.concatenate([np.arange(a, a + b, 2) for a, b in zip(np.cumsum(blocks) - blocks, blocks, strict=True)]) if len(blocks) else np.zeros(0, np.int64)
                hashes = np.minimum.reduceat(hashes, first, axis=1) if len(first) else hashes
                blocks, width = -(-blocks // 2), 2 * width
            owner = np.repeat(np.arange(len(blocks)), blocks)
            if not len(owner):
                continue
            windows = hashes.copy()
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            windows[:, pair] = np.minimum(windows[:, pair], hashes[:, pair + 1])
            at, item = items.find(windows)
            found |= set(zip(owner[at].tolist(), item.tolist(), strict=True))
        own: dict[int, np.ndarray] = {}
        out = []
        for doc, item in sorted(found):
            if doc not in own:
                own[doc] = np.unique(runs[starts[doc] : starts[doc] + n[doc]])
            shared = int(np.isin(self.sets[item], own[doc], assume_unique=True).sum())
            if shared >= threshold * len(self.sets[item]):
                out.append((doc, item, shared))
        for width, (least, order) in self.direct.items():
            some, k = shingle_hashes(words, counts, width)
            owner = np.repeat(np.arange(len(counts)), k)
            low, high = np.searchsorted(least, some, "left"), np.searchsorted(least, some, "right")
            hits = {(int(owner[p]), int(order[q])) for p in np.flatnonzero(high > low) for q in range(low[p], high[p]) if counts[owner[p]] >= width}
            for doc, item in sorted(hits):
                ends = np.cumsum(k)
                shared = int(np.isin(self.sets[item], some[ends[doc] - k[doc] : ends[doc]]).sum())
                if shared >= threshold * len(self.sets[item]):
                    out.append((doc, item, shared))
        return out


def shingle_hashes_count(counts: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """How many runs shingle_hashes gives for each document."""
    return np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))


def _search(docs: DataFrame, index: ItemIndex, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            rows: list[tuple] = []
            for a, b in chunks(offsets):
                words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows += [(ids[a + d], items.ids[i], len(items.sets[i]), s, s / len(items.sets[i])) for d, i, s in items.matches(words, counts, threshold)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _OUT.split(", ")])

    return docs.mapInArrow(run, _OUT)


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_words: int = ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of every document and item it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slices = max(1, -(-int(total) // item_words))
    found = []
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(slices)) == k).toArrow().sort_by("item_id")
        found.append(_search(docs, ItemIndex(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()), threshold))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text holds no test item. Rows are told apart by a hash of their text, so a null or repeated doc_id is no matter."""
    name = "_text_id"
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = find_contamination(texts, benchmark, threshold).select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, F.xxhash64("text")).join(leaks, name, "left_anti").select(*docs.columns)
