"""Document fingerprints from modular prefix hashes.

For a text c[0..n) the prefix array S[i] = sum of c[j] * B^j over j < i, modulo the prime 2^31 - 1, gives the hash of any
span in one step: (S[j] - S[i]) * B^-i. Equal spans have equal hashes wherever they stand, so span equality is a
comparison of two numbers and the longest common extension of two places is a binary search over it.

A fingerprint is text: the length, the hash of the whole text under two bases, and a sketch of 64 bins that holds the
least hash of the spans of SPAN code points in each bin. The likeness of two fingerprints is the share of bins, of those
filled in either, that agree; it estimates the Jaccard similarity of the two sets of spans. Equal texts have equal
fingerprints and likeness 1.

Defined results: a null text is an empty one; its sketch is empty, so its likeness is 1 to another empty text and 0 to
any other. Texts shorter than a span stand as one span. A null doc_id comes last in the order; rows with one doc_id
stand in the order of a hash of their text. With a single row, the next document is the row itself. An empty table gives
no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 911_382_323)
SPAN = 24
BINS = 64
#: Code points handled at once in a task; a longer text is handled alone.
CHUNK = 1 << 19

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_next long"
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size, made = max(n + 1, CHUNK + 1), []
        for b in (base, pow(base, -1, int(PRIME))):
            run = np.ones(1, np.uint64)
            while len(run) < size:
                run = np.concatenate((run, _mod(run * np.uint64(pow(b, len(run), int(PRIME))))))
            made.append(run[:size])
        have = _tables[base] = (made[0], made[1])
    return have


class PrefixHash:
    """Prefix arrays of a text, or of many texts one after another."""

    def __init__(self, points: np.ndarray, base: int = BASES[0]):
        up, self.down = _powers(base, len(points))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        self.sums[1:] = _mod(np.cumsum(_mod((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])))

    def span(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """Hashes of the spans [start, end), the same for equal spans wherever they stand."""
        start = np.asarray(start)
        return _mod(_mod(self.sums[end] + PRIME - self.sums[start]) * self.down[start])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of some texts and where each text begins, with the end."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def common_extension(a: PrefixHash, i: np.ndarray, b: PrefixHash, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The longest k <= most with equal spans of length k at places i of a and j of b, by binary search."""
    low, high = np.zeros(len(most), np.int64), np.asarray(most, np.int64).copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = a.span(i, i + mid) == b.span(j, j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _sketches(prefix: PrefixHash, starts: np.ndarray) -> np.ndarray:
    """[texts, BINS] least span hashes as 16-bit numbers, 0 for an empty bin."""
    sizes, texts = np.diff(starts), len(starts) - 1
    counts = np.where(sizes >= SPAN, sizes - SPAN + 1, (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(texts), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    hashes = mix64(prefix.span(at, np.minimum(at + SPAN, starts[owner + 1])) + (np.minimum(sizes, SPAN)[owner].astype(np.uint64) << np.uint64(32)))
    least = np.full(texts * BINS, np.uint64((1 << 64) - 1), np.uint64)
    np.minimum.at(least, owner * BINS + (hashes & np.uint64(BINS - 1)).astype(np.int64), hashes >> np.uint64(6))
    filled = least != np.uint64((1 << 64) - 1)
    return np.where(filled, mix64(least) % np.uint64(65_535) + np.uint64(1), np.uint64(0)).astype(">u2").reshape(texts, BINS)


def fingerprint_texts(texts: list[str]) -> tuple[list[str], np.ndarray, PrefixHash, np.ndarray]:
    """Fingerprints, sketches, prefix arrays and starts of some texts."""
    points, starts = code_points(texts)
    one, two = PrefixHash(points), PrefixHash(points, BASES[1])
    whole = one.span(starts[:-1], starts[1:]), two.span(starts[:-1], starts[1:])
    sketches = _sketches(one, starts)
    said = [f"{n:x}-{h:08x}{g:08x}-{s.tobytes().hex()}" for n, h, g, s in zip(np.diff(starts).tolist(), whole[0].tolist(), whole[1].tolist(), sketches, strict=True)]
    return said, sketches, one, starts


def likeness(a: list[str], b: list[str], sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints row by row, 0 to 1; equal fingerprints have 1."""
    either = ((sketch_a > 0) | (sketch_b > 0)).sum(axis=1)
    both = ((sketch_a == sketch_b) & (sketch_a > 0)).sum(axis=1)
    return np.where(np.array([x == y for x, y in zip(a, b, strict=True)], bool), 1.0, both / np.maximum(either, 1))


def _describe(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
    """Results of consecutive rows; `following` is the text after the last."""
    texts = [t for _, t in rows]
    every = [*texts, following]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, every[1:], strict=True)]
    said, sketch, prefix, starts = fingerprint_texts(every)
    said_edited, sketch_edited, _, _ = fingerprint_texts(edited)
    sizes = np.diff(starts)
    shared = common_extension(prefix, starts[:-2], prefix, starts[1:-1], np.minimum(sizes[:-1], sizes[1:]))
    columns = [
        pa.array([d for d, _ in rows], pa.int64()), pa.array(sizes[:-1]), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(said[:-1]), pa.array(said_edited), pa.array(likeness(said[:-1], said_edited, sketch[:-1], sketch_edited)),
        pa.array(likeness(said[:-1], said[1:], sketch[:-1], sketch[1:])), pa.array(shared),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of its edited text (its second half replaced by the start of the next document in
    descending doc_id), their likeness, the likeness to the next document and the length of the start both share.

    The documents are dealt to ranges of doc_id, whose bounds come from the ids alone; the first row of each range also
    goes to the range before, and the first of all to the last. So each text is shuffled once and no range waits for
    another.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = rows.select(order.alias("ord"))
    cuts = sorted(set(ids.approxQuantile("ord", [i / (3 * parts) for i in range(1, 3 * parts)], 1 / (12 * parts)))) if parts > 1 else []
    edges = np.array(cuts, dtype=np.float64)

    @F.pandas_udf("int")
    def bucket(ord_: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, ord_.to_numpy().astype(np.float64), side="left")).astype("int32")

    # one row per range comes to the driver
    heads = sorted((r["b"], r["top"]) for r in ids.groupBy(bucket("ord").alias("b")).agg(F.max("ord").alias("top")).collect())
    targets = [(top, heads[k - 1][0]) for k, (_, top) in enumerate(heads)]
    guests = spark.createDataFrame(targets or [(0, 0)], "ord long, bucket int").limit(len(targets))
    keyed = rows.withColumn("ord", order)
    own = keyed.withColumn("bucket", bucket("ord")).withColumn("guest", F.lit(0))
    visiting = keyed.join(F.broadcast(guests), "ord").withColumn("guest", F.lit(1))
    dealt = own.select("bucket", "guest", "ord", "doc_id", "text").unionByName(visiting.select("bucket", "guest", "ord", "doc_id", "text"))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("ord"), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str]] = []
        size, inside, done = 0, None, False
        for batch in batches:
            for b, guest, key, value in zip(*(batch.column(k).to_pylist() for k in ("bucket", "guest", "doc_id", "text")), strict=True):
                if b != inside:
                    inside, done, waiting, size = b, False, [], 0
                if done:
                    continue
                if waiting and (guest or size + len(value) > CHUNK):
                    yield _describe(waiting, value)
                    waiting, size = [], 0
                if guest:
                    done = True
                else:
                    waiting.append((key, value))
                    size += len(value)

    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(run, _OUT)
