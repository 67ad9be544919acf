"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: large-item matching. Pieces above a third of the capacity can stand at most twice in a sequence, so they are
matched first: the longest takes the longest that still fits beside it. The smaller ones then go, longest first, to the
sequence with the least gap that holds them.

The decisions depend on lengths alone, so they are made on the histogram of lengths (at most `capacity` numbers,
whatever the corpus) as runs of equal sequences. Each piece finds its place by its rank among the pieces of its length,
which comes from counts per input partition: no task or driver sees more than the counts.

Defined results: a null or empty text is the end-of-text id alone (length 1); rows that repeat are packed as often as
they occur; a null doc_id is carried through; an empty table gives no rows; columns other than the two named ones are
left alone. Texts of any length are tokenised whole; only documents longer than the capacity are cut.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
#: Words whose ids a task remembers; the rest are encoded again in each batch.
MEMO_WORDS = 250_000

#: ASCII punctuation that closes words; an apostrophe may begin a contraction.
_MARKS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _drops_white_space(tokenizer) -> bool:
    """Whether the tokenizer is one that WordEncoder can take apart: composed lower case, white space dropped, word ends."""
    made = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
    splits = [x for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return (
        made["model"].get("end_of_word_suffix") == "</w>"
        and steps == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    )


class WordEncoder:
    """Token ids of texts as little-endian bytes, by white-space words, each encoded once.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its words.
    A word that ends in ASCII punctuation after an ASCII letter or digit is two pre-tokens, which are looked up apart.
    Words of letters alone, already in lower case and composed, are one pre-token each that the normaliser leaves as it
    is: they go to the same model many to a call, and their ids end at a word-end token.
    """

    _known: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _drops_white_space(self.tokenizer)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        self.memo: dict[bytes, bytes] = {}
        self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.marks: dict[bytes, bytes] = {b"": b""}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The process's encoder of this file, with what it remembers from earlier tasks."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _apart(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        joined = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
        ids = np.array([i for e in self.letters.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._apart(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _stem(self, word: bytes) -> tuple[bytes, bytes]:
        """The word in lower case without its closing punctuation, and that punctuation."""
        if b"<|" in word:
            return word, b""
        low = word.lower()
        stem = low.rstrip(_MARKS)
        if len(stem) < len(low) and stem[-1:].isalnum():
            return stem, low[len(stem) :]
        return low, b""

    def _learn(self, unknown: set[bytes]) -> dict[bytes, bytes]:
        memo, fresh = self.memo, {}
        stems = {w: self._stem(w) for w in unknown}
        missing = {s: s.decode() for s in {s for s, _ in stems.values()}.difference(memo)}
        plain = {s: t for s, t in missing.items() if t.isalpha() and t == t.lower() and (t.isascii() or is_normalized("NFC", t))}
        fresh |= zip(plain, self._together(list(plain.values())), strict=True)
        other = [s for s in missing if s not in plain]
        fresh |= zip(other, self._apart([missing[s] for s in other]), strict=True)
        marks = list({m for _, m in stems.values()}.difference(self.marks))
        self.marks |= zip(marks, self._apart([m.decode() for m in marks]), strict=True)
        found = {w: (fresh[s] if s in fresh else memo[s]) + self.marks[m] for w, (s, m) in stems.items()}
        if len(memo) < MEMO_WORDS:
            memo |= found
        if len(memo) < MEMO_WORDS:
            memo |= fresh
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Token ids of each text of a string column without nulls; a tokenizer of another make gets whole texts."""
        if not self.by_words:
            return self._apart(texts.to_pylist())
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words, memo = coded.dictionary.cast(pa.binary()).to_pylist(), self.memo
        ids = [memo.get(w) for w in words]
        if unknown := {w for w, i in zip(words, ids, strict=True) if i is None}:
            found = self._learn(unknown)
            ids = [found[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at] if len(at) else np.zeros(0, np.int64)
        to = np.cumsum(n)
        take = np.arange(to[-1] if len(to) else 0) + np.repeat((np.cumsum(sizes) - sizes)[at] - (to - n), n)
        tokens = flat[take].tobytes()
        ends = np.concatenate(([0], to))[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4
        return [tokens[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """A row per piece, with its input partition and its place among that partition's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                out: dict[str, list] = {k.split()[0]: [] for k in _PIECES.split(", ")}
                for key, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).fill_null("")), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        n = len(cut) // 4
                        for k, v in (("doc_id", key), ("piece", piece), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(cut)), ("part", part), ("place", int(seen[n]))):
                            out[k].append(v)
                        seen[n] += 1
                types = {"long": pa.int64(), "int": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array(out[k.split()[0]], types[k.split()[1]]) for k in _PIECES.split(", ")], names=list(out))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _PIECES)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset, copies in each sequence) that place every rank.

    Rank r of a length is in the run with the last first rank <= r; with q = r - first rank its sequence is
    first sequence + q // copies and its offset is offset + (q % copies) * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    runs: list[tuple[int, int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    open_by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
    gaps: list[int] = []
    sequences = 0

    def put(length: int, first: int, n: int, offset: int, copies: int) -> None:
        runs.append((length, ranks[length], n * copies, first, offset, copies))
        ranks[length] += n * copies
        left[length] -= n * copies

    def keep_open(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not open_by_gap[gap]:
                insort(gaps, gap)
            open_by_gap[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        at = bisect_left(large, capacity - length + 1) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == length and left[length] < 2)):
            at -= 1
        if at < 0:
            n = left[length] if 2 * length > capacity or left[length] < 2 else 0
            put(length, sequences, n, 0, 1)
            keep_open(capacity - length, sequences, n)
        else:
            mate = large[at]
            n = left[length] // 2 if mate == length else min(left[length], left[mate])
            put(length, sequences, n, 0, 1)
            put(mate, sequences, n, length, 1)
            keep_open(capacity - length - mate, sequences, n)
        sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                copies = capacity // length
                n = -(-left[length] // copies)
                gap, first = capacity, sequences
                sequences += n
            else:
                gap = gaps[at]
                first, n = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps.pop(at)
                copies = gap // length
            full = min(n, left[length] // copies)
            if full:
                put(length, first, full, capacity - gap, copies)
                keep_open(gap - copies * length, first, full)
            rest = left[length] if full < n else 0
            if rest:
                put(length, first + full, 1, capacity - gap, rest)
                keep_open(gap - rest * length, first + full, 1)
                full += 1
            if full < n:
                keep_open(gap, first + full, n - full)
    return runs


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Pieces of the documents with their sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, capacity, text, doc_id, end_id), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` rows come to the driver: one per length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(pack_histogram(histogram, capacity)) or np.zeros((0, 6)), dtype=np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(rank) else table[:0]
            q = rank - run[:, 1]
            cols = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(run[:, 3] + q // run[:, 5]), pa.array(run[:, 4] + q % run[:, 5] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[k.split()[0] for k in _PLACED.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, _PLACED)
