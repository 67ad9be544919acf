"""Removal of long repeated strings by distributed suffix sorting with deep-shallow order.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Which strings to compare is found by
anchors: of the grams of GRAM bytes in a window of `length` bytes the one with the least hash (the first of equals).
Equal windows have their anchor at the same offset with the same hash, so only suffixes at anchors, about one in 150
bytes, have to be sorted, and only those whose gram occurs at two places.

All places of one gram meet in one group. Their forward suffixes and their reversed prefixes are put in order by
deep-shallow sorting: multikey quicksort to SHALLOW bytes, then blind tries for groups that still share a prefix. The
neighbours' common prefixes give, for every two places, how far they agree to the right (F) and to the left (B); the
windows at offset d are equal when d <= B and length - d <= F. Groups over GROUP places are not sorted in one task: their
windows' hashes are counted by Spark instead, which has no group to hold: two independent hashes of 64 and 61 bits, one
of them modulo a prime, tell the windows apart. Such a gram's rows are dealt over several tasks.

Equal texts are one text in all of this, and if long enough they go whole. A text is shuffled once, and only the texts
that hold a repeated gram go further.

Defined results: null is the empty text; texts under `length` bytes lose nothing; each row is a document of its own, so a
row that repeats is a copy; a null doc_id is carried through; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, Scratch, chunks, join_dealt, may_be_among, mix64, powers, text_bytes

LENGTH = 400
GRAM = 100
SHALLOW = 24
#: Places of one gram that are sorted in one task.
GROUP = 256


# --- deep-shallow order of byte strings -----------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; `known` bytes are known to agree."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("depth", "leaf", "next")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.next = depth, leaf, {}


def blind_trie_order(strings: list[bytes], group: list[int]) -> list[int]:
    """The group in order, by a trie that holds only where strings part: an insertion runs down the parting bytes without
    comparing, compares once with the string it arrives at, and hangs itself where the two differ."""
    char = lambda s, k: s[k] if k < len(s) else -1
    root = _Node(len(strings[group[0]]) + 1, group[0])
    same: dict[int, list[int]] = {group[0]: []}
    for i in group[1:]:
        s, node, path = strings[i], root, []
        while node.next:
            path.append(node)
            node = node.next.get(char(s, node.depth)) or next(iter(node.next.values()))
        other = strings[node.leaf]
        k = common_prefix(s, other)
        if k == len(s) == len(other):
            same[node.leaf].append(i)
            continue
        same[i] = []
        above = None
        for step in path:
            if step.depth >= k:
                break
            above = step
        below = above.next[char(s, above.depth)] if above else root
        leaf = _Node(len(s) + 1, i)
        if below.next and below.depth == k:
            below.next[char(s, k)] = leaf
        else:
            fork = _Node(k, below.leaf)
            fork.next = {char(other, k): below, char(s, k): leaf}
            if above:
                above.next[char(s, above.depth)] = fork
            else:
                root = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.next:
            stack += [node.next[c] for c in sorted(node.next, reverse=True)]
        else:
            out += [node.leaf, *same[node.leaf]]
    return out


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """Indices of the strings in order."""
    out: list[int] = []
    work: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while work:
        group, depth = work.pop()
        if len(group) < 2:
            out += group
        elif depth >= SHALLOW:
            out += blind_trie_order(strings, group)
        else:
            key = [strings[i][depth : depth + 8] for i in group]
            pivot = sorted(key[:: max(1, len(key) // 3)][:3])[min(1, len(key) - 1)]
            less = [i for i, c in zip(group, key, strict=True) if c < pivot]
            equal = [i for i, c in zip(group, key, strict=True) if c == pivot]
            more = [i for i, c in zip(group, key, strict=True) if c > pivot]
            work.append((more, depth))
            work.append((equal, depth + 8 if len(pivot) == 8 else SHALLOW))
            work.append((less, depth))
    return out


def agreement(strings: list[bytes]) -> np.ndarray:
    """[n, n] lengths of common prefixes of every two strings, from the neighbours' in order."""
    n = len(strings)
    order = np.array(deep_shallow_order(strings))
    near = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)], np.int64)
    ordered = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        ordered[i, i + 1 :] = np.minimum.accumulate(near[i:])
    ordered += ordered.T
    out = np.empty_like(ordered)
    out[np.ix_(order, order)] = ordered
    return out


def repeated_offsets(places: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """Of each place (bytes, anchor within them, number of windows that start there on), which windows occur again."""
    count: dict[tuple[bytes, int], int] = {}
    for data, rel, _ in places:
        count[data, rel] = count.get((data, rel), 0) + 1
    keys = list(count)
    again = {}
    if len(keys) > 1:
        right = agreement([d[r:] for d, r in keys])
        left = agreement([d[:r][::-1] for d, r in keys])
    for k, (data, rel) in enumerate(keys):
        windows = len(data) - length + 1
        if count[data, rel] > 1:
            again[data, rel] = np.ones(windows, bool)
        elif len(keys) > 1:
            # window w starts at offset d = rel - w before the anchor
            first = np.maximum(rel - left[k], 0)
            last = np.minimum(rel - (length - right[k]), windows - 1)
            ok = first <= last
            ok[k] = False
            change = np.bincount(first[ok], minlength=windows + 1)[: windows + 1] - np.bincount(last[ok] + 1, minlength=windows + 1)[: windows + 1]
            again[data, rel] = np.cumsum(change)[:windows] > 0
        else:
            again[data, rel] = np.zeros(windows, bool)
    return [again[data, rel] for data, rel, _ in places]


# --- anchors --------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes at every place of a run of texts."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    n = len(data) - size + 1
    return mix64((sums[size:] - sums[:n]) * down[:n]) if n > 0 else np.zeros(0, np.uint64)


_PRIMES = ((1 << 31) - 1, 911382323), ((1 << 30) - 35, 972663749)


def prime_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes at every place, modulo two primes; runs are joined from runs of half their length."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for p, base in _PRIMES:
        run, length, done, at = data.astype(np.int64) + 1, 1, np.zeros(len(out), np.int64), 0
        while n > 0 and length <= size:
            if size & length:
                done = (done * pow(base, length, p) + run[at : at + n]) % p
                at += length
            run = (run[:-length] * pow(base, length, p) + run[length:]) % p
            length *= 2
        out = (out << np.uint64(31)) | done.astype(np.uint64)
    return out


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor in its text, first and last window start it stands for, hash) of some texts."""
    hashes = gram_hashes(data, gram)
    span = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(hashes) < span:
        return none, none, none, none, none.astype(np.uint64)
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    keys = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    # least of every `span` neighbours from running minima of blocks, forwards and backwards
    padded = np.full(-(-len(keys) // span) * span, np.uint64((1 << 64) - 1))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - span + 1
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + length <= offsets[owner + 1])
    if not len(start):
        return none, none, none, none, none.astype(np.uint64)
    at, text = at[start], owner[start]
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    tail = np.concatenate((head[1:] - 1, [len(at) - 1]))
    base = offsets[text[head]]
    return text[head], at[head] - base, start[head] - base, start[tail] - base, hashes[at[head]]


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column(column))
    for a, b in chunks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for a, _, data, offsets in _batches(batch, "text"):
                text, at, first, last, hashes = find_anchors(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(k1[a + text]), pa.array(k2[a + text]), *(pa.array(x.astype(np.int32)) for x in (at, first, last))], names=["gram", "k1", "k2", "place", "first", "last"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, place int, first int, last int")


_SPAN = "k1 long, k2 long, start int, stop int"


def _sorted_groups(places: DataFrame, length: int) -> DataFrame:
    """Spans that the windows of small groups cover, found by suffix order; a row has its group's gram and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held = None, []

        def close(out: list) -> None:
            if len(held) > 1:
                for (k1, k2, first, *_), hit in zip(held, repeated_offsets([h[3:] for h in held], length), strict=True):
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    out += [(k1, k2, first + a, first + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]

        def said(out: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["k1", "k2", "start", "stop"])

        for batch in batches:
            out: list = []
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "k1", "k2", "first", "data", "rel")), strict=True):
                if g != gram:
                    close(out)
                    gram, held = g, []
                held.append((*row, 0))
            yield said(out)
        out = []
        close(out)
        yield said(out)

    return places.repartition("gram").sortWithinPartitions("gram").select("gram", "k1", "k2", "first", "data", "rel").mapInArrow(run, _SPAN)


def _counted_windows(windows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Spans of the windows of large groups whose two hashes occur again."""
    windows = scratch.keep(windows, "windows")
    again = scratch.keep(windows.groupBy("w1", "w2").agg(F.count("*").alias("places")).where("places > 1"), "again")
    return join_dealt(windows, again, ["w1", "w2"], ["k1", "k2", "start"]).select("k1", "k2", "start", (F.col("start") + length).cast("int").alias("stop"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    gram = min(gram, max(1, length // 2))
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), value.alias("text"), F.xxhash64(value).alias("k1"), F.xxhash64(value, F.lit(1)).alias("k2"))
    key = ["k1", "k2"]
    scratch = Scratch(docs.sparkSession)
    index = scratch.keep(rows.select("doc_id", *key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "texts")
    copies = index.groupBy(*key).agg(F.count("*").alias("copies"), F.coalesce(F.min("doc_id"), F.lit(-(1 << 63))).alias("one"))

    anchors = scratch.keep(_anchors(rows, length, gram), "anchors")
    where = F.struct(*key, "place")
    shared = anchors.groupBy("gram").agg(F.min(where).alias("low"), F.max(where).alias("high"), F.count("*").alias("places")).where("low <> high")
    shared = scratch.keep(shared.select("gram", "places", (F.col("places") > group).alias("large")), "grams")
    # the places of one text that need a look, for one of its copies
    asked = join_dealt(may_be_among(anchors, shared, "gram"), shared, ["gram"], [*key, "place"]).groupBy(*key).agg(F.collect_set(F.struct("gram", "place", "first", "last", "large")).alias("asked"))
    asked = asked.join(copies, key).select(F.col("one").alias("id"), *key, "asked")
    texts = scratch.keep(rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(asked, ["id", *key]).select(*key, "text", "asked"), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "k1", "k2", "first", "data", "rel"]
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, data, asked_ in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist(), strict=True):
                out += [(p["gram"], k1, k2, p["first"], data[p["first"] : p["last"] + length], p["place"] - p["first"]) for p in asked_ if not p["large"]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
            for at in range(0, max(1, len(out)), 20_000):
                some = out[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate(kinds)], names=names)

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, data, asked_ in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist(), strict=True):
                ranges = [(p["first"], p["last"] + 1) for p in asked_ if p["large"]]
                if not ranges:
                    continue
                flat = np.frombuffer(data, np.uint8)
                one, two = gram_hashes(flat, length), prime_hashes(flat, length)
                start = np.unique(np.concatenate([np.arange(a, b) for a, b in ranges]))
                k = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(one[start].view(np.int64)), pa.array(two[start].view(np.int64)), pa.array(np.full(k, k1)), pa.array(np.full(k, k2)), pa.array(start.astype(np.int32))], names=["w1", "w2", "k1", "k2", "start"])

    small = _sorted_groups(texts.mapInArrow(cut, "gram long, k1 long, k2 long, first int, data binary, rel int"), length)
    has_large = F.exists("asked", lambda p: p["large"])
    large = _counted_windows(texts.where(has_large).mapInArrow(hash_windows, "w1 long, w2 long, k1 long, k2 long, start int"), length, scratch)
    spans = small.unionByName(large).groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, last, removed, runs = [], 0, 0, 0
                for s in sorted((x["start"], x["stop"]) for x in found):
                    if s[0] > last or not runs:
                        kept.append(data[last : s[0]])
                        runs += 1
                        removed += s[1] - s[0]
                        last = s[1]
                    elif s[1] > last:
                        removed += s[1] - last
                        last = s[1]
                out.append((removed, runs, hashlib.sha256(b"".join([*kept, data[last:]])).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["k1", "k2", "removed", "runs", "kept"])

    edited = texts.select(*key, "text").join(spans, key).mapInArrow(keep, "k1 long, k2 long, removed long, runs long, kept string").dropDuplicates(key)
    facts = copies.join(edited, key, "left")
    result = index.join(facts, key)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    found = result.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
    found = scratch.keep(found, "kept")
    scratch.clear(found)
    return found
