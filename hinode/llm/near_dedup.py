"""MinHash near-duplicates with odd sketches.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set is its distinct runs of five words, or its whole
word sequence where it has fewer. Documents are linked when 100 * intersection >= 85 * union of their sets.

1. Documents with equal sets are one node, so copies cost nothing further.
2. BANDS bands of ROWS min-hashes give candidates: a linked pair shares no band with probability
   (1 - 0.85^5)^24 < 1e-6; at a share of 80 it is under 1e-4.
3. Each node has an odd sketch: its min-hash samples (the least hash in each of SAMPLES bins) are folded into a bitmap of
   parities. The population count of two sketches' XOR estimates the symmetric difference of the samples, and so the
   similarity, closely where it is high. What passes, less a margin of five deviations, is confirmed on the full sets.
4. In a first round the members of a band's bucket are compared with one of them, its hub, alone, so a group of n near
   copies costs n comparisons and not n^2. Confirmed links are contracted to components, and only buckets whose members
   are of more than one component go on. What is left of them is compared in blocks of bounded size, every two members
   whose components differ: in a second round each brings its most alike partner, and in a last one every likely pair
   whose components still differ, so no link that could join two components stays unchecked.

Nodes are named by a hash of their sets and never by doc_id, which may be null or repeated; a component is given its
least doc_id at the end.

Defined results: texts without words, and null texts, have the empty set and are linked with nothing. Rows that repeat
one doc_id are linked by their texts alone. A null doc_id takes part, but names a component only if all its rows are such
(component_id is then null, kept is false). Ties need no rule: the component is the least doc_id. An empty table gives no
rows; columns other than the two named ones are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, frequent_keys, may_be_among, mix64, shingle_hashes, text_bytes, word_hashes
from .graph import connected_components

SHINGLE = 5
#: Linked when 100 * intersection >= SHARE * union, unless the caller gives another share.
SHARE = 85
BANDS, ROWS = 24, 5
#: Min-hash samples of a sketch, and its bits.
SAMPLES = BITS = 1024
ROUNDS = ("hub", "best", "all")
#: Members of a band's bucket that the later rounds compare in one go; larger buckets are dealt in blocks of this size.
BLOCK = 4096
#: Pairs of a block that are held at once.
PAIRS = 1 << 18
#: Pairs of one node that meet its sketch in one task; a node with more is dealt over several keys.
SPREAD = 1024
#: Shingles of the full sets of a block that are held at once to confirm its pairs; a block with more is dealt in tiles.
SET_SHINGLES = 1_000_000
#: A hub's members are confirmed in a group for each so many shingles of theirs, SPREAD at most in each.
TILE_SHINGLES = 1000

_FACTORS = mix64(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_NO_ID = (1 << 63) - 1
_SIGNATURES = "id long, text_id long, node long, n_shingles long, bands array<long>, filled int, sketch binary"


def odd_sketch(distinct: np.ndarray) -> tuple[int, bytes]:
    """(samples, bitmap) of a sorted set of hashes: of each bin, given by the top bits, the least hash flips a bit."""
    bins = distinct >> np.uint64(54)
    first = np.ones(len(distinct), bool)
    first[1:] = bins[1:] != bins[:-1]
    at = mix64(distinct[first] + np.uint64(77)) & np.uint64(BITS - 1)
    parity = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return int(first.sum()), np.packbits(parity.astype(np.uint8)).tobytes()


def estimate(size_a: np.ndarray, size_b: np.ndarray, filled_a: np.ndarray, filled_b: np.ndarray, odd: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Similarity of two sets from their sizes, their numbers of samples and the population count of their sketches' XOR.

    Of the bins that either set fills, the share whose samples agree is the similarity. The number that agree is half of
    what the samples' symmetric difference leaves; the number filled follows from the larger count of samples.
    """
    d = -BITS / 2 * np.log(np.maximum(1 - 2 * odd / BITS, 1e-9))
    union, largest = (size_a + size_b) / (1 + share / 100), np.maximum(size_a, size_b)
    grow = (1 - np.exp(-np.maximum(union, largest) / SAMPLES)) / (1 - np.exp(-largest / SAMPLES))
    return np.clip((filled_a + filled_b - d) / 2 / (np.maximum(filled_a, filled_b) * grow), 0, 1)


def margin(filled: np.ndarray, share: int = SHARE) -> np.ndarray:
    """How far below the threshold an estimate may lie and still be checked: five of its deviations at least.

    The deviation of a sketch's estimate grows with the samples that differ at the threshold, as exp(8 (1 - share)) - 1.
    """
    wider = np.sqrt(np.expm1(8 * (1 - share / 100)) / np.expm1(8 * (1 - SHARE / 100)))
    return np.maximum(0.055 + np.maximum(filled - 600, 0) * 5e-5, 1.2 / filled) * np.maximum(wider, 1)


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The id, the text's hash, the node that names the set, the set's size, its bands and its odd sketch for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in chunks(offsets):
                words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                runs, n = shingle_hashes(words, counts, SHINGLE)
                ends = np.cumsum(n)
                some = np.flatnonzero(n)
                bands = np.zeros((b - a, BANDS), np.uint64)
                for band in range(BANDS if len(some) else 0):
                    made = np.full(len(some), np.uint64(band + 1))
                    for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                        made = mix64(made ^ np.minimum.reduceat(runs * f, (ends - n)[some]))
                    bands[some, band] = made
                size, s1, s2, filled, sketch = [], [], [], [], []
                for start, end in zip((ends - n).tolist(), ends.tolist(), strict=True):
                    distinct = np.unique(runs[start:end])
                    size.append(len(distinct))
                    s1.append(mix64(distinct).sum(dtype=np.uint64))
                    s2.append(mix64(distinct + np.uint64(12345)).sum(dtype=np.uint64))
                    k, bitmap = odd_sketch(distinct)
                    filled.append(k)
                    sketch.append(bitmap)
                node = mix64(np.array(s1, np.uint64) ^ mix64(np.array(s2, np.uint64) + np.array(size, np.uint64)))
                signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
                listed = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(signed(node)), pa.array(size, pa.int64()), listed, pa.array(filled, pa.int32()), pa.array(sketch, pa.binary())],
                    names=[c.split()[0] for c in _SIGNATURES.split(", ")],
                )

    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text")).mapInArrow(run, _SIGNATURES)


def _members(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, band and id of the nodes that share a band's bucket with another node."""
    every = nodes.select(F.posexplode("bands").alias("band", "bucket"), "id")
    shared = scratch.keep(every.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket"), "buckets")
    members = scratch.keep(may_be_among(every, shared, "bucket").join(shared, "bucket"), "members")
    scratch.drop(shared)
    return members


def _live(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with their own component and the bucket's hub."""
    now = members.select("bucket", "band", "id").join(labels, "id")
    hub = F.min_by(F.struct("id", "component"), F.xxhash64("id"))
    buckets = now.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), hub.alias("hub"))
    return now.join(buckets.where("low <> high").select("bucket", "members", "hub"), "bucket")


def _with_facts(pairs: DataFrame, side: str, facts: DataFrame, heavy: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) with what facts (id, ..) say of one side, as {name}_{side}, and the part_{side} that the pair is in."""
    other, part = "b" if side == "a" else "a", f"part_{side}"
    dealt = pairs.join(heavy, side, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    named = facts.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in facts.columns if c != "id"])
    named = named.join(heavy, side, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(named, [side, part])


_PACKED = "g long, id long, partners array<long>"


def _packed(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs to confirm in groups g: a row without partners for each node that a group needs, and one for each of its
    nodes a with all partners, so rows grow with the nodes and not with the pairs."""
    ends = np.unique(np.stack((np.concatenate((g, g)), np.concatenate((a, b)))), axis=1)
    order = np.lexsort((b, a, g))
    g, a, b = g[order], a[order], b[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (a[1:] != a[:-1]))))
    none = ends.shape[1]
    offsets = np.concatenate((np.full(none, None), head, [len(b)]))
    partners = pa.ListArray.from_arrays(pa.array(offsets.tolist(), pa.int32()), pa.array(b))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((ends[0], g[head]))), pa.array(np.concatenate((ends[1], a[head]))), partners], names=["g", "id", "partners"])


def _passing(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """The stored pairs a, b whose sizes and sketches allow a link, with the group g in which they are confirmed: some of
    the members of a hub a, the fewer the longer they are."""
    total = pairs.count()
    both = pairs
    for side in "ba":
        counts = pairs.groupBy(side).agg(F.count("*").alias("places"))
        both = _with_facts(both, side, nodes.select("id", "n_shingles", "filled", "sketch"), frequent_keys(counts, [side], total, SPREAD))
    size = [F.col(f"n_shingles_{s}") for s in "ab"]
    tile = F.pmod(F.xxhash64("b"), F.ceil(F.col("n_shingles_b") / TILE_SHINGLES))
    both = both.where(100 * F.least(*size) >= share * F.greatest(*size)).withColumn("g", F.xxhash64("a", "part_a", tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy()
            one, two = (np.frombuffer(b"".join(batch.column(f"sketch_{s}").to_pylist()), np.uint64).reshape(batch.num_rows, -1) for s in "ab")
            odd = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            _, ok = likely(get("n_shingles_a"), get("n_shingles_b"), get("filled_a"), get("filled_b"), odd, share)
            yield _packed(*(get(c)[ok] for c in ("g", "a", "b")))

    return both.select("g", "a", "b", *[f"{c}_{s}" for c in ("n_shingles", "filled", "sketch") for s in "ab"]).mapInArrow(run, _PACKED)


def likely(size_a: np.ndarray, size_b: np.ndarray, filled_a: np.ndarray, filled_b: np.ndarray, odd: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The estimate, and whether it is not too far below the threshold."""
    guess = estimate(size_a, size_b, filled_a, filled_b, odd, share)
    return guess, guess >= share / 100 - margin(np.minimum(filled_a, filled_b), share)


def _hub_pairs(live: DataFrame) -> DataFrame:
    """Every live member of another component than its bucket's hub, with the hub."""
    return live.where("component <> hub.component").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()


def _compare(rows: dict[str, np.ndarray], share: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that are likely by size and sketch, differ in component and have no earlier band in common: all,
    or the best one of each member outside of the largest component."""
    size, filled, sketch, part, short = rows["n_shingles"], rows["filled"], rows["sketch"], rows["component"], rows["short"]
    cross = rows["i"][0] != rows["j"][0]
    left = np.flatnonzero(rows["own"] == rows["i"][0])
    right = np.flatnonzero(rows["own"] == rows["j"][0])
    names, counts = np.unique(part, return_counts=True)
    minor = part != names[counts.argmax()]
    # within the largest component nothing is open, so one side of a pair is always outside of it
    todo = [(left[minor[left]], right)] + ([(right[minor[right]], left[~minor[left]])] if cross else [])
    out = [np.zeros((2, 0), np.int64)]
    for one, two in todo:
        tile = max(1, PAIRS // max(1, len(two)))
        for at in range(0, len(one), tile):
            a = one[at : at + tile]
            big, small = np.maximum(size[a][:, None], size[two]), np.minimum(size[a][:, None], size[two])
            ok = (100 * small >= share * big) & (part[a][:, None] != part[two])
            if not cross and not best:  # both sides outside of the largest: once is enough
                ok &= ~minor[two] | (a[:, None] < two)
            x, y = np.nonzero(ok)
            p, q = a[x], two[y]
            odd = np.zeros(len(p), np.int64)
            for w in range(sketch.shape[1]):
                odd += np.bitwise_count(sketch[p, w] ^ sketch[q, w])
            guess, passed = likely(size[p], size[q], filled[p], filled[q], odd, share)
            p, q, guess = p[passed], q[passed], guess[passed]
            first = (short[p] == short[q]).argmax(axis=1) == rows["band"][0]
            p, q, guess = p[first], q[first], guess[first]
            if best:
                order = np.lexsort((q, -guess, p))
                p, q = p[order], q[order]
                lead = np.concatenate((np.ones(min(1, len(p)), bool), p[1:] != p[:-1]))
                p, q = p[lead], q[lead]
            out.append(np.stack((p, q)))
    found = np.concatenate(out, axis=1)
    return found[0], found[1]


def _block_pairs(live: DataFrame, nodes: DataFrame, share: int, best: bool) -> DataFrame:
    """Pairs of live members of one bucket that are likely and differ in component (see _compare), packed for the groups
    g, of bounded size, in which they are confirmed."""
    dealt = live.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group, names = ["bucket", "i", "j"], ["own", "band", "id", "component", "n_shingles", "filled"]
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "id", "component")
    facts = nodes.select("id", "n_shingles", "filled", "sketch", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("short"))
    rows = dealt.join(facts, "id").repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(table: pa.Table) -> pa.RecordBatch:
            flat = {k: table.column(k).to_numpy() for k in [*group, *names]}
            flat["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(table), -1)
            flat["short"] = table.column("short").combine_chunks().flatten().to_numpy().reshape(len(table), BANDS)
            edge = np.flatnonzero(np.any([flat[k][1:] != flat[k][:-1] for k in group], axis=0)) + 1
            left, right, where = ([np.zeros(0, np.int64)] for _ in range(3))
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(table)], strict=True):
                if e - s > 1:
                    some = {k: v[s:e] for k, v in flat.items()}
                    p, q = _compare(some, share, best)
                    x, y = np.minimum(some["id"][p], some["id"][q]), np.maximum(some["id"][p], some["id"][q])
                    tiles = np.uint64(max(1, -(-int(some["n_shingles"].sum()) // SET_SHINGLES)))
                    at = [mix64(v.view(np.uint64)) % tiles for v in (x, y)]
                    left.append(x)
                    right.append(y)
                    where.append(mix64(mix64(some["bucket"][p].view(np.uint64) + np.minimum(*at)) + np.maximum(*at)).view(np.int64))
            return _packed(*(np.concatenate(v) for v in (where, left, right)))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in group])
            edge = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0))
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in group):
                yield close(pa.Table.from_batches(held))
                held = []
            if len(edge):  # all but the last group are whole
                cut = int(edge[-1]) + 1
                yield close(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield close(pa.Table.from_batches(held))

    return rows.select(*group, *names, "sketch", "short").mapInArrow(run, _PACKED)


def _confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The packed pairs whose full sets are similar enough. A set is sent once to each group that needs it and not once
    a pair, so what is sent grows with the nodes of a group of near misses and not with its pairs."""
    ends = pairs.where("partners IS NULL").select("g", "id").distinct().join(sets, "id")
    none = F.lit(None).cast("array<long>")
    rows = ends.select("g", F.lit(0).alias("kind"), "id", none.alias("partners"), "shingles").unionByName(pairs.where("partners IS NOT NULL").select("g", F.lit(1).alias("kind"), "id", "partners", none.alias("shingles")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            found = []
            sets = batch.column("shingles")
            values, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
            for k, (g, kind, one, partners) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "kind", "id", "partners")), strict=True)):
                if g != group:
                    group, held = g, {}
                if kind == 0:
                    held[one] = values[offsets[k] : offsets[k + 1]].copy()
                    continue
                x = held[one]
                for two in partners:
                    y = held[two]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= share * (len(x) + len(y) - both):
                        found.append((one, two))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return rows.repartition("g").sortWithinPartitions("g", "kind").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """id and the distinct shingles of the wanted nodes (id, text_id), each from one text that has its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                runs, n = shingle_hashes(words, counts, SHINGLE)
                sets = [np.unique(s).view(np.int64) for s in np.split(runs, np.cumsum(n)[:-1])]
                listed = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed], names=["id", "shingles"])

    # only texts that are wanted are shuffled, and copies meet before the shuffle, so one that many rows have is sent once a task
    texts = may_be_among(docs.select(F.xxhash64(text).alias("text_id"), F.col(text).alias("text")), wanted, "text_id")
    texts = texts.groupBy("text_id").agg(F.max("text").alias("text")).join(wanted, "text_id")
    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _components(docs: DataFrame, text: str, doc_id: str, share: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows' signatures, and (id, lead, component) of the nodes; lead is the least (doc_id, text_id) of a node's rows."""
    rows = scratch.keep(signatures(docs, text, doc_id), "signatures")
    best = F.min(F.struct("id", "text_id")).alias("lead")
    nodes = rows.where("n_shingles > 0").groupBy(F.col("node").alias("id")).agg(best, *[F.any_value(c).alias(c) for c in ("n_shingles", "bands", "filled", "sketch")])
    nodes = scratch.keep(nodes, "nodes")
    members = _members(nodes, scratch)
    labels = scratch.keep(members.select("id").distinct().withColumn("component", F.col("id")), "labels")
    for kind in ROUNDS:
        live = scratch.keep(_live(members, labels), "live")
        scratch.drop(members)
        members = live
        if live.isEmpty():
            break
        if kind == "hub":
            hubs = scratch.keep(_hub_pairs(live), "hubs")
            pairs = scratch.keep(_passing(hubs, nodes, share), "pairs")
            scratch.drop(hubs)
        else:
            pairs = scratch.keep(_block_pairs(live, nodes, share, kind == "best"), "pairs")
        ids = pairs.where("partners IS NULL").select("id").distinct()
        wanted = scratch.keep(nodes.select("id", "lead.text_id").join(ids, "id", "left_semi"), "wanted")
        sets = scratch.keep(_full_sets(docs, wanted, text), "sets")
        links = scratch.keep(_confirm(pairs, sets, share), "links")
        if not links.isEmpty():
            of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))  # noqa: E731, B023
            between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
            over = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("larger"))
            joined = scratch.keep(labels.join(over, "component", "left").select("id", F.coalesce("larger", "component").alias("component")), "labels")
            scratch.drop(labels)
            labels = joined
        scratch.drop(pairs, wanted, sets, links)
    return rows, nodes.select("id", "lead").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    scratch = Scratch(docs.sparkSession)
    rows, nodes = _components(docs, text, doc_id, share, scratch)
    least = nodes.groupBy("component").agg(F.min("lead.id").alias("least"))
    named = nodes.join(least, "component").select(F.col("id").alias("node"), "least")
    result = rows.select("id", "node", "n_shingles").join(named, "node", "left")
    real = lambda c: F.when(c != _NO_ID, c)
    key, component = real(F.col("id")), real(F.coalesce("least", "id"))
    found = scratch.keep(result.select(key.alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(key == component, F.lit(False)).alias("kept")), "near")
    scratch.clear(found)
    return found


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: int = SHARE) -> DataFrame:
    """One row of each component, that of the least doc_id, null ids last, and all rows without words.

    Rows are told apart by their texts: a null or repeated doc_id neither links rows nor drops any.
    """
    scratch = Scratch(docs.sparkSession)
    _, nodes = _components(docs, text, doc_id, share, scratch)
    leads = scratch.keep(nodes.groupBy("component").agg(F.min("lead").alias("lead")).select("lead.text_id"), "leads")
    scratch.clear(leads)
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # equal texts meet before the shuffle, so no task gets all copies
    least = F.min(F.struct(F.col(doc_id).isNull().alias("last"), F.struct(doc_id, *[c for c in docs.columns if c != doc_id]).alias("row")))
    first = docs.where(worded).groupBy(F.xxhash64(text).alias("text_id")).agg(least.alias("least"))
    chosen = first.join(leads, "text_id", "left_semi").select("least.row.*").select(*docs.columns)
    return chosen.unionByName(docs.where(~worded))
