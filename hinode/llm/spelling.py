"""Spelling variants: words one code point apart, found by rolling-hash deletions.

Method: prefix and suffix polynomial hashes of a word give the hash of each of its deletions (the word without one code
point) from two look-ups, for all words of a batch in numpy at once. Two words of one length differ in one code point at
place i if they are equal without it, so they share the key (deletion, i); a word with one more code point shares the
key of a deletion with the other word as a whole. Keys are 64-bit numbers: Spark deals them to partitions and sorts them,
and a scan keeps the rows whose key occurs again. Only these fetch their word, and groups are made of equal deletions as
strings, so a collision of two keys joins nothing.

No pair is ever written: with n the number of members, each member of a group of equal deletions at a place has n - 1
near words, and the best other one is the first or the second by (occurrences, word). A group has at most as many members
as the alphabet has code points (90), or that number for each place of the shorter word.

A word's form is its near word of largest n, if that is `ratio` times its own; the root follows forms to the last one. As n
grows by that factor at each step, the chain is as long as the largest n has digits at most, and pointers are doubled.

Defined results: a null or empty text has no words; a null id counts as an empty text before the colon; repeated rows are
counted as often as they occur; without words there are no rows; further columns are left alone. Texts and words of any
length are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64

#: Fixed by the contract: letters of a run, the divisor that picks runs to damage, shortest word, fewest occurrences.
RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]*")
DAMAGED, SHORTEST, OCCURRENCES, RATIO = 31, 7, 2, 10
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Characters of a text that are split at once, but for the run at the end.
SLICE = 1 << 20
#: Deletions that a batch of keys holds, unless one word has more.
KEYS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, A-Z lower-cased, some at a time."""
    at = 0
    while at < len(text):
        to = LETTERS.match(text, min(at + SLICE, len(text))).end()
        yield RUN.findall(text[at:to].encode().lower().decode())
        at = to


def damaged(word: str, doc_id: str) -> str:
    """The word, or the word without one code point where the crc32 of document and word says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % DAMAGED:
        return word
    return word[: h % len(word)] + word[h % len(word) + 1 :]


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST) -> DataFrame:
    """word, n: how often each word of at least `shortest` code points occurs, after the damage. Tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter[str] = Counter()
                for some in runs(text or ""):
                    own.update(some)
                for word, n in own.items():
                    if len(word) >= shortest:
                        result = damaged(word, key or "")
                        if len(result) >= shortest:
                            held[result] += n
                if len(held) > HELD_WORDS:
                    yield flat(held)
                    held = Counter()
        yield flat(held)

    def flat(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> np.ndarray:
    run = np.full(n + 1, _BASE, np.uint64)
    run[0] = 1
    return np.multiply.accumulate(run)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, place, key) of the words as a whole (place -1), of their deletions that may be another word
    (place -2), and of their deletions at each place i (place i)."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    total = len(codes)
    of = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(total) - starts[of]
    up = _powers(int(sizes.max(initial=0)) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(total + 1, np.uint64)
        # hash of code points c0..ck-1: the sum of c_j * B^j, so a suffix is moved by one place when a code point goes
        np.cumsum(codes * up[place], out=prefix[1:])
        before = prefix[:-1] - prefix[starts][of]
        whole = prefix[starts + sizes] - prefix[starts]
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        after = (whole[of] - before - codes * up[place]) * inverse
        deleted = mix64(before + after)
        size_mark = mix64(sizes.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        shorter_mark = mix64((sizes[of] - 1).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        at_place = mix64(deleted ^ mix64((sizes[of].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) * np.uint64(2)))
        as_whole = mix64(mix64(whole) ^ size_mark)
        as_shorter = mix64(deleted ^ shorter_mark)
    fresh = np.ones(total, bool)  # in a run of equal code points all deletions are the same
    fresh[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    number = np.concatenate((np.arange(len(words)), of[fresh], of))
    where = np.concatenate((np.full(len(words), -1), np.full(int(fresh.sum()), -2), place))
    deleted_at = np.concatenate((np.full(len(words), -1), place[fresh], place))
    keys = np.concatenate((as_whole, as_shorter[fresh], at_place))
    return number, np.stack((where, deleted_at)), keys


def shared_keys(words: DataFrame, bits: int = 64) -> DataFrame:
    """key, id, kind, place: the rows of words (id, word) whose key of so many bits another row has too.

    kind is -1 for a word as a whole, -2 for a deletion that may be a word, 0 for a deletion compared at its place.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(w) for w in texts])
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + KEYS // 2, side="right")))
                number, (kind, place), key = deletion_keys(texts[first:last])
                columns = {
                    "key": pa.array((key >> np.uint64(64 - bits)).view(np.int64)),
                    "id": pa.array(ids[first:last][number]),
                    "kind": pa.array(np.minimum(kind, 0).astype(np.int8), pa.int8()),
                    "place": pa.array(place.astype(np.int32), pa.int32()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                first = last

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of key, those with a neighbour of the same key; the last row waits for the next batch."""
        held, matched, names = None, False, ["key", "id", "kind", "place"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = rows.column(0).to_numpy()
            same = key[1:] == key[:-1]
            left = np.concatenate(([matched], same))
            keep = left[:-1] | same  # all rows but the last, which the next batch may match
            yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep))
            held, matched = rows.slice(rows.num_rows - 1), bool(left[-1])
        if held is not None and matched:
            yield held.select(names)

    schema = "key long, id long, kind tinyint, place int"
    dealt = words.select("id", "word").mapInArrow(keys, schema).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(again, schema)


def near_words(words: DataFrame, bits: int = 64) -> DataFrame:
    """id, n_near, form, form_n of the words (id, word, n) that have near words: how many, and the one of largest n."""
    found = shared_keys(words, bits).join(words, "id")
    deleted = F.concat(F.expr("left(word, place)"), F.expr("substring(word, place + 2)"))
    rows = found.withColumn("rest", F.when(F.col("kind") == -1, F.col("word")).otherwise(deleted))
    # keys that collide fall apart here: by the place, or that it is a whole word's group, and by the string itself
    group = ["key", F.when(F.col("kind") == 0, F.col("place")).otherwise(-1), "rest"]
    best = [F.desc("n"), F.col("word")]
    whole = (F.col("kind") == -1).cast("int")
    ordered, everything = Window.partitionBy(*group).orderBy(whole, *best), Window.partitionBy(*group)
    me = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("form"))
    rows = rows.withColumns(
        {
            "nth": F.row_number().over(ordered),
            "first_one": F.first(me).over(ordered),
            "second_one": F.lead(me).over(ordered),
            "whole_one": F.max(F.when(whole == 1, me)).over(everything),
            "members": F.count("*").over(everything),
        }
    )
    other = (
        F.when(F.col("kind") == 0, F.when(F.col("nth") == 1, F.col("second_one")).otherwise(F.col("first_one")))
        .when(F.col("kind") == -2, F.col("whole_one"))
        .when(F.col("members") > 1, F.col("first_one"))
    )
    others = F.when(F.col("kind") == -2, 1).otherwise(F.col("members") - 1)
    linked = rows.withColumn("other", other).where("other IS NOT NULL").select("id", "other", others.alias("others"))
    summed = linked.groupBy("id").agg(F.sum("others").alias("n_near"), F.min("other").alias("other"))
    return summed.select("id", "n_near", F.col("other.form").alias("form"), (-F.col("other.minus_n")).alias("form_n"))


def follow_forms(forms: DataFrame, scratch: Scratch, most: int, ratio: int = RATIO) -> DataFrame:
    """word, root of the words that have a form: rows (word, form). Each round doubles the steps that are done."""
    if ratio < 2:
        raise ValueError("forms end only if each is more frequent by a factor")
    steps = 1
    while ratio ** (steps + 1) <= most:
        steps += 1
    found, done = forms.select("word", F.col("form").alias("root")), 1
    while done < steps:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next_root"))
        joined = found.join(onward, "root", "left")
        found, done = scratch.keep(joined.select("word", F.coalesce("next_root", "root").alias("root")), "roots"), 2 * done
    return found


def group_spellings(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shortest: int = SHORTEST,
    occurrences: int = OCCURRENCES,
    ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word with at least `occurrences` occurrences."""
    scratch = Scratch(docs.sparkSession)
    counted = count_words(docs, text, doc_id, shortest).where(F.col("n") >= occurrences)
    words = scratch.keep(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words)
    strong = F.col("form_n") >= ratio * F.col("n")
    rows = words.join(near, "id", "left").select(
        "word",
        F.when(strong, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("form_n")).alias("form_n"),
    )
    rows = scratch.keep(rows, "spellings")
    scratch.drop(words)
    most = rows.agg(F.max("n")).first()[0] or 0
    roots = follow_forms(rows.where("form IS NOT NULL"), scratch, most, ratio)
    out = rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return out
