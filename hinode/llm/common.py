"""What the corpus operators share: tables, shared storage, Arrow text batches and word hashes.

Texts stay UTF-8 bytes inside tasks. The word helpers work on flat numpy arrays over a bounded chunk of
documents, so memory follows the chunk and not the partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


#: Rows of an Arrow batch, so that a batch of long texts stays a few MB.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a local master gets a temporary one of its own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hinode-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables that an operator writes to the shared folder while it works, and deletes once it no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back: cuts the lineage, survives lost executors, computes once."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = (read, path)
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables of its own."""
        for table in tables:
            _, path = self.paths.pop(id(table))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self, *but: DataFrame) -> None:
        """Deletes all tables that are left but these, which the result still reads."""
        self.drop(*[t for t, _ in list(self.paths.values()) if all(t is not b for b in but)])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder that outlives the operator, as its lazy result reads it."""
    return Scratch(df.sparkSession).keep(df, name)


#: Bits of a key filter for each key, and the most bits that one has: 32 MB to broadcast.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28


def may_be_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` (a long) is among those of keys, and a few others: a filter before a shuffle of wide rows.

    The keys are hashed to places of a bitmap of bounded size, which is broadcast. With so many keys that it fills up,
    it keeps all rows and the join that follows does the whole work.
    """
    n = keys.count()
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << (FILTER_BITS * n).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    made = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("filter_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("filter_bits"))
    with_place = rows.withColumn("filter_place", place)
    at = F.bitmap_bit_position("filter_place")
    byte = F.conv(F.hex(F.substring("filter_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = with_place.join(F.broadcast(made), F.bitmap_bucket_number("filter_place") == F.col("filter_no"))  # at most MOST_FILTER_BITS
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


#: Rows of one key that meet it in one task; a key with more is dealt over several.
KEY_ROWS = 20_000
#: The most keys that are treated as frequent: only so many can have more than this share of all rows.
FREQUENT_KEYS = 100_000


def frequent_keys(keys: DataFrame, on: list[str], total: int, rows: int = KEY_ROWS) -> DataFrame:
    """The keys with more than `rows` of `total` rows (column places), and in how many parts to deal them; at most
    FREQUENT_KEYS, so they may be broadcast."""
    most = max(rows, total // FREQUENT_KEYS)
    return F.broadcast(keys.where(F.col("places") > most).select(*on, F.ceil(F.col("places") / most).cast("int").alias("parts")))


def join_dealt(rows: DataFrame, keys: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """rows joined with keys, a stored table with one row for each value of `on` and `places`, how many rows have it. The
    rows of a frequent key are dealt by a hash of `by`, so that none has to be in one task whole."""
    heavy = frequent_keys(keys, on, keys.agg(F.sum("places")).first()[0] or 0, KEY_ROWS)
    dealt = rows.join(heavy, on, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    wide = keys.join(heavy, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("places", "parts")
    return dealt.join(wide, [*on, "part"]).drop("part")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[starts[0] : starts[-1]], starts - starts[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of at most `most` bytes; one longer document makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Value of each byte after A-Z became a-z.
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2^64."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(CHUNK_BYTES, 1 << int(n).bit_length()) + 1
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _powers[key] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of some documents, and each document's word count.

    A prefix polynomial over the chunk gives the hash of every word from its two ends.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * up[: len(data)], out=prefix[1:])
    words = mix64((prefix[to] - prefix[at]) * down[at])
    return words, np.diff(np.searchsorted(at, offsets))


_PLACE = mix64(np.arange(101, 133, dtype=np.uint64) * np.uint64(_BASE))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words in each document and their count; fewer words make one run, none make none."""
    total = len(words)
    starts = np.concatenate(([0], np.cumsum(counts)))
    n_runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    if not total:
        return np.zeros(0, np.uint64), n_runs
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    runs = np.zeros(total, np.uint64)
    for j in range(size):
        runs += padded[j : j + total] * _PLACE[j]
    for doc in np.flatnonzero((counts > 0) & (counts < size)):
        a, k = starts[doc], counts[doc]
        runs[a] = np.append(words[a : a + k] * _PLACE[:k], _PLACE[30:31] * np.uint64(k)).sum(dtype=np.uint64)
    place = np.arange(total) - np.repeat(starts[:-1], counts)
    return mix64(runs[place < np.repeat(n_runs, counts)]), n_runs


def crc_mod(column: str, parts: int = 5) -> F.Column:
    """crc32 of the id as text, modulo `parts`; 0 marks the held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


#: Bytes of a text up to which it may be in a sample that a model is fitted on.
SAMPLE_TEXT_BYTES = 1 << 17


def bounded_sample(rows: DataFrame, label: str, counts: dict, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """label, order, id and text of at most `most` rows of each label: those of the least hash of key and text, each once.

    counts: rows of each label. Rows that repeat count once, however many there are, and texts of more than
    SAMPLE_TEXT_BYTES take no part, so what comes out is bounded in rows and bytes for any table.
    """
    order = F.xxhash64(F.col(key).cast("string"), text)
    chance = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    parts = []
    for value, n in sorted(counts.items()):
        some = rows.where((F.col(label) == F.lit(value)) & (F.octet_length(text) <= SAMPLE_TEXT_BYTES))
        some = some.where(chance < min(1.0, 2 * most / max(1, n)))
        once = some.select(label, order.alias("order"), F.col(key).alias("id"), F.col(text).alias("text"))
        once = once.groupBy(label, "order").agg(F.min("id").alias("id"), F.min("text").alias("text"))
        parts.append(once.orderBy("order").limit(most))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
