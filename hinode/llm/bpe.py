"""Byte-level BPE encoding and decoding by recursive queries of DuckDB in each partition.

Method: a text is split by the tokenizer's pattern into words, each encoded by itself. The words that a task doesn't know
yet become token-position rows of a DuckDB table, one row a byte at first. A recursive query joins neighbouring rows with
the merge table (every way to write a token as two tokens, with its rank) and contracts each word's leftmost pair of
minimum rank, until no word has a pair left. Decoding joins token-position rows with the vocabulary and aggregates their
bytes in order of position.

A contraction a turn makes a word of n bytes cost n turns, so words of more than LONG bytes are encoded in windows, which
are then stitched: a sequence of tokens is the encoding of a word if and only if every two neighbours, encoded together,
give just these two. (In the word's own order of contractions, the first one to cross a boundary between two tokens would
be the first to cross it in the two alone, too.) Where neighbours aren't the encoding of their bytes, the tokens around
are encoded again together, ever more of them, until all fit. Both the windows and the neighbours go through the same
recursive query, and the result is exact for any ranks.

A piece that is a token as a whole is that token, without contractions.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded as often as they
occur; a null id is carried through; an empty table gives no rows; further columns are left alone. Texts are encoded
whole, blocks of words at a time. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that a task looks up at once.
ROWS = 2000
#: Words whose ids a task remembers; the rest are encoded again when they come up again.
MEMO_WORDS = 250_000
#: Words of a text that are looked up at once, and tokens that are decoded at once.
BLOCK = 1 << 18
#: Bytes up to which a word is contracted in one go, and bytes of the windows that a longer one is cut into.
LONG, WINDOW = 64, 32
#: Bytes of unknown words that one recursive query takes.
QUERY_BYTES = 1 << 19

#: Bytes of a block of a long run whose tokens depend on where it starts, and tokens at its end that the next one redoes.
BLOCK_BYTES, REACH = 1 << 12, 16

#: Each turn the tokens of each word become rows with their position, meet the merge table, and the leftmost pair of lowest
#: rank is contracted; a word without a pair is done. `top` is the highest rank on the way.
LEFTMOST = """
WITH RECURSIVE state(word, ids, top, done) AS (
  SELECT word, ids, -1, false FROM given
  UNION ALL
  SELECT state.word,
    CASE WHEN best IS NULL THEN ids
      ELSE ids[:best % 4294967296 - 1] || [CAST(best // 4294967296 AS INTEGER)] || ids[best % 4294967296 + 2:] END,
    greatest(top, CAST(best // 4294967296 AS INTEGER)), best IS NULL
  FROM state LEFT JOIN (
    SELECT word, min(made * 4294967296 + place) AS best
    FROM (
      SELECT word, place, ids[place] AS first_id, ids[place + 1] AS second_id
      FROM (SELECT word, ids, unnest(range(1, len(ids))) AS place FROM state WHERE NOT done)
    ) JOIN merges USING (first_id, second_id)
    GROUP BY word
  ) lowest USING (word)
  WHERE NOT done
)
"""
#: Rows of the words that still have a pair, with the pair to their right and the lowest rank of their word.
PAIRS = """
  SELECT near.*, merges.made, min(merges.made * 4294967296 + place) OVER (PARTITION BY near.word) AS best
  FROM (
    SELECT turn, word, place, id, lead(id) OVER here AS next_id, lag(place) OVER here AS last_place
    FROM state WINDOW here AS (PARTITION BY word ORDER BY place)
  ) near LEFT JOIN merges ON merges.first_id = near.id AND merges.second_id = near.next_id
"""
#: Each turn contracts all pairs of the lowest rank of each word; of those that overlap, every other one from the left.
ALL_LOWEST = f"""
WITH RECURSIVE state(turn, word, place, id) AS (
  SELECT 0, word, place, id FROM (SELECT word, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM given)
  UNION ALL
  SELECT turn + 1, word, place, CASE WHEN taken THEN made ELSE id END
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY place) AS eaten
    FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY word, hit, island ORDER BY place) % 2 = 1 AS taken
      FROM (
        SELECT *, nth - row_number() OVER (PARTITION BY word, hit ORDER BY place) AS island
        FROM (
          SELECT *, coalesce(made = best // 4294967296, false) AS hit,
            row_number() OVER (PARTITION BY word ORDER BY place) AS nth
          FROM ({PAIRS}) WHERE best IS NOT NULL
        )
      )
    )
  )
  WHERE NOT eaten
)
"""
#: The words' tokens, in order of word.
TOKENS = {
    LEFTMOST: "SELECT ids FROM state WHERE done ORDER BY word",
    ALL_LOWEST: """
SELECT list(id ORDER BY place) AS ids FROM (SELECT *, max(turn) OVER (PARTITION BY word) AS last_turn FROM state)
WHERE turn = last_turn GROUP BY word ORDER BY word
""",
}
#: Whether each word that ends as one token never had a token of a higher rank on its way.
RISING = "SELECT coalesce(bool_and(top = ids[1]), true) FROM state WHERE done AND len(ids) = 1 AND top >= 0"


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a file of ranks: lines of base64 and number."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


#: Fixed classes of the pattern, each with a character that no literal of a pattern names.
CLASSES = {r"\p{L}": "\u0436", r"\p{N}": "\u0663", r"\s": "\u2003"}
#: A character of none of these classes.
OTHER = "\u2603"


def _odd_characters() -> dict[int, str]:
    """Characters whose class differs between the splitting library's Unicode tables and tiktoken's, with a stand-in of
    the class that tiktoken gives them."""
    import regex
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    one_byte = {bytes([b]): b for b in range(256)}
    odd: dict[int, str] = {}
    for name, stand_in in CLASSES.items():
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=one_byte, special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        odd |= {ord(c): OTHER for c in ours - theirs if ord(c) not in odd} | {ord(c): stand_in for c in theirs - ours}
    return odd


class Vocabulary:
    """Decoder of one file of ranks, with a DuckDB connection of its own."""

    _known: dict[tuple, Vocabulary] = {}

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        ids = sorted(self.ranks.items(), key=lambda x: x[1])
        self.sizes = np.zeros(ids[-1][1] + 1, np.int64)
        self.sizes[[i for _, i in ids]] = [len(t) for t, _ in ids]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        places = np.array([i for _, i in ids], np.int32)
        self._fill("vocabulary", {"id": places, "chars": [t.decode("latin-1") for t, _ in ids]})

    def _fill(self, name: str, columns: dict) -> None:
        self.db.register("rows", pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM rows")
        self.db.unregister("rows")

    @classmethod
    def of(cls, *made_of: str):
        """The process's own one of these parameters, with what it remembers from earlier tasks."""
        if (cls, *made_of) not in cls._known:
            cls._known[cls, *made_of] = cls(*made_of)
        return cls._known[cls, *made_of]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id that isn't a token's fails."""
        out = []
        for at in range(0, len(ids), 4 * BLOCK):
            out += self.decode_many([np.frombuffer(ids[at : at + 4 * BLOCK], "<u4").astype(np.int64)])
        return b"".join(out)

    def decode_many(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids by one ordered aggregation."""
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        if len(flat) and (flat.max() >= len(self.sizes) or not self.sizes[flat].all()):
            raise ValueError("an id stands for no token")
        rows = {"text": np.repeat(np.arange(len(lists)), sizes), "place": np.arange(len(flat)), "id": flat}
        self.db.register("placed", pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()}))
        found = self.db.execute(
            "SELECT text, string_agg(chars, '' ORDER BY place) FROM placed JOIN vocabulary USING (id) GROUP BY text"
        ).fetchall()
        self.db.unregister("placed")
        out = [b""] * len(lists)
        for n, chars in found:
            out[n] = chars.encode("latin-1")
        return out


class BytePairs(Vocabulary):
    """Encoder of one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__(path)
        self.split = regex.compile(pattern)
        self.odd = _odd_characters()
        self.odd_characters = set(map(chr, self.odd))
        self._blocks_by: str | None = None
        self.memo: dict[str, bytes] = {}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        splits = ((get(t[:k]), get(t[k:]), i) for t, i in self.ranks.items() for k in range(1, len(t)))
        merges = np.array([x for x in splits if x[0] is not None and x[1] is not None], np.int32).reshape(-1, 3)
        made = {"first_id": merges[:, 0], "second_id": merges[:, 1], "made": merges[:, 2].astype(np.int64)}
        self._fill("merges", made)

    def contract(self, words: list[bytes], sql: str = LEFTMOST) -> list[list[int]]:
        """The tokens of each word by contractions alone; equal words run once."""
        return [np.frombuffer(ids, "<u4").tolist() for ids in self._contract(words, sql)]

    def _contract(self, words: list[bytes], sql: str = LEFTMOST) -> list[bytes]:
        own = list(dict.fromkeys(words))
        ends = np.cumsum([len(w) for w in own])
        found: dict[bytes, bytes] = {}
        first = 0
        while first < len(own):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + QUERY_BYTES, side="right")))
            found |= zip(own[first:last], self._query(own[first:last], sql), strict=True)
            first = last
        return [found[w] for w in words]

    def _give(self, words: list[bytes]) -> None:
        """The words with their bytes as tokens."""
        to = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ids = pa.ListArray.from_arrays(pa.array(to), pa.array(flat))
        self._fill("given", {"word": np.arange(len(words), dtype=np.int32), "ids": ids})

    def _query(self, words: list[bytes], sql: str) -> list[bytes]:
        self._give(words)
        lists = self.db.sql(sql + TOKENS[sql]).to_arrow_table().column(0).combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
        return [flat[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]

    def _for_blocks(self) -> str:
        """The query for blocks. If no token is made by way of one of higher rank, then contracting a pair of the lowest rank
        never gives a pair of a lower one, so all pairs of that rank can go in one turn; else the leftmost goes alone."""
        if self._blocks_by is None:
            tokens, rising = list(self.ranks), True
            for at in range(0, len(tokens), 1 << 14):
                self._give(tokens[at : at + (1 << 14)])
                rising &= self.db.execute(LEFTMOST + RISING).fetchall()[0][0]
            self._blocks_by = ALL_LOWEST if rising else LEFTMOST
        return self._blocks_by

    def _chain(self, words: list[bytes], size: int) -> list[list[int]]:
        """Tokens of long words from the left, `size` bytes a query, each block starting where a token of the last began."""
        sql = self._for_blocks()
        out: list[list[int]] = [[] for _ in words]
        at = [0] * len(words)
        while going := [k for k, w in enumerate(words) if at[k] < len(w)]:
            for k, got in zip(going, self.contract([words[k][at[k] : at[k] + size] for k in going], sql), strict=True):
                if at[k] + size < len(words[k]) and len(got) > 2 * REACH:
                    got = got[:-REACH]
                out[k] += got
                at[k] += int(self.sizes[got].sum())
        return out

    def _stitch(self, word: bytes) -> list[int]:
        """The tokens of one long word, from windows that are encoded again around the joints until all neighbours fit."""
        ids = [i for w in self.contract([word[k : k + WINDOW] for k in range(0, len(word), WINDOW)]) for i in w]
        known: set[tuple[int, int]] = set()
        reach = 1
        while True:
            pairs = list({p for p in itertools.pairwise(ids)} - known)
            joined = self.contract([self.tokens[a] + self.tokens[b] for a, b in pairs])
            known |= {p for p, got in zip(pairs, joined, strict=True) if got == list(p)}
            bad = [k for k, p in enumerate(itertools.pairwise(ids)) if p not in known]
            if not bad:
                return ids
            spans: list[list[int]] = []
            for k in bad:
                low, high = max(0, k + 1 - reach), min(len(ids), k + 1 + reach)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            texts = [b"".join(self.tokens[i] for i in ids[a:b]) for a, b in spans]
            small = [t for t in texts if len(t) <= 4 * LONG]
            fresh = dict(zip(small, self.contract(small), strict=True))
            large = [t for t in texts if t not in fresh]
            fresh |= zip(large, self._chain(large, BLOCK_BYTES * reach), strict=True)
            out, at = [], 0
            for (a, b), text in zip(spans, texts, strict=True):
                out += ids[at:a] + fresh[text]
                at = b
            ids = out + ids[at:]
            reach *= 2

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words as little-endian bytes."""
        number = lambda ids: np.array(ids, "<u4").tobytes()
        coded = {w: w.encode() for w in words}
        fresh = {w: number([self.ranks[b]]) for w, b in coded.items() if b in self.ranks}
        short = [w for w, b in coded.items() if w not in fresh and len(b) <= LONG]
        fresh |= zip(short, self._contract([coded[w] for w in short]), strict=True)
        if len(fresh) < len(coded):
            fresh |= {w: number(self._stitch(b)) for w, b in coded.items() if w not in fresh}
        room = MEMO_WORDS - len(self.memo)
        self.memo |= itertools.islice(((w, ids) for w, ids in fresh.items() if len(w) <= LONG), max(0, room))
        return fresh

    def _pieces(self, text: str) -> Iterator[str]:
        """The words of a text one by one; odd characters are split by their stand-ins."""
        for m in self.split.finditer(text.translate(self.odd)):
            yield text[m.start() : m.end()]

    def _blocks(self, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """Words of some texts at a time, each with the number of its text; at most BLOCK words."""
        some: list[tuple[int, list[str]]] = []
        held = 0
        for n, text in enumerate(texts):
            text = text or ""
            odd = not (text.isascii() or self.odd_characters.isdisjoint(set(text)))
            found = self._pieces(text) if odd or len(text) > BLOCK else None
            words = list(itertools.islice(found, BLOCK)) if found else self.split.findall(text)
            while words:
                if held and held + len(words) > BLOCK:
                    yield some
                    some, held = [], 0
                some.append((n, words))
                held += len(words)
                words = list(itertools.islice(found, BLOCK)) if found else []
        if some:
            yield some

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts: list[list[bytes]] = [[] for _ in texts]
        for block in self._blocks(texts):
            unknown = set().union(*(words for _, words in block)).difference(self.memo)
            fresh = self._learn(unknown) if unknown else {}
            memo = self.memo
            for n, words in block:
                if fresh:
                    parts[n].append(b"".join([memo[w] if w in memo else fresh[w] for w in words]))
                else:
                    parts[n].append(b"".join(map(memo.__getitem__, words)))
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids, the text's token ids as little-endian unsigned 32-bit numbers in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairs.of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = encoder.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids and decoded, the bytes that the ids stand for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Vocabulary.of(path)
        for batch in batches:
            coded = [x or b"" for x in batch.column(1).to_pylist()]
            out: list[bytes] = []
            first, held = 0, 0
            for n, x in enumerate([*coded, None]):
                if x is None or held + len(x) > 4 * BLOCK:
                    some = [np.frombuffer(c, "<u4").astype(np.int64) for c in coded[first:n]]
                    out += decoder.decode_many(some) if held <= 4 * BLOCK else [decoder.decode(c) for c in coded[first:n]]
                    first, held = n, 0
                held += len(x or b"")
            columns = [batch.column(0), pa.array(coded, pa.binary()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def token_digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows of decode_documents."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
