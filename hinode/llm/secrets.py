"""Secret scans: fixed patterns plus assignment-aware lexing of source and configuration text.

The base kinds (`assign`, `access`, `hex`) are patterns matched over the whole text, leftmost and non-overlapping per
kind. The lexer reads name-literal pairs: assignments (`name = "literal"`, `name: literal`, `"name": "literal"`, with a
type between or not), strings in single, double, back and triple quotes with their escapes, block scalars and elements.
It carries constants from one name to the next (`KEY = "..."`, then `password = KEY`, and sums of literals and constants)
and scores each literal by the words of the names it reaches and by its own make-up; those scoring enough are spans of the
kind `literal`. The time of a scan grows in proportion to the text.

Spans are code points, end exclusive. Defined results: a null or empty text has no spans; each row stands for itself,
so repeated rows give repeated results; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which ties are listed.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: Fixed words that make a target name sensitive, with their weight; a name's words are read apart (see name_words).
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "accesskey": 3.0, "privatekey": 3.0, "secretkey": 3.0, "credential": 2.5, "auth": 1.5,
}
#: Fixed: of these, the ones that also count at the end of a longer word without a break, as in `dbpassword`.
ENDINGS = ("password", "passwd", "passphrase", "apikey", "secret", "token", "accesskey", "privatekey", "secretkey")
#: Fixed literals that stand for a value without being one.
PLACEHOLDERS = (b"changeme", b"example", b"placeholder", b"your", b"xxxx", b"****", b"todo", b"none", b"null", b"redacted", b"dummy")
LITERAL_SCORE = 4.0
#: Characters at the end of a bare value in which names are sought again, as in `a:password:b`.
NESTED = 200

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: What a text must hold, without the breaks of names, to have a sensitive name.
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"apikey", b"accesskey", b"privatekey", b"credential", b"auth")
_BREAKS = b"_-."

# All runs are possessive, and a name begins only where no character of a name stands before it, so that no run is read
# again from its middle: the time of a scan grows with the text.
_RUN = rb"[A-Za-z0-9_.\-]++"
_STRING = rb"""\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"""
_PAIR = re.compile(
    rb"""(?<![A-Za-z0-9_.\-])(?P<name>%s)["'`]?+
    (?:[\x20\t]*+:[\x20\t]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+(?=[\x20\t]*+=[^=]))?+   # a type between the name and its value
    [\x20\t]*+(?::=|=>|[:=])(?![=/])[\x20\t]*+
    (?P<value>(?:%s|[^\s"'`\#,;+]++(?:\+(?=[^\s"'`\#,;+])[^\s"'`\#,;+]++)*+)
      (?:[\x20\t]*+\+[\x20\t]*+(?:%s|%s))*+)"""
    % (_RUN, _STRING, _STRING, _RUN),
    re.X | re.S,
)
_TERM = re.compile(rb"(?P<string>%s)|(?P<bare>[^\s\"'`#,;+]++(?:\+(?=[^\s\"'`#,;+])[^\s\"'`#,;+]++)*+)" % _STRING, re.S)
_ELEMENT = re.compile(rb"<(?P<name>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?:\s[^<>]*+)?+>(?P<value>[^<>]++)</(?P=name)\s*+>")
_BLOCK = re.compile(rb"[|>][-+0-9]*+[\x20\t]*+(?:#[^\n]*+)?(?=\n)")
_BARE_SECRET = re.compile(rb"(?=[A-Za-z0-9+/_=.\-]*?[0-9])(?=[A-Za-z0-9+/_=.\-]*?[A-Za-z])[A-Za-z0-9+/_=.\-]{12,}+\Z")
_WORD = re.compile(r"[A-Z]++(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_words(name: bytes) -> list[str]:
    """The words of a name in lower case: at breaks, and where small letters turn to capital ones; a plural is its singular."""
    words = [w.lower() for w in _WORD.findall(name.decode("ascii", "ignore"))]
    return [w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w for w in words]


def name_score(name: bytes) -> float:
    """How sensitive a target name is: by one of its words, two that follow each other, or the end of one."""
    words = name_words(name[:200])
    found = [SENSITIVE.get(w, 0.0) for w in words]
    found += [SENSITIVE.get(a + b, 0.0) for a, b in itertools.pairwise(words)]
    found += [SENSITIVE[e] for w in words for e in ENDINGS if w.endswith(e)]
    return max(found, default=0.0)


class Value:
    """What a name stands for: literals and other values, with what the score reads of them joined. A value that is used
    many times is held once, so sums of sums cost no more than their lines."""

    __slots__ = ("spans", "parts", "counts", "size", "first", "doubtful", "words", "reported")

    def __init__(self, spans: list[tuple[int, int, bytes]], parts: list[Value]):
        self.spans, self.parts, self.reported = [(a, b) for a, b, _ in spans if b > a], parts, False
        texts = [t for *_, t in spans]
        self.counts = sum((p.counts for p in parts), Counter(b"".join(texts)))
        self.size = sum(self.counts.values())
        self.first = next((t[:1] for t in texts if t), parts[0].first if parts else b"")
        low = [t.lower() for t in texts]
        self.doubtful = any(p.doubtful for p in parts) or any(h in t for t in low for h in PLACEHOLDERS)
        self.words = max([len(t.split()) for t in texts] + [p.words for p in parts], default=0)

    def entropy(self) -> float:
        return -sum(c / self.size * math.log2(c / self.size) for c in self.counts.values()) if self.size else 0.0

    def report(self, out: set[tuple[int, int]]) -> None:
        """Adds the spans of all literals that this value is made of, each value's once."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.reported:
                value.reported = True
                out.update(value.spans)
                todo += value.parts


def literal_score(name: bytes, value: Value) -> float:
    """Score of what is assigned to a name: the name's weight plus up to 3 for the make-up of the literals, less 3 for prose."""
    weight = name_score(name)
    if not weight or value.size < 6 or value.doubtful or value.first in (b"$", b"<", b"{", b"%"):
        return 0.0
    digit = any(48 <= c < 58 for c in value.counts)
    e = value.entropy()
    return weight + (e >= 2.5) + (e >= 3.3) + (digit and value.size >= 8) - 3.0 * (value.words > 3)


def _inside(string: bytes) -> int:
    """How many characters of quotes a string begins and ends with."""
    return 3 if string[:3] in (b'"""', b"'''") and len(string) >= 6 else 1


def _block_lines(data: bytes, name_at: int, at: int) -> tuple[list[tuple[int, int, bytes]], int]:
    """The lines of a block scalar that begins after the line at `at`: those indented more than the line of its name."""
    line = data.rfind(b"\n", 0, name_at) + 1
    indent = len(data[line:name_at]) - len(data[line:name_at].lstrip(b" -"))
    found, at = [], at + 1
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        text = data[at:end]
        content = text.strip()
        if content:
            if len(text) - len(text.lstrip(b" ")) <= indent:
                break
            start = at + text.index(content[:1])
            found.append((start, start + len(content), content))
        at = end + 1
    return found, min(at, len(data))


def lex_values(data: bytes) -> Iterator[tuple[bytes, Value]]:
    """(name, value) pairs in order, of assignments, block scalars and elements; a bare word that names an earlier value
    stands for it."""
    known: dict[bytes, Value] = {}
    at = 0
    while m := _PAIR.search(data, at):
        name, at = m["name"], m.end()
        spans: list[tuple[int, int, bytes]] = []
        parts: list[Value] = []
        block = _BLOCK.match(data, m.start("value"))
        if block:
            spans, at = _block_lines(data, m.start("name"), block.end())
        else:
            for t in _TERM.finditer(data, m.start("value"), m.end("value")):
                if t["string"] is not None:
                    cut = _inside(t["string"])
                    spans.append((t.start() + cut, t.end() - cut, t["string"][cut:-cut]))
                elif t["bare"] in known:
                    parts.append(known[t["bare"]])
                elif _BARE_SECRET.match(t["bare"]):
                    spans.append((t.start(), t.end(), t["bare"]))
                elif not (spans or parts) and t.end() == m.end("value"):
                    at = max(t.start(), at - NESTED)  # a bare word may be a name itself
        if spans or parts:
            value = Value(spans, list({id(p): p for p in parts}.values()))
            known[name] = value
            yield name, value
    if b"</" in data:
        for m in _ELEMENT.finditer(data):
            text = m["value"].strip()
            if text:
                start = m.start("value") + m["value"].index(text[:1])
                yield m["name"].rpartition(b":")[2], Value([(start, start + len(text), text)], [])


def literal_spans(data: bytes) -> set[tuple[int, int]]:
    """Byte spans of literals that reach a sensitive name with a sufficient score."""
    out: set[tuple[int, int]] = set()
    for name, value in lex_values(data):
        if literal_score(name, value) >= LITERAL_SCORE:
            value.report(out)
    return out


def find_spans(data: bytes) -> list[tuple[int, int, int]]:
    """All spans of a UTF-8 text as (start, end, index of the kind), in bytes, sorted by start and kind."""
    spans = []
    names = None
    marked = b"=" in data or b":" in data or b"</" in data
    if marked:
        low = data.lower()
        names = low.translate(None, _BREAKS)
        if any(k in low for k in _KEYWORDS):
            spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(data)]
    if marked and any(k in names for k in _STEMS):
        spans += [(a, b, 3) for a, b in literal_spans(data)]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def _to_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if data.isascii():
        return spans
    place = {}
    seen = last = 0
    for at in sorted({x for a, b, _ in spans for x in (a, b)}):
        seen += len(data[last:at].decode())
        place[at], last = seen, at
    return [(place[a], place[b], k) for a, b, k in spans]


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and spans array<struct<kind,start,end>> of every row, base kinds and literals together."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                spans = find_spans(data) if data else []
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in _to_points(data, spans)] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span, overlapping ones joined, replaced by the mark; other columns are kept as they are."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = mark.encode()
        for batch in batches:
            out = []
            for data in batch.column(place).cast(pa.binary()).to_pylist():
                spans = find_spans(data) if data else []
                if spans:
                    cut, last = [], 0
                    for a, b, _ in spans:
                        if a >= last:
                            cut += [data[last:a], swap]
                        last = max(last, b)
                    data = b"".join([*cut, data[last:]])
                out.append(None if data is None else data.decode())
            columns = list(batch.columns)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
