"""License scans by conditional compression.

A candidate block is the words around those that tell a template, on either side as many as the longest template has and
may differ by, whatever its lines; a longer one is read in overlapping parts. Each template tells itself by as many of its
longest words as it may lack, and one more, so that no place within the allowed difference is without one of them.

A block is compressed alone and with each template as a raw dictionary of zstandard. The templates are ranked by the bytes
that they save, and gone down as long as they save any. Each is confirmed by the exact differences in wording at its best
places: the words of the template that the text lacks and the words that it puts between them. A place stands if these
are few, all its numbers and versions agree, and the template saves bytes of the place itself.

Defined results: null and empty texts hold nothing; of confirmed places that overlap, the one with the most words of its
template stands, then the one with fewer differences, the one that saves more, the first by name; all others are
reported. A place goes from its first to its last word, with the marks next to them. Repeated rows give repeated results,
a null doc_id is carried through, an empty table gives no rows, other columns are left alone, and whole texts are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed wordings of common license statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Share of a template's words that may differ, one word at least.
DIFFERENCE = 0.1

_WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")
_MARKS = re.compile(r"[^\w\s]*")
_OUT = "doc_id long, start long, end long, license string, saved double, missing array<string>, added array<string>, exact boolean"


#: Characters of blocks whose places a task remembers.
MEMO = 1 << 22


class Places:
    """Intervals that don't overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, at: int) -> bool:
        k = bisect_right(self.starts, at)
        return k > 0 and at < self.ends[k - 1]

    def add(self, start: int, end: int) -> bool:
        """Takes an interval unless it overlaps one that is held."""
        k = bisect_right(self.starts, start)
        if k and start < self.ends[k - 1] or k < len(self.starts) and self.starts[k] < end:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


class Templates:
    """Compressors with one template each as raw dictionary, and the templates' words."""

    def __init__(self, templates: dict[str, str]):
        import zstandard as z

        make = lambda **more: z.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, write_dict_id=False, **more)
        self.alone = make()
        self.given = {k: make(dict_data=z.ZstdCompressionDict(self._plain(t).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for k, t in sorted(templates.items())}
        self.words = {k: _WORD.findall(t.lower()) for k, t in templates.items()}
        self.most = {k: int(max(1, DIFFERENCE * len(w))) for k, w in self.words.items()}
        self.reach = max((len(w) + self.most[k] for k, w in self.words.items()), default=0)
        # of each template as many of its longest words as it may lack, and one more
        order = {k: sorted(set(w), key=lambda x: (-len(x), x))[: self.most[k] + 1] for k, w in self.words.items()}
        self.telling = frozenset(w for some in order.values() for w in some)
        self.prefilter = [w.encode() for w in sorted(self.telling)]

    @staticmethod
    def _plain(text: str) -> str:
        return " ".join(text.lower().split())

    def bytes_saved(self, block: str, names: list[str] | None = None) -> dict[str, tuple[int, float]]:
        """(bytes, share) of the block's compressed size that each template saves as a dictionary."""
        data = self._plain(block).encode()
        alone = len(self.alone.compress(data))
        sizes = {k: len(self.given[k].compress(data)) for k in (names or self.given)}
        return {k: (alone - n, 1 - n / alone) for k, n in sizes.items()}

    def ranked(self, block: str) -> list[str]:
        """The templates that save bytes of a block, those that save most first."""
        saved = self.bytes_saved(block)
        return sorted((k for k in saved if saved[k][0] > 0), key=lambda k: (-saved[k][0], k))

    def places(self, found: list[str], name: str) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """(first word, end, missing, added) of the places in the words that differ little enough from the template."""
        template, most = self.words[name], self.most[name]
        if not template or sum((Counter(template) & Counter(found)).values()) < len(template) - most:
            return
        # cost[i, j]: least missing and added words of the template's first i in a run that ends before word j
        numbers: dict[str, int] = {}
        text = np.array([numbers.setdefault(w, len(numbers)) for w in found])
        at = np.arange(len(found) + 1)
        cost = np.zeros((len(template) + 1, len(found) + 1), np.int32)
        for i, w in enumerate(template, 1):
            row = cost[i - 1] + 1
            row[1:] = np.where(text == numbers.get(w, -1), np.minimum(row[1:], cost[i - 1, :-1]), row[1:])
            cost[i] = np.minimum.accumulate(row - at) + at
        ends = np.flatnonzero(cost[-1] <= most)
        taken = Places()
        for end in ends[np.argsort(cost[-1, ends], kind="stable")].tolist():
            if taken.holds(end - 1):
                continue
            i, j, missing, added = len(template), end, [], []
            while i:
                if j and found[j - 1] == template[i - 1] and cost[i, j] == cost[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                elif cost[i, j] == cost[i - 1, j] + 1:
                    i -= 1
                    missing.append(template[i])
                else:
                    j -= 1
                    added.append(found[j])
            telling = any(c.isdigit() or c == "-" for w in (*missing, *added) for c in w)
            if j < end and not telling and taken.add(j, end):
                yield j, end, missing[::-1], added[::-1]

    def confirm(self, block: str, names: list[str] | None = None) -> list[tuple[int, int, str, float, list[str], list[str]]]:
        """(start, end, template, saved, missing, added) of all confirmed places of a block, none overlapping; of the ranked
        templates, or of the named ones."""
        spots = list(_WORD.finditer(block))
        found = [m.group().lower() for m in spots]
        every = []
        part = 4 * self.reach
        for at in range(0, max(1, len(found)), part - self.reach):
            words = found[at : at + part]
            if not words or at and len(words) <= self.reach:  # the part before has it whole
                continue
            within = block[spots[at].start() : spots[at + len(words) - 1].end()]
            for name in self.ranked(within) if names is None else names:
                for first, end, missing, added in self.places(words, name):
                    start, stop = spots[at + first].start(), spots[at + end - 1].end()
                    saved, share = self.bytes_saved(block[start:stop], [name])[name]
                    if saved > 0:
                        worth = (len(missing) - len(self.words[name]), len(missing) + len(added), -share)
                        every.append((*worth, name, start, stop, missing, added))
        out: list[tuple[int, int, str, float, list[str], list[str]]] = []
        taken = Places()
        for _, _, less, name, start, stop, missing, added in sorted(every):
            if taken.add(start, stop):
                out.append((start, stop, name, -less, missing, added))
        marks = [(*self._marked(block, o[0], o[1]), *o[2:]) for o in out]
        return sorted(marks)

    @staticmethod
    def _marked(block: str, start: int, stop: int) -> tuple[int, int]:
        """The place with the marks that follow its last word."""
        return start, _MARKS.match(block, stop).end()


def candidate_regions(text: str, reach: int, telling: frozenset[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of words within reach of a telling one."""
    spots = list(_WORD.finditer(text))
    held = [i for i, m in enumerate(spots) if m.group().lower() in telling]
    first = end = -1
    for i in [*held, None]:
        if first >= 0 and (i is None or i - reach > end):
            stop = spots[end - 1].end()
            yield spots[first].start(), _MARKS.match(text, stop).end()
            first = -1
        if i is not None:
            first = max(0, i - reach) if first < 0 else first
            end = min(len(spots), i + reach + 1)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start and end (code points), license, saved, missing, added, exact of every confirmed place."""
    chosen = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo, held = Templates(chosen), {}, 0
        for batch in batches:
            rows: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                low = (data or b"").lower()
                if not any(k in low for k in known.prefilter):
                    continue
                whole = data.decode()
                for start, end in candidate_regions(whole, known.reach, known.telling):
                    block = whole[start:end]
                    if block not in memo:
                        if held > MEMO:
                            memo.clear()
                            held = 0
                        memo[block], held = known.confirm(block), held + len(block)
                    rows += [(key, start + a, start + b, name, saved, missing, added, not missing and not added) for a, b, name, saved, missing, added in memo[block]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _OUT)
