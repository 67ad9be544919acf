"""Trailing aggregates over the rows of each key, made from arrays of many rows at once.

A sliding frame of a window function is aggregated anew for every row. Here Spark deals and orders the rows by key, and a
task goes over them in batches: a measure adds whole arrays of the batch, shifted by a row at a time or by doubled steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# x: values; valid: which aren't null; n: rows of the frame; age: rows of the key before each row


def _ago(x, valid, n, age, fill=0.0):
    """The row n rows before."""
    out, ok = np.full_like(x, fill), np.zeros_like(valid)
    at = np.flatnonzero(age[n:] >= n)
    out[at + n], ok[at + n] = x[at], valid[at]
    return out, ok


def _count(valid, n, age):
    held = np.concatenate([[0], np.cumsum(valid, dtype=np.int64)])
    row = np.arange(1, len(valid) + 1)
    return held[1:] - held[np.maximum(row - np.minimum(n, age + 1), 0)]


def _extreme(choose: Callable, x, n, age, fill):
    """Frames of 1, 2, 4, ... rows, each of two of half as many; the last of two that overlap."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x, width = choose(x, _ago(x, np.zeros(len(x), dtype=bool), step, age, fill)[0]), width + step
    return x


def _max(x, valid, n, age):
    return _extreme(np.maximum, np.where(valid, x, -np.inf), n, age, -np.inf), _count(valid, n, age) > 0


def _min(x, valid, n, age):
    # NaN counts as the largest, as in Spark: it is the least only of frames that hold nothing else
    return _extreme(np.fmin, np.where(valid, x, np.nan), n, age, np.nan), _count(valid, n, age) > 0


def _avg(x, valid, n, age):
    """Added from the oldest row to the newest, as a frame adds them."""
    x, total = np.where(valid, x, 0.0), np.zeros(len(x))
    for k in range(min(n, len(x)) - 1, -1, -1):
        np.add(total[k:], x[: len(x) - k], out=total[k:], where=age[k:] >= k)
    held = _count(valid, n, age)
    return total / np.maximum(held, 1), held > 0


def _sd(x, valid, n, age):
    """Sample deviation by running means; null under two values."""
    held, mean, square = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    x = np.where(valid, x, 0.0)
    for k in range(min(n, len(x)) - 1, -1, -1):
        ok = valid[: len(x) - k] & (age[k:] >= k)
        held[k:] += ok
        gap = np.where(ok, x[: len(x) - k] - mean[k:], 0.0)
        step = gap / np.maximum(held[k:], 1.0)
        mean[k:] += step
        square[k:] += gap * (gap - step)
    return np.sqrt(square / np.maximum(held - 1.0, 1.0)), held > 1


def _avg_at(x, valid, n, age, at):
    """_avg of the rows `at` alone, added in the same order."""
    x, total, deep = np.where(valid, x, 0.0), np.zeros(len(at)), age[at]
    for k in range(min(n, len(x)) - 1, -1, -1):
        np.add(total, x[np.maximum(at - k, 0)], out=total, where=deep >= k)
    held = _count(valid, n, age)[at]
    return total / np.maximum(held, 1), held > 0


def _sd_at(x, valid, n, age, at):
    """_sd of the rows `at` alone, by the same means."""
    held, mean, square = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    x, deep = np.where(valid, x, 0.0), age[at]
    for k in range(min(n, len(x)) - 1, -1, -1):
        row = np.maximum(at - k, 0)
        ok = valid[row] & (deep >= k)
        held += ok
        gap = np.where(ok, x[row] - mean, 0.0)
        step = gap / np.maximum(held, 1.0)
        mean += step
        square += gap * (gap - step)
    return np.sqrt(square / np.maximum(held - 1.0, 1.0)), held > 1


def _start(n, age):
    return np.maximum(np.arange(len(age)) - np.minimum(n - 1, age), 0)


def _first(x, valid, n, age):
    """The first of the frame that isn't null."""
    row = np.arange(len(x))
    at = np.minimum.accumulate(np.where(valid, row, len(x))[::-1])[::-1][_start(n, age)]
    ok = at <= row
    return x[np.where(ok, at, 0)], ok


def _last(x, valid, n, age):
    """The last of the frame that isn't null."""
    at = np.maximum.accumulate(np.where(valid, np.arange(len(x)), -1))
    ok = at >= _start(n, age)
    return x[np.where(ok, at, 0)], ok


def _oldest(x, valid, n, age):
    """The frame's oldest row, null or not."""
    at = _start(n, age)
    return x[at], valid[at]


def _counted(x, valid, n, age):
    return _count(valid, n, age), np.ones(len(x), dtype=bool)


KINDS = {"max": _max, "min": _min, "avg": _avg, "sd": _sd, "first": _first, "last": _last, "oldest": _oldest, "ago": _ago, "count": _counted}
#: Kinds that go over a frame's rows one by one, and so gain where few rows are wanted.
KINDS_AT = {"avg": _avg_at, "sd": _sd_at}


def trailing(rows: DataFrame, key: str, order: str, number: str, measures: dict[str, tuple[str, str, int]], wanted: str | None = None) -> DataFrame:
    """rows with a column for each measure: name to kind, column of doubles and n, the rows of the frame with its own.

    number: row_number over the window of key by order, which has dealt the rows already; a task that doesn't get them so
    fails. Nulls don't count, NaN does. A measure may be of one before it. Between batches only as many rows are kept as
    the longest measure reaches back.

    wanted: a column of booleans; all rows count in the frames, but only those where it is true are returned and measured.
    """
    fields = [StructField(name, LongType() if kind == "count" else DoubleType()) for name, (kind, _, _) in measures.items()]
    reach: dict[str, int] = {}
    for name, (_, column, n) in measures.items():
        reach[name] = n + reach.get(column, 0)
    measured = {c for _, c, _ in measures.values()}
    inputs, longest = sorted(measured - set(measures)), max(reach.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: (batch.column(c).to_numpy(zero_copy_only=False).astype(float), batch.column(c).is_valid().to_numpy(zero_copy_only=False)) for c in inputs}
            age, back = batch.column(number).to_numpy(zero_copy_only=False) - 1, 0
            if kept is not None:
                back = len(kept[0])
                age = np.concatenate([kept[0], age])
                new = {c: tuple(np.concatenate(pair) for pair in zip(kept[1][c], new[c], strict=True)) for c in inputs}
            if (kept is None and age[0]) or ((age[1:] != 0) & (age[1:] != age[:-1] + 1)).any():
                raise ValueError(f"rows of a {key} are not in the order of {number}")
            kept = age[-longest:], {c: (x[-longest:], valid[-longest:]) for c, (x, valid) in new.items()}
            held, made, at = dict(new), [], slice(back, None)
            if wanted is not None:
                asked = batch.column(wanted).fill_null(False)
                at = back + np.flatnonzero(asked.to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                batch = batch.filter(asked)
            with np.errstate(all="ignore"):
                for name, (kind, column, n) in measures.items():
                    if wanted is not None and kind in KINDS_AT and name not in measured:
                        x, valid = KINDS_AT[kind](*held[column], n, age, at)
                    else:
                        held[name] = KINDS[kind](*held[column], n, age)
                        x, valid = (v[at] for v in held[name])
                    made.append(pa.array(x, mask=~valid))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *measures])

    return rows.sortWithinPartitions(key, order).mapInArrow(run, StructType([*rows.schema.fields, *fields]))
