"""Stores of several tables with atomic commits.

A commit writes its tables to folders of its own and then publishes one pointer: a small file with the commit's number, a
path for each table (for a dated table one for each day) and the caller's notes. Readers take the pointer of the
highest number, so they see all of a commit or nothing of it, and a writer that is lost before its pointer leaves the
store as it was. A pointer is made under another name and renamed, which fails if its number exists: of two writers that
start from one version, one is refused. Tables that a commit doesn't name keep the path that they had.

Dated tables carry a fingerprint of each day's rows, which is mergeable and knows nothing of their order. A commit of days
is decided by the fingerprints of the days it brings, and only days that differ are written.

All files go through Hadoop's file systems, so a store may lie wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinode.operators.asof import keep_last


class CommitConflict(RuntimeError):
    """Another writer published the version first."""


def row_fingerprint(columns: list[str]) -> list[Column]:
    """Aggregates n, x and s of a set of rows: equal sets give equal values, and those of two sets add up."""
    h = F.xxhash64(*[F.col(c) for c in columns])
    return [F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftrightunsigned(h, 20)), F.lit(0)).alias("s")]


@dataclass(frozen=True)
class Version:
    """A published commit: number, tables (path and schema of each), dated tables (day to path and fingerprint), notes."""

    number: int
    tables: dict = field(default_factory=dict)
    dated: dict = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


class Store:
    """Tables under one root folder, read and written by version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- pointers

    def _pointers(self) -> list[int]:
        where = self._path(f"{self.root}/_versions")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version by its number, by default the newest; version 0 is the empty store."""
        known = self._pointers()
        number = (known[-1] if known else 0) if number is None else number
        if not number:
            return Version(0)
        if number not in known:
            raise KeyError(f"version {number} was never published or is gone")
        lines = self.spark.read.text(f"{self.root}/_versions/{number:012d}.json", wholetext=True).first()
        return Version(**json.loads(lines[0]))

    def _publish(self, version: Version) -> Version:
        """The pointer's own file, and then its name; the name can be taken once."""
        folder = f"{self.root}/_versions"
        made, named = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{version.number:012d}.json")
        self._fs.mkdirs(self._path(folder))
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        if self._fs.exists(named) or not self._rename(made, named):
            self._fs.delete(made, False)
            raise CommitConflict(f"version {version.number} exists")
        return version

    def _rename(self, made, named) -> bool:
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(made, named, none)
        except Exception as error:  # the target exists: another writer was first
            if "AlreadyExists" in str(error):
                return False
            raise
        return True

    # --- tables

    def read(self, name: str, version: Version | None = None) -> DataFrame | None:
        """A table as of a version, or None if it isn't in it."""
        held = (version or self.version()).tables.get(name)
        if held is None:
            return None
        return self.spark.read.schema(held["schema"]).parquet(f"{self.root}/{held['path']}")

    def _write(self, name: str, df: DataFrame) -> dict:
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        return {"path": path, "schema": _ddl(df)}

    def commit(self, tables: dict[str, DataFrame], notes: dict | None = None, base: Version | None = None) -> Version:
        """Writes tables and publishes them together as the version after `base`, by default the newest."""
        base = base or self.version()
        written = {name: self._write(name, df) for name, df in tables.items()}
        return self._publish(Version(base.number + 1, base.tables | written, base.dated, notes or {}))

    def upsert(self, name: str, rows: DataFrame, key: list[str], stamp: str, notes: dict | None = None) -> Version:
        """Commits a table with rows added: of each key the row of the highest stamp, and of equal ones the new."""
        base = self.version()
        held = self.read(name, base)
        both = rows.withColumn("_new", F.lit(1))
        if held is not None:
            both = held.withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
        last = keep_last(both, key, [F.desc_nulls_last(stamp), F.desc("_new")]).drop("_new")
        return self.commit({name: last}, notes, base)

    # --- dated tables

    def fingerprints(self, name: str, version: Version | None = None) -> dict[str, list[int]]:
        """n, x and s of each day of a dated table."""
        return {day: held["print"] for day, held in (version or self.version()).dated.get(name, {}).items()}

    def read_days(self, name: str, start: str | None = None, end: str | None = None, version: Version | None = None) -> DataFrame | None:
        """The days of a dated table from start to end, each from the commit that wrote it last; columns that it lacked are
        null."""
        days = (version or self.version()).dated.get(name, {})
        folders: dict[str, list[str]] = {}
        for day, held in sorted(days.items()):
            if (start is None or day >= start) and (end is None or day <= end):
                folders.setdefault(held["path"], []).append(day)
        out = None
        for path, kept in folders.items():
            # a folder is sorted by day, so that the days' bounds leave out most of a file that isn't wanted
            df = self.spark.read.parquet(f"{self.root}/{path}")
            df = df.where(F.col("_day").between(kept[0], kept[-1]) & F.col("_day").isin(*kept)).drop("_day")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def commit_days(self, name: str, rows: DataFrame, day: str, ignore: tuple[str, ...] = (), notes: dict | None = None) -> list[str]:
        """Writes the days of rows that differ from what is stored, publishes them together, and returns these days.

        Days are compared by fingerprints of the columns but `ignore` (run numbers, times); stored days that rows don't
        have stay. Without a difference nothing is written and no version is published. Rows without a day are an error.
        """
        base = self.version()
        held = base.dated.get(name, {})
        columns = sorted(c for c in rows.columns if c not in ignore)
        text = F.col(day).cast("string")
        found = rows.groupBy(text.alias("day")).agg(*row_fingerprint(columns)).collect()  # a row for each day
        if any(r.day is None for r in found):
            raise ValueError("a row without a day")
        prints = {r.day: [r.n, r.x, r.s] for r in found}
        changed = sorted(d for d, p in prints.items() if d not in held or held[d]["print"] != p or held[d]["columns"] != columns)
        if not changed:
            return []
        path = f"{name}/{uuid.uuid4().hex}"
        fresh = rows.where(text.isin(*changed)) if len(changed) < len(prints) else rows
        dealt = fresh.withColumn("_day", text).repartitionByRange("_day").sortWithinPartitions("_day")
        dealt.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        new = {d: {"path": path, "print": prints[d], "columns": columns} for d in changed}
        self._publish(Version(base.number + 1, base.tables, base.dated | {name: held | new}, notes or {}))
        return changed

    # --- what no kept version reads

    def vacuum(self, keep: int = 2) -> int:
        """Deletes pointers but the newest `keep`, and folders that none of these names; returns how many folders.

        Not to be run while a writer may be between its tables and its pointer.
        """
        known = self._pointers()
        for number in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_versions/{number:012d}.json"), False)
        used = set()
        for number in known[-keep:]:
            version = self.version(number)
            used |= {t["path"] for t in version.tables.values()}
            used |= {d["path"] for days in version.dated.values() for d in days.values()}
        gone = 0
        for table in self._fs.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            if name.startswith("_") or not table.isDirectory():
                continue
            for folder in self._fs.listStatus(table.getPath()):
                if f"{name}/{folder.getPath().getName()}" not in used:
                    self._fs.delete(folder.getPath(), True)
                    gone += 1
        return gone


def _ddl(df: DataFrame) -> str:
    """The schema as text that a reader takes."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """A CSV with header for spreadsheets: each file begins with the byte order mark that tells them UTF-8."""
    first = df.columns[0]
    df.withColumnRenamed(first, f"﻿{first}").write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file and sha256 of the files of a folder, each hashed whole by the task that reads it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
