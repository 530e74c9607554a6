"""Versioned Parquet tables: data folders that are never overwritten, and a manifest per
version, written last.

A manifest names, for each part of the table, its folder and its files with their lengths.
It is created only if its number is free, so of two drivers that commit at once one takes
the next number (a replacement) or merges again on what the other wrote (a merge). Readers
take the newest version whose manifest is whole and whose files are all there; a version
that is unfinished or damaged is passed over in favour of the one before. Older versions
stay readable, so a query that began on one can end on it.

A table that is merged into is cut into ``buckets`` parts by the hash of its key; a merge
rewrites only the parts that hold a changed key, and the next manifest points to the old
folders of all others.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = "all"


def files_of(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]] | None:
    """Length and modification time of the files (and names of the folders) in a folder of
    any file system Spark reads; None if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)}


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- manifests

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifests/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all manifests, the newest first."""
        names = files_of(self.spark, f"{self.root}/_manifests") or {}
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def manifest(self, version: int) -> dict | None:
        """The manifest of a version; None if it cannot be read in full."""
        path, fs = self._file(f"{version:010d}.json")
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and "parts" in found else None

    def _complete(self, manifest: dict) -> bool:
        for folder, files in manifest["parts"].values():
            there = files_of(self.spark, f"{self.root}/{folder}")
            if there is None or any(there.get(name, (None,))[0] != size for name, size in files.items()):
                return False
        return True

    def latest(self) -> tuple[int, dict] | None:
        """Number and manifest of the newest complete version."""
        for version in self.versions():
            manifest = self.manifest(version)
            if manifest is not None and self._complete(manifest):
                return version, manifest
        return None

    def _commit(self, version: int, parts: dict, note: dict) -> bool:
        """Write a manifest; False if another driver took the number."""
        path, fs = self._file(f"{version:010d}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as taken:
            if "FileAlreadyExists" in str(taken.java_exception) or fs.exists(path):
                return False
            raise
        out.write(bytearray(json.dumps({"parts": parts, "note": note}).encode()))
        out.close()
        return True

    def _part(self, folder: str) -> list:
        files = files_of(self.spark, f"{self.root}/{folder}") or {}
        return [folder, {n: size for n, (size, _) in files.items() if n.endswith(".parquet")}]

    # ---- reading

    def load(self, check_footers: bool = False) -> DataFrame | None:
        """The newest complete version, or None. With ``check_footers`` the footers of all
        its files are read too, and a version with an unreadable one counts as damaged."""
        for version in self.versions():
            manifest = self.manifest(version)
            if manifest is None or not self._complete(manifest):
                continue
            folders = [f"{self.root}/{folder}" for folder, files in manifest["parts"].values() if files]
            if not folders:
                continue
            try:
                return self.spark.read.option("mergeSchema", str(check_footers).lower()).parquet(*folders)
            except (PySparkException, Py4JJavaError):
                if not check_footers:
                    raise
        return None

    # ---- writing

    def replace(self, rows: DataFrame, note: dict | None = None) -> int:
        """A new version that holds exactly these rows; its number."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        parts = {WHOLE: self._part(folder)}
        version = max(self.versions(), default=0) + 1
        while not self._commit(version, parts, note or {}):
            version += 1
        return version

    def merge(self, changes: DataFrame, keys: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 16, note: dict | None = None) -> int:
        """A new version in which ``combine(rows so far, changes)`` replaces the parts that
        hold a key of the changes; its number. The first merge fixes ``buckets``."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        base = self.latest()
        while True:
            buckets = int(base[1]["note"].get("buckets", buckets)) if base else buckets
            bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
            if files_of(self.spark, staged) is None:
                changes.select("*", bucket).write.partitionBy("_bucket").parquet(staged)
            touched = sorted(n.split("=")[1] for n in files_of(self.spark, staged) if n.startswith("_bucket="))
            old = base[1]["parts"] if base else {}
            new_rows = self.spark.read.schema(changes.schema).parquet(*[f"{staged}/_bucket={b}" for b in touched]) if touched else changes.limit(0)
            before = [f"{self.root}/{old[b][0]}" for b in touched if b in old and old[b][1]]
            old_rows = self.spark.read.parquet(*before) if before else None
            rows = combine(old_rows if old_rows is not None else new_rows.limit(0), new_rows)
            folder = f"data/{uuid.uuid4().hex}"
            # the parts that write a bucket are of even size, however large it is
            rows.select("*", bucket).hint("rebalance", F.col("_bucket")).write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            parts = {**old, **{b: self._part(f"{folder}/_bucket={b}") for b in touched}}
            version = max(self.versions(), default=0) + 1
            if self._commit(version, parts, {**(note or {}), "buckets": buckets}):
                now = self.latest()
                if now and now[0] == version:
                    return version
            base = self.latest()  # another driver was faster: merge again on its version


def replaced_by_key(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Combination in which a changed row takes the place of the row with its key (null
    keys are equal)."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        changed = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        same: Column = F.lit(True)
        for k in keys:
            same = same & old[k].eqNullSafe(F.col(f"_k_{k}"))
        return old.join(changed, same, "left_anti").unionByName(new)
    return combine


def first_available(*tables: VersionedTable, check_footers: bool = False) -> DataFrame | None:
    """The first table that has a complete version: a current one, else its history."""
    for table in tables:
        found = table.load(check_footers)
        if found is not None:
            return found
    return None
