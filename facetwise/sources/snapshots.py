"""Snapshot tables: canonical feeds and the matched table are written once per
source folder as zstd parquet under the shared folder (``spark.checkpoint.dir``)
and every report reads them back — the write cuts lineage, the reads get
column pruning and predicate pushdown, and a lost executor only recomputes
from the snapshot, not from the raw feeds. A snapshot is a versioned table
(see ``versions``): a rebuild adds a version and never touches one in use."""
from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from facetwise.session import shared_path
from facetwise.sources.versions import VersionedTable, files_of

# Error classes of a missing folder, one without any part and a part that cannot be read.
UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER")

_LOCK = threading.RLock()
_DONE: set[str] = set()  # snapshots this driver has built


def _source_tag(spark: SparkSession, src: str) -> str:
    """Folder identity: path plus size and time of its files, listed through the file
    system Spark reads them by, one level of folders deep (a changed source gets new
    snapshots)."""
    parts = [src]
    for name, stamp in sorted((files_of(spark, src) or {}).items()):
        inside = files_of(spark, f"{src}/{name}") if stamp[0] == 0 else None
        parts += [f"{name}:{stamp}", *[f"{n}:{s}" for n, s in sorted((inside or {}).items())]]
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def snapshot(spark: SparkSession, src: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    table = VersionedTable(spark, shared_path(spark, "snapshots", _source_tag(spark, src), name))
    with _LOCK:
        if table.root not in _DONE:
            table.replace(build(spark, src))
            _DONE.add(table.root)
    return table.load()


def load_snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a snapshot. With ``schema``, one that is missing or has an unreadable
    part is absent as a whole (empty frame of that schema): the footers of all
    parts are read first, in a Spark job. Without it, both raise."""
    if schema is None:
        return spark.read.parquet(path)
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except (PySparkException, Py4JJavaError) as absent:
        if not any(x in str(absent) for x in UNREADABLE):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path) if found.columns else found
