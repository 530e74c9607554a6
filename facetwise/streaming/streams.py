"""Structured Streaming forms of the incremental operators.

Sources are file streams over upload folders (new files = new uploads). Checkpoints live
under the shared folder, so a restarted query resumes where it stopped, and each sink takes
a batch once: appended rows are partitioned by batch, keyed results are merged into a
versioned table whose manifest names the last batch it holds. ``run_available`` drives a
query with ``trigger(availableNow=True)``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetwise.functions import dims
from facetwise.functions.exprs import size_range
from facetwise.operators.pairs import PAIR_KEY
from facetwise.session import shared_path
from facetwise.sources.versions import VersionedTable, replaced_by_key

COMPACT_KEYS = dims.MATCH_KEYS + ["status"]
PANE_KEYS = ["day", *dims.COHORT_KEYS]
TRAILING_DAYS = 30


def _merge_sink(spark: SparkSession, path: str, keys: list[str]):
    """Changed rows replace those with their key; only touched buckets are rewritten, and
    readers keep the version before until the new one is whole."""
    table = VersionedTable(spark, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        done = table.latest()
        if done is None or done[1]["note"].get("batch", -1) < batch_id:
            table.merge(batch, keys, replaced_by_key(keys), note={"batch": batch_id})
    return write


def _append_sink(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # rows carry the batch id; a replayed batch overwrites its own partition only
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


def market_compaction_stream(spark: SparkSession, source_dir: str, schema: str) -> DataFrame:
    """Streaming market compaction: listings arriving as files are grouped by
    the match attributes + status into count, min price and the cheapest id. In update
    mode a batch emits the groups it changed, which a merge by ``COMPACT_KEYS`` takes."""
    listings = spark.readStream.schema(schema).parquet(source_dir).where(F.col("price") > 0)
    return listings.groupBy(*COMPACT_KEYS).agg(
        F.count(F.lit(1)).alias("piece_count"), F.min("price").alias("min_price"),
        F.min(F.struct("price", "stone_id")).getField("stone_id").alias("first_id"))


def sale_panes_stream(spark: SparkSession, source_dir: str, schema: str, late: str = "30 days") -> DataFrame:
    """Sale counts per day and cohort. In update mode each batch emits the days it changed;
    a day's state goes once the watermark has passed it, so state follows the days that
    may still change. Sales later than that are left out."""
    sales = spark.readStream.schema(schema).parquet(source_dir)
    s = (sales.where(F.col("sale_date").isNotNull())
         .withColumn("sale_ts", F.col("sale_date").cast("timestamp")).withWatermark("sale_ts", late)
         .withColumn("size_range", size_range(F.col("carat"))).where(F.col("size_range").isNotNull()))
    panes = s.groupBy(F.window("sale_ts", "1 day"), *dims.COHORT_KEYS).agg(F.count(F.lit(1)).alias("sales"))
    return panes.select(F.col("window.start").cast("date").alias("day"), *dims.COHORT_KEYS, "sales")


def trailing_windows(panes: DataFrame, days: int = TRAILING_DAYS) -> DataFrame:
    """Sliding windows of whole days from daily panes: each pane counts in as many windows
    as it has days, one row a cohort and day, not a sale."""
    start = F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"), F.expr("INTERVAL 1 DAY")))
    w = panes.select(start.alias("from"), *dims.COHORT_KEYS, "sales").groupBy("from", *dims.COHORT_KEYS).agg(F.sum("sales").alias("sales"))
    return w.select(F.col("from").cast("timestamp").alias("window_start"), F.date_add("from", days).cast("timestamp").alias("window_end"), *dims.COHORT_KEYS, "sales")


def price_history_stream(spark: SparkSession, source_dir: str, schema: str) -> DataFrame:
    """Append-only price snapshots, one row per pair and sync; a row that arrives again
    within the watermark is dropped."""
    rows = spark.readStream.schema(schema).parquet(source_dir)
    return rows.withWatermark("recorded_at", "1 day").dropDuplicatesWithinWatermark([*PAIR_KEY, "recorded_at"])


def run_available(spark: SparkSession, stream: DataFrame, name: str, keys: list[str] | None = None) -> StreamingQuery:
    """Process what has arrived: merged by ``keys`` (update mode), or appended."""
    out, ckpt = sink_path(spark, name), shared_path(spark, "streams", name, "checkpoint")
    sink = _merge_sink(spark, out, keys) if keys else _append_sink(out)
    q = (stream.writeStream.outputMode("update" if keys else "append").foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def sink_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, "streams", name, "out")


def merged(spark: SparkSession, name: str) -> DataFrame | None:
    """What a keyed stream has merged so far."""
    return VersionedTable(spark, sink_path(spark, name)).load()


def appended(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(sink_path(spark, name)).drop("batch_id")
