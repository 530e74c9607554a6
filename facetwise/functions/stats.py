"""Distributed helpers that stay exact under skew.

* ``keep_last``          — dedupe by key keeping the greatest row by an explicit order.
* ``nearest_rank_by_key``— exact nearest-rank quantile per group (element
                           ``floor((n-1)*q + 0.5)`` of the sorted group) by counting:
                           per value, then per value bucket, so no group's rows are
                           ever sorted in one task, whatever its size.
* ``median_of``          — per-row median of a few nullable columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Value buckets per doubling of the value.
BUCKETS_PER_OCTAVE = 256


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the row with the greatest ``order`` tuple (ties are
    identical rows by construction of ``order``). Copies of a key are combined
    before the shuffle by a sort-based partial aggregate, whose buffer holds each
    column once; callers leave out columns they do not read, as all others are
    sorted and shuffled with the key."""
    first = [c for c in dict.fromkeys(order) if c not in keys]
    payload = [*first, *[c for c in df.columns if c not in keys and c not in first]]
    if not payload:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in payload])).alias("_kept"))
    return picked.select(*[F.col(k) for k in keys], *[F.col(f"_kept.{c}").alias(c) for c in payload]).select(*df.columns)


def _bucket(value: Column) -> Column:
    """A bucket number that never falls as the value rises; NaN comes last, as in a sort."""
    v = value.cast("double")
    steps = F.floor(F.log2(F.abs(v)) * BUCKETS_PER_OCTAVE) + F.lit(2048 * BUCKETS_PER_OCTAVE)
    return (F.when(F.isnan(v), F.lit(2 ** 62)).when(v > 0, F.when(v == float("inf"), F.lit(2 ** 61)).otherwise(steps))
            .when(v < 0, F.when(v == float("-inf"), F.lit(-2 ** 61)).otherwise(-steps)).otherwise(F.lit(0)))


def nearest_rank_by_key(rows: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """Exact nearest-rank quantile (element ``floor((n-1)*q + 0.5)`` of the
    sorted non-null values) per group; one row per group with a non-null key.

    Rows are counted per (key, value) — a partial aggregate, shuffled by key and
    value, so a hot key spreads over all tasks — and the counts summed per
    (key, bucket). The running sum over a key's buckets (a few thousand at most)
    names the bucket that holds the target rank and the rank within it; only
    that bucket's distinct values are then ranked. All groups take this one path. The
    counts are shuffled once for both uses, and the ranking stays where its join is.
    """
    r = rows.select(*keys, value).where(F.col(value).isNotNull())
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    counts = r.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.coalesce(_bucket(F.col(value)), F.lit(0)))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = F.floor((F.sum("_bc").over(whole) - F.lit(1)).cast("double") * F.lit(float(q)) + F.lit(0.5))
    buckets = (counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
               .withColumn("_upto", F.sum("_bc").over(upto)).withColumn("_t", target)
               .where((F.col("_upto") > F.col("_t")) & (F.col("_upto") - F.col("_bc") <= F.col("_t")))
               .select(*keys, "_b", (F.col("_t") - F.col("_upto") + F.col("_bc")).alias("_k")))
    run = Window.partitionBy(*keys, "_b").orderBy(F.col(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(buckets, [*keys, "_b"]).withColumn("_run", F.sum("_c").over(run))
    return (ranked.where((F.col("_run") > F.col("_k")) & (F.col("_run") - F.col("_c") <= F.col("_k")))
            .select(*keys, F.col(value).alias(out)))


def median_of(*cols: Column) -> Column:
    """Median of the non-null arguments (mean of the middle two when even)."""
    arr = F.array_sort(F.array_compact(F.array(*cols)))
    size = F.size(arr)
    mid = F.floor(size / 2).cast("int")
    odd = F.get(arr, mid)
    even = (F.get(arr, mid - 1) + F.get(arr, mid)) / 2
    return F.when(size == 0, F.lit(None).cast("double")).when(size % 2 == 1, odd).otherwise(even)
