"""Exact multi-attribute matching of own stock against the market.

Physical shape: the market is pre-aggregated to one row per key (partial +
final hash aggregate, so hot keys are combined map-side), then inventory is
left-joined to that benchmark. AQE picks broadcast vs sort-merge from the
runtime size of the benchmark and splits skewed inventory partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.stats import keep_last, nearest_rank_by_key

MARKET_COLUMNS = ["market_bottom_price", "market_p01_price", "market_stone_id"]


def join_keys(market: DataFrame, inventory: DataFrame) -> list[str]:
    """The match attributes present on both sides, in canonical key order."""
    both = set(market.columns) & set(inventory.columns)
    return [k for k in dims.MATCH_KEYS if k in both]


def positive_price(df: DataFrame) -> DataFrame:
    return df.where(F.col("price") > 0)


def market_benchmark(market: DataFrame, keys: list[str]) -> DataFrame:
    """Per key (every attribute non-null — a null key never matches): min
    price, exact nearest-rank 1st percentile, and the id of the cheapest
    listing (ties -> smallest id). Two per-key tables joined on the key."""
    m = positive_price(market).select(*keys, "stone_id", "price")
    for k in keys:
        m = m.where(F.col(k).isNotNull())
    stats = m.groupBy(*keys).agg(
        F.min("price").alias("market_bottom_price"),
        F.min(F.struct("price", "stone_id")).getField("stone_id").alias("market_stone_id"))
    p01 = nearest_rank_by_key(m, keys, "price", 0.01, "market_p01_price")
    return stats.join(p01, keys, "left").select(*keys, *MARKET_COLUMNS)


def exact_match(inventory: DataFrame, market: DataFrame) -> DataFrame:
    """Inventory LEFT JOIN market benchmark on the shared attributes; a null
    key never matches."""
    keys = join_keys(market, inventory)
    bench = market_benchmark(market, keys)
    return positive_price(inventory).join(bench, keys, "left")


def unmatched_inventory(inventory: DataFrame, market: DataFrame) -> DataFrame:
    keys = join_keys(market, inventory)
    m = positive_price(market).select(*keys).distinct()
    return positive_price(inventory).join(m, keys, "left_anti")


def dedupe_listings(listings: DataFrame, order: list[str]) -> DataFrame:
    """One row per stone id, keeping the last by the explicit order."""
    return keep_last(listings, ["stone_id"], order)


def comparable_listings(market: DataFrame, inventory: DataFrame) -> DataFrame:
    """Market rows having at least one inventory stone with the identical
    profile (size range + shape/color/clarity/cut/polish/symmetry/fluorescence/
    lab; carat and country are not keys). Both inputs must already carry ``size_range``."""
    keys = [k for k in dims.PROFILE_KEYS if k in market.columns and k in inventory.columns]
    return market.join(inventory.select(*keys).distinct(), keys, "left_semi")


def profile_comparables(market: DataFrame, inventory: DataFrame, order: list[str]) -> DataFrame:
    """Comparable market rows, deduplicated by market id (keep last)."""
    comparable = comparable_listings(market, inventory)
    return keep_last(comparable, [*(["shape_sel"] if "shape_sel" in market.columns else []), "stone_id"], order)


def pair_match_last(inventory: DataFrame, market: DataFrame, order: list[str], syncs: dict[str, Column] | None = None) -> DataFrame:
    """(legacy) inner 10-key match where the last market listing per key wins. With
    ``syncs`` (name -> the market listings it holds) one aggregate and one join serve them
    all, one row a sync and matched stone, named in ``sync``."""
    keys = join_keys(market, inventory)
    listing = F.struct("price", *[c for c in order if c != "price" and c in market.columns], "stone_id")
    held = syncs or {"sync": F.lit(True)}
    last = positive_price(market).groupBy(*keys).agg(*[F.max(F.when(rows, listing)).alias(f"_last_{name}") for name, rows in held.items()])
    found = F.array_compact(F.array(*[F.when(F.col(f"_last_{name}").isNotNull(), F.struct(
        F.lit(name).alias("sync"), F.col(f"_last_{name}.stone_id").alias("market_stone_id"), F.col(f"_last_{name}.price").alias("market_price"))) for name in held]))
    pairs = positive_price(inventory).join(last.select(*keys, found.alias("_found")), keys, "inner").withColumn("_found", F.explode("_found"))
    return pairs.select("*", "_found.*").drop("_found", *([] if syncs else ["sync"]))
