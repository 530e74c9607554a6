"""Building blocks shared by the named queries: canonical feeds over a
driver-table folder, matched stock, selling intelligence."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.operators import matching, selling
from facetwise.operators.sales import dedupe_sales
from facetwise.sources import feeds
from facetwise.sources.ingest import canonical_listings, resolve_sales
from facetwise.sources.snapshots import snapshot

SRC_COLS = ["src_part", "src_supp", "src_line", "src_amount", "src_disc", "src_tax"]
TIEBREAK = ["stone_id", "price", *[c for c in SRC_COLS if c != "src_line"]]


def build_market(spark: SparkSession, d: str) -> DataFrame:
    return canonical_listings(feeds.market_feed(spark, d), "market")


def build_inventory(spark: SparkSession, d: str) -> DataFrame:
    return canonical_listings(feeds.inventory_feed(spark, d), "inventory")


def build_sales(spark: SparkSession, d: str) -> DataFrame:
    return resolve_sales(feeds.sales_feed(spark, d))


def market(spark: SparkSession, d: str) -> DataFrame:
    """Canonical market listings (snapshot)."""
    return snapshot(spark, d, "market", build_market)


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, d, "inventory", build_inventory)


def sales(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, d, "sales", build_sales)


def sales_last(spark: SparkSession, d: str) -> DataFrame:
    """Sales with the last line per (invoice, stone), deduplicated once for all readers."""
    return snapshot(spark, d, "sales_last", lambda s, x: dedupe_sales(sales(s, x), feeds.SALES_ORDER))


def compute_matched(spark: SparkSession, d: str) -> DataFrame:
    return matching.exact_match(inventory(spark, d), market(spark, d))


def compute_selling(spark: SparkSession, d: str, config: dict | None = None) -> DataFrame:
    return selling.selling_intelligence(compute_matched(spark, d), config)


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Matched stock with selling intelligence (the matched snapshot)."""
    return snapshot(spark, d, "matched", lambda s, x: compute_selling(s, x))


def selling_rows(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d)


STONE_COLS = ["stone_id", "shape", "carat", "color", "clarity", "cut", "polish", "symmetry", "fluorescence", "lab",
              "country", "price", "status"]


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c) for c in cols])
