"""Feed views over the driver tables.

The driver tables hold no stone listings, so three supplier-style exports are
derived from them deterministically (the same mapping is written in the SQL
oracle). Base: lineitem joined to part and supplier (+ nation, region);
``l_returnflag`` routes a line to a feed: R -> inventory, N -> market,
A -> sales (sales also join orders for the sale date).

Headers are export-style ("Unique Stone ID", "Weight", "Total" ...) so the
alias resolver and canonicaliser run on every query, as they do on real feeds.
Columns ``src_*`` carry the source line identity used as the explicit
"file order" for keep-last dedupes.

Scale notes: the lineitem filter is pushed into the parquet scan; part and
supplier joins are equi-joins that AQE turns into broadcasts only when the
runtime size is under the broadcast threshold; market and inventory never
touch orders.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.functions.exprs import rnd
from facetwise.sources.tables import read_table

# FIXED VALUES of the feed mapping (shared with the SQL oracle).
SHAPE_BY_TYPE = {"ECONOMY": "RD", "SMALL": "OV", "MEDIUM": "SQ EMERALD", "PROMO": "LONG RADIANT",
                 "STANDARD": " pear "}
SHAPE_OTHER = "CU"
COLOR_LETTERS = "DEFGHIJK"
CLARITY_BY_MOD7 = ["IF", "VVS1", "VVS2", "VS1", "VS2", "SI1", "SI2"]
CUT_BY_MOD3 = ["EX", "ID", "VG"]
POLISH_BY_BIT = ["EXCELLENT", "VG"]
SYMMETRY_BY_BIT = ["ID", "EX"]
FLUO_BY_MOD4 = ["NON", "FNT", "MED", "STG"]
LAB_BY_MOD2 = ["IGI", "GIA"]


def _pick(values: list[str], idx: Column) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def raw_shape(p_type: Column) -> Column:
    word = F.split(p_type, " ").getItem(0)
    expr = None
    for k, v in SHAPE_BY_TYPE.items():
        expr = F.when(word == k, F.lit(v)) if expr is None else expr.when(word == k, F.lit(v))
    return expr.otherwise(F.lit(SHAPE_OTHER))


def feed_carat(p_size: Column) -> Column:
    return (F.lit(60) + p_size * 9) / F.lit(100)


def _stone_lines(spark: SparkSession, sf_dir: str, flag: str, with_supplier: bool = True) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount",
                     "l_tax", "l_returnflag", "l_linestatus"]).where(F.col("l_returnflag") == flag)
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size", "p_retailprice"])
    df = li.join(part, li.l_partkey == part.p_partkey)
    if with_supplier:
        # left-deep from the fact side: each dimension is a scan whose size the
        # planner knows, so small ones broadcast statically and large ones
        # (supplier at big scale factors) fall back to a shuffle join.
        supp = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
        nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
        region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
        df = (df.join(supp, df.l_suppkey == supp.s_suppkey)
              .join(nation, F.col("s_nationkey") == nation.n_nationkey)
              .join(region, F.col("n_regionkey") == region.r_regionkey))
    return df


def _attributes(df: DataFrame) -> list[Column]:
    pk = F.col("p_partkey")
    carat = feed_carat(F.col("p_size"))
    return [
        raw_shape(F.col("p_type")).alias("Shape"),
        carat.alias("Weight"),
        F.substring(F.lit(COLOR_LETTERS), (pk % 8 + 1).cast("int"), 1).alias("Color"),
        _pick(CLARITY_BY_MOD7, pk % 7).alias("Clarity"),
        _pick(CUT_BY_MOD3, pk % 3).alias("Cut"),
        _pick(POLISH_BY_BIT, F.floor(pk / 3) % 2).alias("Polish"),
        _pick(SYMMETRY_BY_BIT, F.floor(pk / 6) % 2).alias("Symmetry"),
        _pick(FLUO_BY_MOD4, F.floor(pk / 12) % 4).alias("Fluorescence"),
        _pick(LAB_BY_MOD2, F.col("l_suppkey") % 2).alias("Lab"),
    ]


def _src(df: DataFrame) -> list[Column]:
    return [F.col("l_partkey").alias("src_part"), F.col("l_suppkey").alias("src_supp"),
            F.col("l_linenumber").alias("src_line"), F.col("l_extendedprice").alias("src_amount"),
            F.col("l_discount").alias("src_disc"), F.col("l_tax").alias("src_tax")]


def market_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitor listings export (returnflag N)."""
    df = _stone_lines(spark, sf_dir, "N")
    carat = feed_carat(F.col("p_size"))
    return df.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("Unique Stone ID"),
        *_attributes(df),
        F.col("r_name").alias("Stone Location"),
        rnd(F.col("p_retailprice") * carat * (F.lit(0.97).cast("double") + F.col("l_tax"))).alias("Total"),
        F.when(F.col("l_linestatus") == "O", F.lit("ON HAND")).otherwise(F.lit("MEMO")).alias("Status"),
        *_src(df),
    )


def inventory_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own stock export (returnflag R)."""
    df = _stone_lines(spark, sf_dir, "R")
    carat = feed_carat(F.col("p_size"))
    return df.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("Packet #"),
        *_attributes(df),
        F.col("r_name").alias("Location"),
        rnd(F.col("p_retailprice") * carat * (F.lit(1.0) - F.col("l_discount"))).alias("Price A"),
        F.when(F.col("l_linestatus") == "O", F.lit("AVAILABLE")).otherwise(F.lit("MEMO")).alias("Status"),
        *_src(df),
    )


def sales_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed-sale invoice lines (returnflag A) with the order date."""
    df = _stone_lines(spark, sf_dir, "A", with_supplier=False)
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    df = df.join(orders, df.l_orderkey == orders.o_orderkey)
    pk = F.col("p_partkey")
    carat = feed_carat(F.col("p_size"))
    amount = rnd(F.col("p_retailprice") * carat * (F.lit(1.0) - F.col("l_discount")))
    return df.select(
        F.col("l_orderkey").cast("string").alias("Invoice No"),
        F.col("l_partkey").cast("string").alias("Stone No"),
        F.col("o_orderdate").alias("Sale Date"),
        raw_shape(F.col("p_type")).alias("Shape"),
        F.substring(F.lit(COLOR_LETTERS), (pk % 8 + 1).cast("int"), 1).alias("Color"),
        _pick(CLARITY_BY_MOD7, pk % 7).alias("Clarity"),
        carat.alias("Carat"),
        amount.alias("Sale Amt"),
        rnd(amount / carat).alias("Sale Rate"),
        *_src(df),
    )


LISTING_ORDER = ["price", "src_amount", "src_part", "src_supp", "src_disc", "src_tax", "status"]
SALES_ORDER = ["src_line", "src_supp", "src_amount", "src_disc", "src_tax"]
