"""Canonicalisation and filter operators over (string re-encodings of) the feeds."""
from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions import exprs as X
from facetwise.functions.quality import live_status_filter, quality_filter, shape_filter
from facetwise.functions.stats import keep_last, median_of, nearest_rank_by_key
from facetwise.operators import matching
from facetwise.plans import base
from facetwise.plans import sqlparts as S
from facetwise.plans.registry import register
from facetwise.sources import feeds
from facetwise.sources.ingest import resolve_listing

LC = ", ".join(base.STONE_COLS)


@register("canonical_shape", S.with_ctes(
    f"SELECT stone_id, shape_raw, {S.canon_shape('shape_raw')} AS shape FROM inventory_raw", "inventory_raw"))
def canonical_shape(spark, d):
    raw = feeds.inventory_feed(spark, d)
    return raw.select(F.col("`Packet #`").alias("stone_id"), F.col("Shape").alias("shape_raw"),
                      X.canon_shape(F.col("Shape")).alias("shape"))


@register("canonical_grades", S.with_ctes(f"""SELECT stone_id, cut_raw, polish_raw, symmetry_raw, fluorescence_raw,
    {S.map_or_self('cut_raw', dims.CUT_MAP)} AS cut, {S.map_or_self('polish_raw', dims.CUT_MAP)} AS polish,
    {S.map_or_self('symmetry_raw', dims.CUT_MAP)} AS symmetry,
    {S.map_or_self('fluorescence_raw', dims.FLUORESCENCE_MAP)} AS fluorescence FROM market_raw""", "market_raw"))
def canonical_grades(spark, d):
    raw = feeds.market_feed(spark, d)
    return raw.select(F.col("`Unique Stone ID`").alias("stone_id"), F.col("Cut").alias("cut_raw"),
                      F.col("Polish").alias("polish_raw"), F.col("Symmetry").alias("symmetry_raw"),
                      F.col("Fluorescence").alias("fluorescence_raw"),
                      X.map_or_self(dims.CUT_MAP, "Cut").alias("cut"), X.map_or_self(dims.CUT_MAP, "Polish").alias("polish"),
                      X.map_or_self(dims.CUT_MAP, "Symmetry").alias("symmetry"),
                      X.map_or_self(dims.FLUORESCENCE_MAP, "Fluorescence").alias("fluorescence"))


# ---- string re-encodings of numbers and dates (variant chosen per source line)

def money_text_spark(price, line):
    s = price.cast("string")
    return (F.when(line % 4 == 0, F.concat(F.lit("$"), s))
            .when(line % 4 == 1, F.regexp_replace(s, r"^(\d+)(\d{3})\.", "$1,$2."))
            .when(line % 4 == 2, F.concat(F.lit("  "), s, F.lit(" ")))
            .otherwise(F.lit("n/a")))


def money_text_sql(price: str, line: str) -> str:
    s = f"CAST({price} AS VARCHAR)"
    return (f"CASE WHEN {line} % 4 = 0 THEN '$' || {s} WHEN {line} % 4 = 1 THEN regexp_replace({s}, '^(\\d+)(\\d{{3}})\\.', '\\1,\\2.') "
            f"WHEN {line} % 4 = 2 THEN '  ' || {s} || ' ' ELSE 'n/a' END")


@register("clean_money", S.with_ctes(
    f"SELECT stone_id, price_text, {S.clean_number('price_text')} AS price FROM "
    f"(SELECT stone_id, {money_text_sql('price', 'src_line')} AS price_text FROM inventory) t", "inventory"))
def clean_money(spark, d):
    inv = base.inventory(spark, d)
    t = inv.select("stone_id", money_text_spark(F.col("price"), F.col("src_line")).alias("price_text"))
    return t.select("stone_id", "price_text", X.clean_number("price_text").alias("price"))


@register("price_default_cast", S.with_ctes(
    f"SELECT stone_id, price_text, coalesce(TRY_CAST(price_text AS DOUBLE), 0.0) AS price FROM "
    f"(SELECT stone_id, {money_text_sql('price', 'src_line')} AS price_text FROM inventory) t", "inventory"))
def price_default_cast(spark, d):
    """Non-strict cast of an inventory price column holding text; invalid -> 0."""
    inv = base.inventory(spark, d)
    t = inv.select(F.col("stone_id").alias("Packet #"),
                   money_text_spark(F.col("price"), F.col("src_line")).alias("Price A"))
    r = resolve_listing(t.withColumn("price_text", F.col("`Price A`")), "inventory")
    return r.select("stone_id", "price_text", "price")


def date_text_spark(d, line):
    return (F.when(line % 4 == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T07:08:09Z")))
            .when(line % 4 == 1, F.date_format(d, "dd/MM/yyyy"))
            .when(line % 4 == 2, F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.lit("unknown")))


def date_text_sql(d: str, line: str) -> str:
    return (f"CASE WHEN {line} % 4 = 0 THEN strftime({d}, '%Y-%m-%d') || 'T07:08:09Z' "
            f"WHEN {line} % 4 = 1 THEN strftime({d}, '%d/%m/%Y') WHEN {line} % 4 = 2 THEN strftime({d}, '%m/%d/%Y') "
            f"ELSE 'unknown' END")


def parse_date_sql(s: str) -> str:
    t = f"trim({s})"
    return (f"CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(substr({t}, 1, 10) AS DATE) "
            f"WHEN regexp_matches({t}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN CAST(coalesce(try_strptime({t}, '%d/%m/%Y'), "
            f"try_strptime({t}, '%m/%d/%Y')) AS DATE) END")


@register("parse_sale_date", S.with_ctes(
    f"SELECT invoice, stone, date_text, {parse_date_sql('date_text')} AS sale_date FROM "
    f"(SELECT invoice, stone, {date_text_sql('sale_date', 'src_line')} AS date_text FROM sales) t", "sales"))
def parse_sale_date(spark, d):
    s = base.sales(spark, d)
    t = s.select("invoice", "stone", date_text_spark(F.col("sale_date"), F.col("src_line")).alias("date_text"))
    return t.select("invoice", "stone", "date_text", X.parse_date(F.col("date_text")).alias("sale_date"))


@register("coalesce_columns", S.with_ctes(
    f"""SELECT invoice, stone, coalesce(upper(trim(shape_a)), upper(trim(shape_b))) AS shape,
    coalesce(TRY_CAST(carat_a AS DOUBLE), TRY_CAST(carat_b AS DOUBLE)) AS carat FROM (
    SELECT invoice, stone, CASE WHEN src_line % 2 = 0 THEN shape END AS shape_a, shape AS shape_b,
      CASE WHEN src_line % 3 = 0 THEN CAST(carat AS VARCHAR) END AS carat_a, carat AS carat_b FROM sales) t""", "sales"))
def coalesce_columns(spark, d):
    """First non-null over several candidate columns (text and number)."""
    s = base.sales(spark, d).select(
        "invoice", "stone", F.when(F.col("src_line") % 2 == 0, F.col("shape")).alias("shape_a"),
        F.col("shape").alias("shape_b"), F.when(F.col("src_line") % 3 == 0, F.col("carat").cast("string")).alias("carat_a"),
        F.col("carat").alias("carat_b"))
    return s.select("invoice", "stone", F.coalesce(X.norm_text("shape_a"), X.norm_text("shape_b")).alias("shape"),
                    F.coalesce(F.col("carat_a").try_cast("double"), F.col("carat_b").try_cast("double")).alias("carat"))


@register("market_ppc", S.with_ctes(
    "SELECT stone_id, carat, price, CASE WHEN carat <> 0 THEN price / carat END AS ppc FROM market", "market"))
def market_ppc(spark, d):
    m = base.market(spark, d)
    ppc = F.col("ppc").try_cast("double") if "ppc" in m.columns else X.safe_div(F.col("price"), F.col("carat"))
    return m.select("stone_id", "carat", "price", ppc.alias("ppc"))


@register("parse_range_label", S.with_ctes("""SELECT size_range,
    CASE WHEN len(string_split(size_range, '-')) = 2 THEN TRY_CAST(trim(string_split(size_range, '-')[1]) AS DOUBLE) END AS lo,
    CASE WHEN len(string_split(size_range, '-')) = 2 THEN TRY_CAST(trim(string_split(size_range, '-')[2]) AS DOUBLE) END AS hi
  FROM (SELECT DISTINCT size_range FROM sales_coh) t""", "sales_coh"))
def parse_range_label(spark, d):
    from facetwise.plans.q_sales import sales_cohorts_df
    labels = sales_cohorts_df(spark, d).select("size_range").distinct()
    lo, hi = X.parse_range_label(F.col("size_range"))
    return labels.select("size_range", lo.alias("lo"), hi.alias("hi"))


ALIAS_OUT = ["stone_id", "shape", "carat", "color", "clarity", "cut", "polish", "symmetry", "fluorescence", "lab",
             "country", "price", "status"]


@register("alias_resolve", S.with_ctes(
    "SELECT stone_id, shape_raw AS shape, carat_raw AS carat, color_raw AS color, clarity_raw AS clarity, cut_raw AS cut, "
    "polish_raw AS polish, symmetry_raw AS symmetry, fluorescence_raw AS fluorescence, lab_raw AS lab, "
    "country_raw AS country, coalesce(TRY_CAST(price_raw AS DOUBLE), 0.0) AS price, status FROM market_raw", "market_raw"))
def alias_resolve(spark, d):
    return resolve_listing(feeds.market_feed(spark, d), "market").select(*ALIAS_OUT)


KEPT_HEADERS = {a for aliases in dims.LISTING_ALIASES.values() for a in aliases} | {"status", "availability"}


@register("feed_column_prune", S.with_ctes(
    "SELECT stone_id AS \"Unique Stone ID\", shape_raw AS \"Shape\", carat_raw AS \"Weight\", color_raw AS \"Color\", "
    "clarity_raw AS \"Clarity\", cut_raw AS \"Cut\", polish_raw AS \"Polish\", symmetry_raw AS \"Symmetry\", "
    "fluorescence_raw AS \"Fluorescence\", lab_raw AS \"Lab\", country_raw AS \"Stone Location\", price_raw AS \"Total\", "
    "status AS \"Status\" FROM market_raw", "market_raw"))
def feed_column_prune(spark, d):
    """Keep only headers in the alias set (plus status/availability); the
    parquet/CSV reader then prunes the unread columns at the scan."""
    raw = feeds.market_feed(spark, d)
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns if c.strip().lower() in KEPT_HEADERS])


@register("live_status_filter", S.with_ctes(
    f"SELECT 'market' AS side, {LC} FROM market WHERE upper(trim(status)) = 'ON HAND' "
    f"UNION ALL SELECT 'inventory' AS side, {LC} FROM inventory WHERE upper(trim(status)) = 'AVAILABLE'",
    "market", "inventory"))
def live_status_filter_q(spark, d):
    m = live_status_filter(base.market(spark, d), "market").select(F.lit("market").alias("side"), *base.STONE_COLS)
    i = live_status_filter(base.inventory(spark, d), "inventory").select(F.lit("inventory").alias("side"), *base.STONE_COLS)
    return m.unionByName(i)


QUALITY = {"cut": "3X", "fluorescence": "NONE", "lab": "GIA", "country": "ASIA"}


@register("quality_filter", S.with_ctes(
    f"SELECT 'market' AS side, {LC} FROM market WHERE cut = 'EXCELLENT' AND polish = 'EXCELLENT' AND symmetry = 'EXCELLENT' "
    f"AND fluorescence = 'NONE' AND lab = 'GIA' AND country = 'ASIA' "
    f"UNION ALL SELECT 'inventory' AS side, {LC} FROM inventory WHERE cut = 'EXCELLENT' AND polish = 'EXCELLENT' "
    f"AND symmetry = 'EXCELLENT' AND fluorescence = 'NONE' AND lab = 'GIA'", "market", "inventory"))
def quality_filter_q(spark, d):
    """3X (cut, polish, symmetry EXCELLENT) + fluorescence NONE + lab GIA +
    country ASIA; country selects the market only, never inventory."""
    m = quality_filter(base.market(spark, d), QUALITY, "market").select(F.lit("market").alias("side"), *base.STONE_COLS)
    i = quality_filter(base.inventory(spark, d), QUALITY, "inventory").select(
        F.lit("inventory").alias("side"), *base.STONE_COLS)
    return m.unionByName(i)


@register("shape_filter", S.with_ctes(f"SELECT {LC} FROM matched WHERE shape = 'ROUND'", "matched"))
def shape_filter_q(spark, d):
    return shape_filter(base.matched(spark, d), "ROUND").select(*base.STONE_COLS)


@register("dedupe_listings", S.with_ctes(
    f"SELECT {LC} FROM market QUALIFY row_number() OVER (PARTITION BY stone_id ORDER BY {S.LISTING_ORDER_DESC}) = 1",
    "market"))
def dedupe_listings(spark, d):
    return matching.dedupe_listings(base.market(spark, d), feeds.LISTING_ORDER).select(*base.STONE_COLS)


@register("nearest_quantile", S.with_ctes("""SELECT shape, color, price AS p10_price FROM (
    SELECT shape, color, price, row_number() OVER (PARTITION BY shape, color ORDER BY price) AS rn,
      count(*) OVER (PARTITION BY shape, color) AS n FROM market WHERE price IS NOT NULL AND shape IS NOT NULL AND color IS NOT NULL) t
  WHERE rn - 1 = floor(CAST(n - 1 AS DOUBLE) * CAST(0.1 AS DOUBLE) + 0.5)""", "market"))
def nearest_quantile(spark, d):
    """Exact nearest-rank 10th percentile of market price per (shape, color)."""
    return nearest_rank_by_key(base.market(spark, d), ["shape", "color"], "price", 0.10, "p10_price")


def median_sql(a: str, b: str, c: str) -> str:
    return f"list_median(list_filter([{a}, {b}, {c}], lambda x: x IS NOT NULL))"


@register("median_evidence", S.with_ctes(
    f"""SELECT {', '.join(dims.COHORT_KEYS)}, historical_rate, vdb_rate, current_rate,
    (SELECT CASE WHEN len(l) = 0 THEN NULL WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1]
       ELSE (l[len(l) // 2] + l[len(l) // 2 + 1]) / 2 END
     FROM (SELECT list_sort(list_filter([historical_rate, vdb_rate, current_rate], lambda x: x IS NOT NULL)) AS l)) AS median_rate
  FROM stock_sales""", "stock_sales"))
def median_evidence(spark, d):
    from facetwise.plans.q_sales import stock_sales_df
    s = stock_sales_df(spark, d)
    return s.select(*dims.COHORT_KEYS, "historical_rate", "vdb_rate", "current_rate",
                    median_of(F.col("historical_rate"), F.col("vdb_rate"), F.col("current_rate")).alias("median_rate"))


@register("price_band", S.with_ctes(
    f"SELECT {', '.join(dims.COHORT_KEYS)}, sales_pct, {S.price_band('sales_pct')} AS price_adjustment FROM stock_sales",
    "stock_sales"))
def price_band(spark, d):
    from facetwise.plans.q_sales import stock_sales_df
    s = stock_sales_df(spark, d)
    return s.select(*dims.COHORT_KEYS, "sales_pct", X.price_band(F.col("sales_pct")).alias("price_adjustment"))
