"""Ingest of uploaded text exports, from unknown files to the feeds of each role."""
from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.plans import sqlparts as S
from facetwise.plans.exports import HEADER_LINES, HEADS, export_name, export_of, written_exports
from facetwise.plans.registry import register
from facetwise.sources import uploads
from facetwise.sources.ingest import canonical_listings, normalize_headers, resolve_listing, resolve_sales

S.add("export_rows", ["market_raw", "inventory_raw", "sales_raw"], """SELECT 'upload_a' AS name, 'market' AS role, count(*) AS n FROM market_raw WHERE status = 'ON HAND'
  UNION ALL SELECT 'upload_b', 'market', count(*) FROM market_raw WHERE status <> 'ON HAND'
  UNION ALL SELECT 'stock_page', 'inventory', count(*) FROM inventory_raw WHERE src_line % 2 = 0
  UNION ALL SELECT 'nightly_stock', 'inventory', count(*) FROM inventory_raw WHERE src_line % 2 <> 0
  UNION ALL SELECT 'upload_d', 'sales', count(*) FROM sales_raw
  UNION ALL SELECT 'remarks', NULL, count(*) FROM nation""")
BELOW = {"stock_page": 2}  # empty lines below the data


def _names(header: str) -> str:
    blank = [c if c.strip() else f"col_{i}" for i, c in enumerate(header.split(","))]
    return "|".join(normalize_headers(blank))


def uploaded(spark, d):
    lines = uploads.numbered_lines(spark, written_exports(spark, d), export_of)
    return lines, uploads.describe(lines, export_name)


@register("header_row_detect", S.with_ctes("SELECT e.name, h.header_line, h.names, e.n + h.below AS lines, e.role FROM export_rows e JOIN (VALUES " + ", ".join(
    f"('{n}', {HEADER_LINES[n]}, '{_names(h)}', {BELOW.get(n, 0)})" for n, (_, h) in HEADS.items()) + ") h(name, header_line, names, below) USING (name)", "export_rows"))
def header_row_detect(spark, d):
    """Header line, normalised headers and role of every uploaded file."""
    _, files = uploaded(spark, d)
    return files.select("name", "header_line", F.array_join("names", "|").alias("names"), "lines", "role")


MARKET_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {a}" for c, a in [("stone_id", "stone_id"), ("shape_raw", "shape"), ("carat_raw", "carat"), ("color_raw", "color"), ("price_raw", "price")])


@register("feed_union", S.with_ctes(f"""SELECT {MARKET_TEXT}, country_raw AS location, CAST(NULL AS VARCHAR) AS blank_header, status, CAST(NULL AS VARCHAR) AS status_2 FROM market_raw WHERE status = 'ON HAND'
  UNION ALL SELECT {MARKET_TEXT}, NULL, 'x, y', status, 'a "b"' FROM market_raw WHERE status <> 'ON HAND'""", "market_raw"))
def feed_union(spark, d):
    """The market role: two files with other columns under the union of their headers,
    missing cells null, every column a string."""
    lines, files = uploaded(spark, d)
    feed = uploads.role_feed(uploads.rows_of(lines, files), files, "market")
    return feed.select(F.col("unique stone id").alias("stone_id"), "shape", F.col("weight").alias("carat"), "color", F.col("total").alias("price"),
                       F.col("stone location").alias("location"), F.col("col_10").alias("blank_header"), "status", "status_2")


@register("ingest_status", S.with_ctes("""SELECT role AS source, 'loaded' AS state, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows FROM export_rows WHERE role IN ('market', 'inventory') GROUP BY role
  UNION ALL SELECT 'sales', 'missing', 0, 0 UNION ALL SELECT 'remarks', 'ignored', 1, 0""", "export_rows"))
def ingest_status(spark, d):
    """Roles found and missing, and files ignored, when the sales file did not arrive."""
    lines, files = uploaded(spark, d)
    files = files.where(F.col("name") != "upload_d")
    return uploads.status(files, uploads.rows_of(lines, files))


@register("uploaded_listings", S.with_ctes("""SELECT 'market' AS role, stone_id, shape, carat, color, clarity, cut, fluorescence, price FROM market
  UNION ALL SELECT 'inventory', stone_id, shape, carat, color, clarity, cut, fluorescence, price FROM inventory""", "market", "inventory"))
def uploaded_listings(spark, d):
    """Text exports through the whole ingest: header, role, union, aliases, canonical values."""
    lines, files = uploaded(spark, d)
    rows = uploads.rows_of(lines, files)
    cols = ["stone_id", "shape", "carat", "color", "clarity", "cut", "fluorescence", "price"]
    found = [canonical_listings(uploads.role_feed(rows, files, role), role).select(F.lit(role).alias("role"), *cols) for role in ("market", "inventory")]
    return found[0].unionByName(found[1])


@register("uploaded_sales", S.with_ctes("SELECT invoice, stone, sale_date, shape, color, clarity, carat, amount, rate FROM sales", "sales"))
def uploaded_sales(spark, d):
    """The sales export, with dates as day/month/year and amounts with a currency sign."""
    lines, files = uploaded(spark, d)
    feed = uploads.role_feed(uploads.rows_of(lines, files), files, "sales")
    return resolve_sales(feed.drop("_row")).select("invoice", "stone", "sale_date", "shape", "color", "clarity", "carat", "amount", "rate")


@register("synthesised_ids", S.with_ctes("""SELECT 'DMX-' || row_number() OVER (ORDER BY part, line) AS stone_id, shape, color FROM (
    SELECT CASE WHEN src_line % 2 <> 0 THEN 0 ELSE 1 END AS part, shape_raw AS shape, color_raw AS color, concat_ws(',', stone_id, shape_raw,
      carat_raw, color_raw, clarity_raw, cut_raw, polish_raw, symmetry_raw, fluorescence_raw, lab_raw, country_raw, price_raw, status) AS line FROM inventory_raw) t""", "inventory_raw"))
def synthesised_ids(spark, d):
    """Inventory files without an id column: ids from the stable row numbers of the upload."""
    lines, files = uploaded(spark, d)
    feed = uploads.role_feed(uploads.rows_of(lines, files), files, "inventory").drop("stock #")
    return resolve_listing(feed, "inventory").select("stone_id", "shape", "color")
