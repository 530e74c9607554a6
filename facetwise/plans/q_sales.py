"""Sales family: dedupe, cohorts, stock x sales, size distribution, shape report."""
from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.operators import sales as SA
from facetwise.plans import base
from facetwise.plans import sqlparts as S
from facetwise.plans.registry import register
from facetwise.sources import feeds

COH = ", ".join(dims.COHORT_KEYS)
SALE_COLS = ["invoice", "stone", "sale_date", "shape", "color", "clarity", "carat", "amount", "rate"]

S.add("sales_d", ["sales"], f"""SELECT * FROM sales
  QUALIFY row_number() OVER (PARTITION BY invoice, stone ORDER BY {S.SALES_ORDER_DESC}) = 1""")
S.add("sales_binned", ["sales_d"], f"""SELECT * FROM (
    SELECT *, {S.size_range('carat')} AS size_range, coalesce(amount, rate * carat, 0.0) AS value
    FROM sales_d WHERE carat IS NOT NULL AND carat <> 0) t
  WHERE size_range IS NOT NULL AND coalesce(shape <> '', false) AND coalesce(color <> '', false)
    AND coalesce(clarity <> '', false)""")
S.add("sales_coh", ["sales_binned"], f"""SELECT {COH}, count(*) AS sold_stones, sum(carat) AS sold_carats,
    sum(value) AS sales_value FROM sales_binned GROUP BY {COH}""")
S.add("stock_coh", ["matched"], f"""SELECT {COH}, count(*) AS stock_pcs, sum(carat) AS stock_carats,
    sum(coalesce(price, 0.0)) AS stock_value,
    sum(CASE WHEN market_bottom_price IS NOT NULL THEN market_bottom_price ELSE 0.0 END) AS market_value,
    sum(CASE WHEN market_bottom_price IS NOT NULL THEN carat ELSE 0.0 END) AS market_carats
  FROM (SELECT *, {S.size_range('carat')} AS size_range FROM matched) t WHERE size_range IS NOT NULL GROUP BY {COH}""")


def rate_sql(num: str, den: str) -> str:
    r = f"(CASE WHEN {den} <> 0 THEN {num} / {den} END)"
    return f"CASE WHEN coalesce({r} <> 0, false) THEN {S.rnd(r)} END"


S.add("stock_sales", ["stock_coh", "sales_coh"], f"""SELECT {', '.join(f'coalesce(s.{k}, l.{k}) AS {k}' for k in dims.COHORT_KEYS)},
    coalesce(s.stock_pcs, 0) AS stock_pcs, coalesce(l.sold_stones, 0) AS sold_pcs,
    CASE WHEN coalesce(s.stock_pcs, 0) > 0 THEN {S.rnd('coalesce(l.sold_stones, 0) / s.stock_pcs * 100.0', 1)} END AS sales_pct,
    {rate_sql('s.stock_value', 's.stock_carats')} AS current_rate,
    {rate_sql('l.sales_value', 'l.sold_carats')} AS historical_rate,
    {rate_sql('s.market_value', 's.market_carats')} AS vdb_rate
  FROM stock_coh s FULL OUTER JOIN sales_coh l ON {S.eqj('s', 'l', dims.COHORT_KEYS)}""")


def sales_deduped(spark, d):
    return base.sales_last(spark, d)


def sales_cohorts_df(spark, d):
    return SA.sales_cohorts(sales_deduped(spark, d))


def stock_cohorts_df(spark, d):
    return SA.stock_cohorts(base.matched(spark, d))


def stock_sales_df(spark, d):
    return SA.stock_sales_cohorts(stock_cohorts_df(spark, d), sales_cohorts_df(spark, d))


COH_OUT = f"{COH}, sold_stones, {S.rnd('sold_carats', 2, True)} AS sold_carats, {S.rnd('sales_value', 2, True)} AS sales_value"


def _coh_out(df):
    return df.select(*dims.COHORT_KEYS, "sold_stones", SA.rnd(F.col("sold_carats"), 2, True).alias("sold_carats"),
                     SA.rnd(F.col("sales_value"), 2, True).alias("sales_value"))


@register("dedupe_sales", S.with_ctes(f"SELECT {', '.join(SALE_COLS)} FROM sales_d", "sales_d"))
def dedupe_sales(spark, d):
    return sales_deduped(spark, d).select(*SALE_COLS)


S.add("sales_nd", ["sales"], f"""SELECT * FROM sales
  QUALIFY row_number() OVER (PARTITION BY stone, sale_date ORDER BY {S.SALES_ORDER_DESC}) = 1""")
NO_INV = [c for c in SALE_COLS if c != "invoice"]


@register("dedupe_sales_fallback", S.with_ctes(f"SELECT {', '.join(NO_INV)} FROM sales_nd", "sales_nd"))
def dedupe_sales_fallback(spark, d):
    """A sales export without an invoice column falls back to (stone, sale date)."""
    return SA.dedupe_sales_fallback(base.sales(spark, d).drop("invoice"), feeds.SALES_ORDER).select(*NO_INV)


@register("sale_value", S.with_ctes(
    "SELECT invoice, stone, carat, amount, rate, coalesce(amount, rate * carat, 0.0) AS value FROM sales", "sales"))
def sale_value(spark, d):
    s = base.sales(spark, d)
    return s.select("invoice", "stone", "carat", "amount", "rate", SA.sale_value(s).alias("value"))


@register("size_binning", S.with_ctes(
    f"SELECT stone_id, carat, {S.size_range('carat')} AS size_range FROM inventory", "inventory"))
def size_binning(spark, d):
    from facetwise.functions.exprs import size_range
    return base.inventory(spark, d).select("stone_id", "carat", size_range(F.col("carat")).alias("size_range"))


@register("sales_cohorts", S.with_ctes(f"SELECT {COH_OUT} FROM sales_coh", "sales_coh"))
def sales_cohorts(spark, d):
    return _coh_out(sales_cohorts_df(spark, d))


@register("sales_cohorts_filtered", S.with_ctes(
    f"SELECT {COH_OUT} FROM sales_coh WHERE shape = 'ROUND'", "sales_coh"))
def sales_cohorts_filtered(spark, d):
    """Sales cohorts under the dashboard filters (shape ROUND; the sales feed
    carries no quality grades, so grade filters leave it unchanged)."""
    from facetwise.functions.quality import shape_filter
    return _coh_out(SA.sales_cohorts(shape_filter(sales_deduped(spark, d), "ROUND")))


@register("stock_cohorts", S.with_ctes(
    f"""SELECT {COH}, stock_pcs, {S.rnd('stock_carats', 2, True)} AS stock_carats, {S.rnd('stock_value', 2, True)} AS stock_value,
    {S.rnd('market_value', 2, True)} AS market_value, {S.rnd('market_carats', 2, True)} AS market_carats FROM stock_coh""",
    "stock_coh"))
def stock_cohorts(spark, d):
    r = SA.rnd
    return stock_cohorts_df(spark, d).select(
        *dims.COHORT_KEYS, "stock_pcs", r(F.col("stock_carats"), 2, True).alias("stock_carats"),
        r(F.col("stock_value"), 2, True).alias("stock_value"), r(F.col("market_value"), 2, True).alias("market_value"),
        r(F.col("market_carats"), 2, True).alias("market_carats"))


@register("stock_sales_cohorts", S.with_ctes("SELECT * FROM stock_sales", "stock_sales"))
def stock_sales_cohorts(spark, d):
    return stock_sales_df(spark, d)


@register("cohort_key_union", S.with_ctes(
    f"SELECT {COH} FROM stock_coh UNION SELECT {COH} FROM sales_coh", "stock_coh", "sales_coh"))
def cohort_key_union(spark, d):
    return SA.cohort_key_union(stock_cohorts_df(spark, d), sales_cohorts_df(spark, d))


S.add("size_dist", ["sales_coh"], f"""SELECT sm.ordinal, sm.size_range, CAST(coalesce(s, 0) AS BIGINT) AS sold_stones,
    {S.rnd('coalesce(c, 0.0)', 2, True)} AS sold_carats, {S.rnd('coalesce(v, 0.0)', 2, True)} AS sales_value
  FROM {S.size_master_values()} LEFT JOIN (SELECT size_range, sum(sold_stones) s, sum(sold_carats) c, sum(sales_value) v
    FROM sales_coh GROUP BY size_range) x ON sm.size_range = x.size_range""")


@register("size_distribution", S.with_ctes("SELECT * FROM size_dist", "size_dist"))
def size_distribution(spark, d):
    return SA.size_distribution(spark, sales_cohorts_df(spark, d))


@register("size_heat", S.with_ctes(
    f"SELECT *, {S.rnd('sold_stones / greatest(max(sold_stones) OVER (), 1)', 4)} AS heat FROM size_dist", "size_dist"))
def size_heat(spark, d):
    return SA.size_heat(SA.size_distribution(spark, sales_cohorts_df(spark, d)))


def _shape_sql(total: bool) -> str:
    base_sql = """SELECT coalesce(s.shape, l.shape) AS shape, stock_pcs, sw, sa, sales_pcs, lw, la FROM
    (SELECT shape, count(*) AS stock_pcs, sum(carat) AS sw, sum(price) AS sa FROM matched GROUP BY shape) s
    FULL OUTER JOIN (SELECT shape, sum(sold_stones) AS sales_pcs, sum(sold_carats) AS lw, sum(sales_value) AS la
      FROM sales_coh WHERE coalesce(shape <> '', false) GROUP BY shape) l ON s.shape = l.shape"""
    if total:
        base_sql = f"""SELECT CASE WHEN grouping(shape) = 1 THEN 'TOTAL' ELSE shape END AS shape, sum(stock_pcs) AS stock_pcs,
      sum(sw) AS sw, sum(sa) AS sa, sum(sales_pcs) AS sales_pcs, sum(lw) AS lw, sum(la) AS la
    FROM ({base_sql}) j GROUP BY ROLLUP (shape)"""
    return f"""SELECT shape, CAST(coalesce(stock_pcs, 0) AS BIGINT) AS stock_pcs, {S.rnd('coalesce(sw, 0.0)', 2, True)} AS stock_weight,
    CASE WHEN coalesce(sw, 0.0) <> 0 THEN {S.rnd('coalesce(sa, 0.0) / coalesce(sw, 0.0)')} ELSE 0.0 END AS stock_rate,
    {S.rnd('coalesce(sa, 0.0)', 2, True)} AS stock_amount, CAST(coalesce(sales_pcs, 0) AS BIGINT) AS sales_pcs,
    {S.rnd('coalesce(lw, 0.0)', 2, True)} AS sales_weight,
    CASE WHEN coalesce(lw, 0.0) <> 0 THEN {S.rnd('coalesce(la, 0.0) / coalesce(lw, 0.0)')} ELSE 0.0 END AS sales_rate,
    {S.rnd('coalesce(la, 0.0)', 2, True)} AS sales_amount,
    CASE WHEN coalesce(stock_pcs, 0) > 0 THEN {S.rnd('coalesce(sales_pcs, 0) / coalesce(stock_pcs, 0) * 100.0', 1)} ELSE 0.0 END AS sales_percentage
  FROM ({base_sql}) r"""


S.add("shape_rep", ["matched", "sales_coh"], _shape_sql(False))


@register("shape_stock_vs_sales", S.with_ctes("SELECT * FROM shape_rep", "shape_rep"))
def shape_stock_vs_sales(spark, d):
    return SA.shape_stock_vs_sales(base.matched(spark, d), sales_cohorts_df(spark, d))


@register("shape_report_rollup", S.with_ctes(_shape_sql(True), "matched", "sales_coh"))
def shape_report_rollup(spark, d):
    return SA.shape_report_rollup(base.matched(spark, d), sales_cohorts_df(spark, d))


@register("shape_extremes", S.with_ctes("""SELECT
    min({'k': -sales_percentage, 's': shape}).s AS best_shape, max(sales_percentage) AS best_sales_pct,
    min({'k': sales_percentage, 's': shape}).s AS riskiest_shape, min(sales_percentage) AS riskiest_sales_pct
  FROM shape_rep""", "shape_rep"))
def shape_extremes(spark, d):
    return SA.shape_extremes(SA.shape_stock_vs_sales(base.matched(spark, d), sales_cohorts_df(spark, d)))


@register("top_bottom_sellers", S.with_ctes(f"""
  SELECT * FROM (SELECT {COH_OUT}, 'top' AS list, row_number() OVER (ORDER BY sold_stones DESC, {COH}) AS rank FROM sales_coh) WHERE rank <= 10
  UNION ALL
  SELECT * FROM (SELECT {COH_OUT}, 'bottom' AS list, row_number() OVER (ORDER BY sold_stones ASC, {COH}) AS rank FROM sales_coh) WHERE rank <= 10""",
    "sales_coh"))
def top_bottom_sellers(spark, d):
    return SA.top_bottom_sellers(sales_cohorts_df(spark, d), 10)


def _pref_case(e: str) -> str:
    whens = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(dims.PREFERRED_SHAPE_ORDER))
    return f"coalesce(CASE {e} {whens} END, {len(dims.PREFERRED_SHAPE_ORDER)})"


@register("available_shapes", S.with_ctes(f"""SELECT shape, row_number() OVER (ORDER BY {_pref_case('shape')}, shape) AS ordinal FROM (
  SELECT DISTINCT shape FROM (SELECT upper(trim(shape)) AS shape FROM market UNION ALL SELECT upper(trim(shape)) FROM inventory
    UNION ALL SELECT upper(trim(shape)) FROM sales) u WHERE coalesce(shape <> '', false)) t""", "market", "inventory", "sales"))
def available_shapes(spark, d):
    return SA.available_shapes(base.market(spark, d), base.inventory(spark, d), base.sales(spark, d))


@register("headline_metrics", S.with_ctes(f"""SELECT
    CASE WHEN coalesce(n, 0) > 0 THEN CAST(n AS BIGINT) ELSE raw END AS sales_records,
    {S.rnd('coalesce(w, 0.0)', 2, True)} AS sales_carats, {S.rnd('coalesce(v, 0.0)', 2, True)} AS sales_value,
    inv AS ev_stock, CAST(coalesce(n, 0) AS BIGINT) AS ev_sold
  FROM (SELECT sum(sold_stones) n, sum(sold_carats) w, sum(sales_value) v FROM sales_coh) a,
       (SELECT count(*) inv FROM inventory) b, (SELECT count(*) raw FROM sales) c""", "sales_coh", "inventory", "sales"))
def headline_metrics(spark, d):
    return SA.headline_metrics(sales_cohorts_df(spark, d), base.inventory(spark, d), base.sales(spark, d))
