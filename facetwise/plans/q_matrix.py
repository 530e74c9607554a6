"""Carat matrix family."""
from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import dims
from facetwise.functions.exprs import rnd
from facetwise.functions.quality import live_status_filter, quality_filter, shape_filter
from facetwise.operators import evidence as EV
from facetwise.operators import matching
from facetwise.operators import matrix as MX
from facetwise.plans import base, fixtures
from facetwise.plans import sqlparts as S
from facetwise.operators.sales import sales_cohorts
from facetwise.plans.q_sales import sales_cohorts_df, sales_deduped
from facetwise.plans.registry import ORACLES, register
from facetwise.sources import feeds
from facetwise.sources.snapshots import snapshot

CELL = ", ".join(MX.CELL)


def stock_df(spark, d):
    return MX.stock_cells(base.matched(spark, d))


def ev_df(spark, d):
    return MX.ev_cells(EV.with_master_range(fixtures.evidence(spark, d)))


def mkt_cells(spark, d):
    return MX.live_market_cells(base.market(spark, d), feeds.LISTING_ORDER)


def inv_cells(spark, d):
    return MX.live_inventory_cells(base.inventory(spark, d), feeds.LISTING_ORDER)


def comparables(spark, d):
    m = MX.binned(live_status_filter(base.market(spark, d), "market"))
    i = MX.binned(live_status_filter(base.inventory(spark, d), "inventory"))
    return MX.last_listings(matching.comparable_listings(m, i), feeds.LISTING_ORDER)


def cmp_cells(spark, d):
    return MX.comparable_cells(comparables(spark, d))


def q10_sql(src: str, keys: str, out: str) -> str:
    return f"""SELECT {keys}, ppc AS {out} FROM (SELECT {keys}, ppc, row_number() OVER (PARTITION BY {keys} ORDER BY ppc) AS rn,
      count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WHERE ppc IS NOT NULL AND color IS NOT NULL AND clarity IS NOT NULL) t
    WHERE rn - 1 = floor(CAST(n - 1 AS DOUBLE) * CAST(0.1 AS DOUBLE) + 0.5)"""


S.add("live_mkt", ["market"], f"""SELECT *, CASE WHEN carat <> 0 THEN price / carat END AS ppc FROM (
    SELECT *, {S.size_range('carat')} AS size_range FROM market WHERE upper(trim(status)) = 'ON HAND'
    QUALIFY row_number() OVER (PARTITION BY stone_id ORDER BY {S.LISTING_ORDER_DESC}) = 1) t WHERE size_range IS NOT NULL""")
S.add("mkt_cells", ["live_mkt"], f"""SELECT c.*, q.market_ppc FROM (SELECT {CELL}, count(*) AS pieces FROM live_mkt GROUP BY {CELL}) c
  LEFT JOIN ({q10_sql('live_mkt', CELL, 'market_ppc')}) q ON {S.eqj('c', 'q', MX.CELL)}""")
S.add("live_inv", ["inventory"], f"""SELECT * FROM (SELECT *, {S.size_range('carat')} AS size_range FROM inventory
    WHERE upper(trim(status)) = 'AVAILABLE') t WHERE size_range IS NOT NULL""")
S.add("inv_cells", ["live_inv"], f"""SELECT {CELL}, count(*) AS pieces, sum(carat) AS carats, sum(price) AS price FROM (
    SELECT * FROM live_inv QUALIFY row_number() OVER (PARTITION BY stone_id ORDER BY {S.LISTING_ORDER_DESC}) = 1) t GROUP BY {CELL}""")
PK = dims.PROFILE_KEYS
S.add("live_mkt_all", ["market"], f"""SELECT *, CASE WHEN carat <> 0 THEN price / carat END AS ppc FROM (
    SELECT *, {S.size_range('carat')} AS size_range FROM market WHERE upper(trim(status)) = 'ON HAND') t WHERE size_range IS NOT NULL""")
S.add("cmp_rows", ["live_mkt_all", "live_inv"], f"""SELECT * FROM live_mkt_all m WHERE EXISTS (SELECT 1 FROM live_inv i WHERE {S.eqj('m', 'i', PK)})
  QUALIFY row_number() OVER (PARTITION BY stone_id ORDER BY {S.LISTING_ORDER_DESC}) = 1""")
S.add("cmp_cells", ["cmp_rows"], f"""SELECT c.*, q.market_ppc FROM (SELECT {CELL}, count(*) AS pieces FROM cmp_rows GROUP BY {CELL}) c
  LEFT JOIN ({q10_sql('cmp_rows', CELL, 'market_ppc')}) q ON {S.eqj('c', 'q', MX.CELL)}""")


@register("live_market_cells", S.with_ctes(f"SELECT {CELL}, pieces, {S.rnd('market_ppc', 4)} AS market_ppc FROM mkt_cells", "mkt_cells"))
def live_market_cells(spark, d):
    return mkt_cells(spark, d).select(*MX.CELL, "pieces", rnd(F.col("market_ppc"), 4).alias("market_ppc"))


@register("live_inventory_cells", S.with_ctes(
    f"SELECT {CELL}, pieces, {S.rnd('carats', 2, True)} AS carats, {S.rnd('price', 2, True)} AS price FROM inv_cells", "inv_cells"))
def live_inventory_cells(spark, d):
    return inv_cells(spark, d).select(*MX.CELL, "pieces", rnd(F.col("carats"), 2, True).alias("carats"),
                                      rnd(F.col("price"), 2, True).alias("price"))


@register("profile_comparables", S.with_ctes(f"SELECT {CELL}, pieces, {S.rnd('market_ppc', 4)} AS market_ppc FROM cmp_cells", "cmp_cells"))
def profile_comparables(spark, d):
    """Live market rows with an identical live inventory profile, per cell."""
    return cmp_cells(spark, d).select(*MX.CELL, "pieces", rnd(F.col("market_ppc"), 4).alias("market_ppc"))


S.add("mx_stock", ["selling"], f"""SELECT size_range, shape, color, clarity, count(*) AS pcs, sum(carat) AS carats, sum(price) AS price,
    sum(recommended_selling_price) AS recommended, count(market_bottom_price) AS vdb_matches, count(market_p01_price) AS cmp_n,
    sum(CASE WHEN market_p01_price IS NOT NULL THEN carat END) AS cmp_carats, sum(market_p01_price) AS cmp_value,
    sum(CASE WHEN price IS NOT NULL THEN carat END) AS priced_carats
  FROM (SELECT *, {S.size_range('carat')} AS size_range FROM selling) t WHERE size_range IS NOT NULL GROUP BY ALL""")
S.add("mx_q", ["mx_stock", "sales_coh"], f"""SELECT s.*, l.sold_stones AS s_pcs, l.sold_carats AS s_carats, l.sales_value AS s_value
  FROM mx_stock s JOIN sales_coh l ON {S.eqj('s', 'l', dims.COHORT_KEYS)} WHERE l.sold_stones >= 5""")


@register("qualified_cohorts", S.with_ctes(f"""SELECT size_range, shape, color, clarity, pcs, {S.rnd('carats', 2, True)} AS carats,
    {S.rnd('price', 2, True)} AS price, s_pcs, {S.rnd('s_carats', 2, True)} AS s_carats, {S.rnd('s_value', 2, True)} AS s_value FROM mx_q""",
    "mx_q"))
def qualified_cohorts(spark, d):
    q = MX.qualified_cohorts(stock_df(spark, d), sales_cohorts_df(spark, d))
    return q.select("size_range", "shape", "color", "clarity", "pcs", rnd(F.col("carats"), 2, True).alias("carats"),
                    rnd(F.col("price"), 2, True).alias("price"), "s_pcs", rnd(F.col("s_carats"), 2, True).alias("s_carats"),
                    rnd(F.col("s_value"), 2, True).alias("s_value"))


GRID = " CROSS JOIN ".join([S.size_master_values(),
                            "(VALUES " + ", ".join(f"('{c}')" for c in dims.MATRIX_COLORS) + ") AS co(color)",
                            "(VALUES " + ", ".join(f"('{c}')" for c in dims.MATRIX_CLARITIES) + ") AS cl(clarity)"])


@register("matrix_scaffold", S.with_ctes(f"""SELECT g.size_range, g.color, g.clarity, coalesce(c.pieces, 0) AS pieces
  FROM (SELECT sm.size_range, co.color, cl.clarity FROM {GRID}) g LEFT JOIN inv_cells c ON {S.eqj('g', 'c', MX.CELL)}""", "inv_cells"))
def matrix_scaffold(spark, d):
    """Dense 63 x 4 x 8 grid with live inventory pieces (empty cells kept)."""
    grid = F.broadcast(MX.scaffold(spark, dims.MATRIX_COLORS, dims.MATRIX_CLARITIES))
    cells = inv_cells(spark, d).select(*MX.CELL, "pieces")
    return grid.join(cells, MX.CELL, "left").select(*MX.CELL, F.coalesce(F.col("pieces"), F.lit(0)).alias("pieces"))


def build_cells(spark, d, filters=None, by_shape=False):
    """Pricing cells under dashboard filters: ``shape`` selects every source but evidence;
    grades, lab, country and growth type select the market, the inventory (not by country
    or growth type) and sales that have such columns. ``by_shape``: ALL and each shape."""
    filters = filters or {}
    pick = lambda df, side: quality_filter(shape_filter(df, filters.get("shape")), filters, side)
    shaped = MX.with_shapes if by_shape else (lambda df: df)
    market, inventory = pick(base.market(spark, d), "market"), pick(base.inventory(spark, d), "inventory")
    sales = pick(sales_deduped(spark, d), "sales")
    stock = MX.stock_cells(shape_filter(base.matched(spark, d), filters.get("shape")))
    cohorts = sales_cohorts(sales)
    live_m, live_i = (MX.binned(live_status_filter(df, side)) for df, side in ((market, "market"), (inventory, "inventory")))
    comparable = MX.last_listings(shaped(matching.comparable_listings(live_m, live_i)), feeds.LISTING_ORDER)
    shapes = None
    if by_shape:
        named = [df.select("shape") for df in (market, inventory, sales)]
        shapes = MX.with_shapes(named[0].unionByName(named[1]).unionByName(named[2]).where(F.col("shape").isNotNull()).distinct()).select(MX.SHAPES).distinct()
    return MX.range_color_clarity_matrix(spark, shaped(stock), shaped(cohorts), ev_df(spark, d), MX.live_inventory_cells(shaped(inventory), feeds.LISTING_ORDER),
                                         MX.live_market_cells(shaped(market), feeds.LISTING_ORDER), MX.comparable_cells(comparable), shapes)


def cells_df(spark, d):
    """The unfiltered cells, computed once and read back by every projection of them."""
    return snapshot(spark, d, "cells", build_cells)


def shape_cells_df(spark, d):
    return snapshot(spark, d, "cells_by_shape", lambda s, x: build_cells(s, x, by_shape=True))


def cells_sql(p, filters=None, by_shape=False):
    """CTEs of the same cells; their last one is ``{p}_cells``."""
    filters = filters or {}
    sel = "unnest(['ALL', shape])" if by_shape else "'ALL'"
    shape = f" AND shape = '{filters['shape']}'" if "shape" in filters else ""
    grades = {k: v for k, v in filters.items() if k != "shape"}
    three = " AND cut = 'EXCELLENT' AND polish = 'EXCELLENT' AND symmetry = 'EXCELLENT'" if grades.get("cut") == "3X" else ""
    grade = lambda names: three + "".join(f" AND {k} IN ('EXCELLENT', 'IDEAL')" if v == "EX_OR_IDEAL" else f" AND {k} = '{v}'" for k, v in grades.items() if k in names and v != "3X")
    own = grade(("cut", "polish", "symmetry", "fluorescence", "lab"))
    market = grade(("cut", "polish", "symmetry", "fluorescence", "lab", "country"))
    keys, order = f"shape_sel, {CELL}", S.LISTING_ORDER_DESC
    kj = lambda a, b: S.eqj(a, b, ["shape_sel", *MX.CELL])
    last = lambda src: f"SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY shape_sel, stone_id ORDER BY {order}) = 1"
    ppc = "CASE WHEN carat <> 0 THEN price / carat END AS ppc"
    cell = lambda src: f"""SELECT c.*, q.market_ppc FROM (SELECT {keys}, count(*) AS pieces FROM {src} GROUP BY {keys}) c
      LEFT JOIN ({q10_sql(src, keys, 'market_ppc')}) q ON {kj('c', 'q')}"""  # noqa: E731
    binned = lambda src: f"SELECT * FROM (SELECT *, {S.size_range('carat')} AS size_range FROM ({src}) b) t WHERE size_range IS NOT NULL"
    S.add(f"{p}_m", ["market"], f"SELECT *, {ppc}, {sel} AS shape_sel FROM market WHERE upper(trim(status)) = 'ON HAND'{shape}{market}")
    S.add(f"{p}_i", ["inventory"], f"SELECT *, {sel} AS shape_sel FROM inventory WHERE upper(trim(status)) = 'AVAILABLE'{shape}{own}")
    S.add(f"{p}_mr", [f"{p}_m"], binned(last(f"{p}_m")))
    S.add(f"{p}_mc", [f"{p}_mr"], cell(f"{p}_mr"))
    S.add(f"{p}_ic", [f"{p}_i"], f"SELECT {keys}, count(*) AS pieces, sum(carat) AS carats, sum(price) AS price FROM ({binned(last(f'{p}_i'))}) t GROUP BY {keys}")
    S.add(f"{p}_cr", [f"{p}_m", f"{p}_i"], f"""SELECT * FROM ({binned(f'SELECT * FROM {p}_m')}) m
      WHERE EXISTS (SELECT 1 FROM ({binned(f'SELECT * FROM {p}_i')}) i WHERE {S.eqj('m', 'i', PK)})
      QUALIFY row_number() OVER (PARTITION BY shape_sel, stone_id ORDER BY {order}) = 1""")
    S.add(f"{p}_cc", [f"{p}_cr"], cell(f"{p}_cr"))
    where = shape.replace(" AND ", " WHERE ", 1)
    S.add(f"{p}_st", ["mx_stock"], f"SELECT *, {sel} AS shape_sel FROM mx_stock{where}")
    S.add(f"{p}_sl", ["sales_coh"], f"SELECT *, {sel} AS shape_sel FROM sales_coh{where}")
    S.add(f"{p}_q", [f"{p}_st", f"{p}_sl"], f"""SELECT s.shape_sel, s.size_range, s.color, s.clarity, sum(s.carats) AS mw, sum(s.price) AS mv, sum(l.sold_carats) AS msw, sum(l.sales_value) AS msv
      FROM {p}_st s JOIN {p}_sl l ON {S.eqj('s', 'l', ['shape_sel', *dims.COHORT_KEYS])} WHERE l.sold_stones >= 5 GROUP BY ALL""")
    shapes = "SELECT 'ALL' AS shape_sel" + (" UNION SELECT shape FROM market WHERE shape IS NOT NULL UNION SELECT shape FROM inventory WHERE shape IS NOT NULL UNION SELECT shape FROM sales_d WHERE shape IS NOT NULL" if by_shape else "")
    S.add(f"{p}_g", ["market", "inventory", "sales_d"], f"SELECT shape_sel, sm.size_range, co.color, cl.clarity FROM ({shapes}) sh CROSS JOIN {GRID}")
    S.add(f"{p}_j", [f"{p}_g", f"{p}_st", f"{p}_sl", f"{p}_q", f"{p}_ic", f"{p}_mc", f"{p}_cc", "ev_ranged"], f"""SELECT g.*, coalesce(ic.pieces, 0) AS pieces, coalesce(st.n, 0) AS cstock, coalesce(sl.n, 0) AS csold,
        coalesce(mc.pieces, 0) AS vpieces, coalesce(st.cmp_n, 0) AS cmp_n, e.ev_price, coalesce(e.ev_stock, 0) AS evs, coalesce(e.ev_sold, 0) AS evd,
        CASE WHEN coalesce(ic.pieces, 0) > 0 THEN coalesce(sl.n, 0) / ic.pieces * 100 END AS spct,
        CASE WHEN coalesce(ic.carats <> 0, false) THEN coalesce(ic.price, 0.0) / ic.carats WHEN st.n > 0 AND st.pc <> 0 THEN st.pv / st.pc END AS dp,
        coalesce(CASE WHEN st.n > 0 AND st.cmp_carats <> 0 THEN st.cmp_value / st.cmp_carats END, cc.market_ppc, mc.market_ppc) AS vdb,
        {_div('q.mv', 'q.mw')} AS mcur, coalesce({_div('q.msv', 'q.msw')}, {_div('sl.v', 'sl.c')}) AS hist
      FROM {p}_g g
      LEFT JOIN (SELECT {keys}, sum(pcs) AS n, sum(cmp_n) AS cmp_n, sum(cmp_carats) AS cmp_carats, sum(cmp_value) AS cmp_value, sum(priced_carats) AS pc, sum(price) AS pv FROM {p}_st GROUP BY {keys}) st ON {kj('g', 'st')}
      LEFT JOIN (SELECT {keys}, sum(sold_stones) AS n, sum(sold_carats) AS c, sum(sales_value) AS v FROM {p}_sl GROUP BY {keys}) sl ON {kj('g', 'sl')}
      LEFT JOIN {p}_q q ON {kj('g', 'q')} LEFT JOIN {p}_ic ic ON {kj('g', 'ic')} LEFT JOIN {p}_mc mc ON {kj('g', 'mc')} LEFT JOIN {p}_cc cc ON {kj('g', 'cc')}
      LEFT JOIN (SELECT size_range, "Color" AS color, "Clarity" AS clarity, sum("EV_Stock") AS ev_stock, sum("EV_Sold") AS ev_sold, avg("Stock_Metric") AS ev_price
        FROM ev_ranged WHERE size_range IS NOT NULL GROUP BY 1, 2, 3) e ON {S.eqj('g', 'e', MX.CELL)}""")
    S.add(f"{p}_k", [f"{p}_j"], f"""SELECT *, coalesce(dp, mcur) AS cur, CASE WHEN evs + evd > 0 THEN evd / (evs + evd) * 100 END AS epct, {S.price_band('spct')} AS adj
      FROM {p}_j WHERE pieces > 0 OR cstock > 0 OR csold > 0 OR ev_price IS NOT NULL""")
    change, basis = "CAST(round(adj * 100) AS INTEGER)", "cur IS NOT NULL AND spct IS NOT NULL"
    S.add(f"{p}_cells", [f"{p}_k"], f"""SELECT * EXCLUDE (demand_, ai_), demand_ AS demand_score, CASE WHEN demand_ IS NOT NULL THEN {S.rnd('100.0 - demand_', 1)} END AS inventory_risk_score, demand_ AS clearance_score,
      {_r2_sql('ai_')} AS ai_price, CASE WHEN ai_ IS NOT NULL AND coalesce(cur_ <> 0, false) THEN {S.rnd('(ai_ - cur_) / cur_ * 100', 1)} END AS discount_markup_pct
      FROM (SELECT shape_sel, size_range, color, clarity, CAST(pieces AS BIGINT) AS pieces, CAST(csold AS BIGINT) AS sold, {S.rnd('spct', 1)} AS sales_pct, CAST(vpieces AS BIGINT) AS vdb_pieces,
        CASE WHEN cstock > 0 THEN {S.rnd('cmp_n / cstock * 100', 1)} END AS vdb_match_pct, {S.rnd('epct', 1)} AS ev_sold_pct, {S.rnd('spct', 1)} AS historical_sales_ratio,
        CASE WHEN spct IS NOT NULL AND epct IS NOT NULL THEN {S.rnd('spct * 0.6 + epct * 0.4', 1)} WHEN spct IS NOT NULL THEN {S.rnd('spct', 1)} END AS demand_,
        {_r2_sql('vdb')} AS vdb_price, {_r2_sql('ev_price')} AS ev_price, {_r2_sql('dp')} AS diamax_price, {_r2_sql('cur')} AS current_price, {_r2_sql('hist')} AS historical_price,
        cur AS cur_, CASE WHEN {basis} THEN cur * (1.0 + adj) END AS ai_,
        CASE WHEN pieces = 0 THEN 'No Data Available' WHEN csold = 0 THEN 'Dead Inventory' WHEN coalesce(spct, 0) < 20 THEN 'Overstock' WHEN coalesce(spct, 0) < 40 THEN 'Slow Moving'
          WHEN csold > pieces THEN 'Understock' ELSE 'Healthy' END AS inventory_status,
        CASE WHEN NOT ({basis}) THEN 'No price basis' WHEN {change} < 0 THEN 'Reduce ' || abs({change}) || '%' WHEN {change} > 0 THEN 'Increase ' || {change} || '%' ELSE 'Hold price' END AS recommendation,
        CASE WHEN {basis} THEN 'SOLD_PCT_BAND:' || {change} ELSE 'NO_PRICE_BASIS' END AS ai_context FROM {p}_k) r""")
    return f"{p}_cells"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN {a} / {b} END)"


def _r2_sql(e: str) -> str:
    return f"CASE WHEN coalesce(({e}) <> 0, false) THEN {S.rnd(e)} END"


CELLS = cells_sql("cl")
FILTERS = {"shape": "ROUND", "cut": "3X", "lab": "GIA", "country": "ASIA"}
FILTERED = cells_sql("clf", FILTERS)
SHAPED = cells_sql("cls", by_shape=True)


def from_cells(columns: list[str], cells: str = CELLS) -> str:
    return S.with_ctes(f"SELECT {', '.join(columns)} FROM {cells}", cells)


def _cells_query(name: str, columns: list[str], doc: str):
    def run(spark, d):
        return cells_df(spark, d).select(*columns)
    run.__doc__, run.__name__ = doc, name
    return register(name, from_cells(columns))(run)


range_color_clarity_matrix = _cells_query("range_color_clarity_matrix", MX.CELL_OUT, "Pricing cells of range, color and clarity.")
matrix_cell_prices = _cells_query("matrix_cell_prices", [*MX.CELL, "diamax_price", "current_price", "vdb_price", "historical_price"],
                                  "Priority-fallback cell prices: own = live cell -> matched; market = matched 1st-percentile benchmark -> exact-profile q10 -> live q10.")
inventory_status = _cells_query("inventory_status", [*MX.CELL, "pieces", "sold", "sales_pct", "inventory_status"], "Status class of each cell.")
demand_score = _cells_query("demand_score", [*MX.CELL, "sales_pct", "ev_sold_pct", "demand_score", "inventory_risk_score"], "Blended demand and risk.")


@register("filtered_matrix", from_cells(MX.CELL_OUT, FILTERED))
def filtered_matrix(spark, d):
    """Pricing cells under dashboard filters: ROUND, 3X, one lab, one market country."""
    return build_cells(spark, d, FILTERS).select(*MX.CELL_OUT)


@register("matrix_all_shapes", from_cells([MX.SHAPES, *MX.CELL_OUT], SHAPED))
def matrix_all_shapes(spark, d):
    """The whole matrix for ALL and each shape, from one scan of each input."""
    return shape_cells_df(spark, d).select(MX.SHAPES, *MX.CELL_OUT)


S.add("pm_base", ["selling"], f"SELECT * FROM (SELECT *, {S.size_range('carat')} AS size_range FROM selling) t WHERE size_range IS NOT NULL")
PM_CLAR = ", ".join(f"'{c}'" for c in dims.PRICE_MATRIX_CLARITIES)
PM_COL = ", ".join(f"'{c}'" for c in dims.PRICE_MATRIX_COLORS)


def ppc_sql(a: str) -> str:
    return f"CASE WHEN avg(carat) > 0 THEN {S.rnd(f'avg({a}) / avg(carat)', 0)} ELSE {S.rnd(f'avg({a})', 0)} END"


@register("price_matrix", S.with_ctes(f"""SELECT g.*, c.* EXCLUDE (size_range, color, clarity, count), coalesce(c.count, 0) AS count,
    coalesce(t.total_stones, 0) AS total_stones, coalesce(h.has_data, false) AS has_data
  FROM (SELECT sm.size_range, co.color, cl.clarity FROM {S.size_master_values()}
    CROSS JOIN (SELECT unnest([{PM_COL}]) AS color) co CROSS JOIN (SELECT unnest([{PM_CLAR}]) AS clarity) cl) g LEFT JOIN (
    SELECT size_range, color, clarity, {S.rnd('avg(effective_market_price)')} AS market_avg, {S.rnd('avg(price)')} AS own_avg,
      {S.rnd('avg(recommended_selling_price)')} AS rec_avg, {S.rnd('avg(min_selling_price)')} AS min_avg,
      {S.rnd('avg(premium_selling_price)')} AS prem_avg, {ppc_sql('effective_market_price')} AS market_ppc,
      {ppc_sql('price')} AS own_ppc, {ppc_sql('recommended_selling_price')} AS rec_ppc, {S.rnd('avg(profit_pct)', 1)} AS profit_pct,
      count(*) AS count FROM pm_base WHERE color IN ({PM_COL}) AND clarity IN ({PM_CLAR}) GROUP BY ALL) c
    ON c.size_range = g.size_range AND c.color = g.color AND c.clarity = g.clarity
  LEFT JOIN (SELECT size_range, count(*) AS total_stones FROM pm_base GROUP BY ALL) t ON g.size_range = t.size_range
  LEFT JOIN (SELECT size_range, color, count(*) > 0 AS has_data FROM pm_base WHERE clarity IN ({PM_CLAR}) GROUP BY ALL) h
    ON g.size_range = h.size_range AND g.color = h.color""", "pm_base"))
def price_matrix(spark, d):
    """Dense grid of every range, color D-K and clarity VVS1-SI2: mean prices,
    per-carat prices (integers), margin and count, null prices and count 0 where no
    stone is; range total and (range, color) has-data."""
    m = MX.binned(base.matched(spark, d))
    cells = m.where(F.col("color").isin(*dims.PRICE_MATRIX_COLORS) & F.col("clarity").isin(*dims.PRICE_MATRIX_CLARITIES))

    def ppc(a):
        return F.when(F.avg("carat") > 0, rnd(F.avg(a) / F.avg("carat"), 0)).otherwise(rnd(F.avg(a), 0))

    c = cells.groupBy(*MX.CELL).agg(
        rnd(F.avg("effective_market_price")).alias("market_avg"), rnd(F.avg("price")).alias("own_avg"),
        rnd(F.avg("recommended_selling_price")).alias("rec_avg"), rnd(F.avg("min_selling_price")).alias("min_avg"),
        rnd(F.avg("premium_selling_price")).alias("prem_avg"), ppc("effective_market_price").alias("market_ppc"),
        ppc("price").alias("own_ppc"), ppc("recommended_selling_price").alias("rec_ppc"),
        rnd(F.avg("profit_pct"), 1).alias("profit_pct"), F.count(F.lit(1)).alias("count"))
    t = m.groupBy("size_range").agg(F.count(F.lit(1)).alias("total_stones"))
    h = m.where(F.col("clarity").isin(*dims.PRICE_MATRIX_CLARITIES)).groupBy("size_range", "color").agg(
        (F.count(F.lit(1)) > 0).alias("has_data"))
    grid = F.broadcast(MX.scaffold(spark, dims.PRICE_MATRIX_COLORS, dims.PRICE_MATRIX_CLARITIES).select(*MX.CELL))  # 3024 rows
    out = grid.join(c, MX.CELL, "left").join(t, "size_range", "left").join(h, ["size_range", "color"], "left")
    return out.fillna({"count": 0, "total_stones": 0, "has_data": False})


# ------------------------------------------------ SQL oracles for the matrices

S.add("rm0", ["mx_stock", "sales_coh", "mx_q", "ev_ranged"], f"""SELECT sm.ordinal, sm.size_range,
    coalesce(st.stock_pcs, 0) AS stock_pcs, coalesce(sl.sold_pcs, 0) AS sold, coalesce(st.vm, 0) AS vm,
    coalesce(q.m_stock, 0) AS ms, coalesce(q.m_sold, 0) AS msold, q.mw, q.mv, q.msw, q.msv,
    coalesce(e.ev_stock, 0) AS ev_stock, coalesce(e.ev_sold, 0) AS ev_sold
  FROM {S.size_master_values()}
  LEFT JOIN (SELECT size_range, sum(pcs) AS stock_pcs, sum(vdb_matches) AS vm FROM mx_stock GROUP BY 1) st ON sm.size_range = st.size_range
  LEFT JOIN (SELECT size_range, sum(sold_stones) AS sold_pcs FROM sales_coh GROUP BY 1) sl ON sm.size_range = sl.size_range
  LEFT JOIN (SELECT size_range, sum(pcs) AS m_stock, sum(carats) AS mw, sum(price) AS mv, sum(s_pcs) AS m_sold,
      sum(s_carats) AS msw, sum(s_value) AS msv FROM mx_q GROUP BY 1) q ON sm.size_range = q.size_range
  LEFT JOIN (SELECT size_range, sum("EV_Stock") AS ev_stock, sum("EV_Sold") AS ev_sold FROM ev_ranged
      WHERE size_range IS NOT NULL GROUP BY 1) e ON sm.size_range = e.size_range""")
S.add("rm1", ["rm0"], f"""SELECT *, CASE WHEN spct IS NOT NULL AND epct IS NOT NULL THEN {S.rnd('spct * 0.6 + epct * 0.4', 1)}
      WHEN spct IS NOT NULL THEN {S.rnd('spct', 1)} END AS demand FROM (
  SELECT *, CASE WHEN stock_pcs > 0 THEN sold / stock_pcs * 100 END AS spct,
    CASE WHEN ev_stock + ev_sold > 0 THEN ev_sold / (ev_stock + ev_sold) * 100 END AS epct,
    {_div('mv', 'mw')} AS cur, {_div('msv', 'msw')} AS hist, msold >= 5 AND ms > 0 AS sufficient,
    CASE WHEN ms > 0 THEN msold / ms * 100 END AS r FROM rm0) t""")
RM_REC = """CASE WHEN NOT sufficient THEN 'INSUFFICIENT_SALES'
      WHEN r < 20 AND ms >= msold THEN 'LIQUIDATE_5' WHEN r < 40 THEN 'PROMOTE_2'
      WHEN r > 80 AND ms < msold THEN 'STOCK_MORE' WHEN coalesce(demand, 0.0) >= 60 THEN 'HOLD'
      ELSE 'TARGETED_2' END"""
RM_FACTOR = """CASE WHEN NOT sufficient THEN NULL WHEN r < 20 AND ms >= msold THEN 0.95 WHEN r < 40 THEN 0.98
      WHEN r > 80 AND ms < msold THEN 1.0 WHEN coalesce(demand, 0.0) >= 60 THEN 1.0 ELSE 0.98 END"""
FLAGS = [("Inventory", "stock_pcs > 0"), ("Own sales", "sold > 0"), ("Market", "vm > 0"), ("Evidence", "epct IS NOT NULL")]
AVAIL = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FLAGS) + ")"
MISSING = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in FLAGS) + ")"


@register("carat_matrix", S.with_ctes(f"""SELECT size_range, CAST(stock_pcs AS BIGINT) AS total_stock, CAST(sold AS BIGINT) AS total_sold,
    {S.rnd('spct', 1)} AS sales_pct, {S.rnd('100.0 - spct', 1)} AS stock_pct,
    CASE WHEN stock_pcs > 0 THEN {S.rnd('vm / stock_pcs * 100', 1)} END AS vdb_sold_pct, {S.rnd('epct', 1)} AS ev_sold_pct,
    demand AS demand_score, CASE WHEN demand IS NOT NULL THEN {S.rnd('100.0 - demand', 1)} END AS inventory_risk_score,
    {_r2_sql('cur')} AS current_price, {_r2_sql('hist')} AS historical_selling_price,
    {_r2_sql(f'cur * ({RM_FACTOR})')} AS suggested_price, demand AS clearance_score, {RM_REC} AS recommendation,
    CASE WHEN sufficient AND vm > 0 AND epct IS NOT NULL THEN 'FULL'
      WHEN sufficient THEN 'STOCK_AND_SALES' ELSE 'WITHHELD' END AS confidence,
    CASE WHEN {AVAIL} = '' THEN 'NONE' ELSE {AVAIL} END AS available_data,
    CASE WHEN {MISSING} = '' THEN 'NONE' ELSE {MISSING} END AS missing_data,
    CASE WHEN {MISSING} = '' THEN 'COMPLETE' WHEN {AVAIL} <> '' THEN 'PARTIAL' ELSE 'NO_DATA' END AS data_coverage,
    format('{{:,}}', CAST(ms AS BIGINT)) || ' of ' || format('{{:,}}', CAST(msold AS BIGINT))
      || ' by cohort' AS price_match_basis
  FROM rm1""", "rm1"))
def carat_matrix(spark, d):
    return MX.carat_matrix(spark, stock_df(spark, d), sales_cohorts_df(spark, d), ev_df(spark, d)).select(*MX.RANGE_OUT)


COLS4 = "(VALUES " + ", ".join(f"('{c}')" for c in dims.MATRIX_COLORS) + ") AS co(color)"
S.add("cm0", ["mx_stock", "sales_coh", "mx_q", "ev_ranged"], f"""SELECT g.size_range, g.color,
    coalesce(st.stock, 0) AS stock, coalesce(sl.sold, 0) AS sold, coalesce(q.m_stock, 0) AS ms, coalesce(q.m_sold, 0) AS msold,
    q.mw, q.mv, coalesce(e.ev_stock, 0) AS ev_stock, coalesce(e.ev_sold, 0) AS ev_sold
  FROM (SELECT sm.size_range, co.color FROM {S.size_master_values()} CROSS JOIN {COLS4}) g
  LEFT JOIN (SELECT size_range, color, sum(pcs) AS stock FROM mx_stock GROUP BY 1, 2) st ON g.size_range = st.size_range AND g.color = st.color
  LEFT JOIN (SELECT size_range, color, sum(sold_stones) AS sold FROM sales_coh GROUP BY 1, 2) sl ON g.size_range = sl.size_range AND g.color = sl.color
  LEFT JOIN (SELECT size_range, color, sum(pcs) AS m_stock, sum(carats) AS mw, sum(price) AS mv, sum(s_pcs) AS m_sold FROM mx_q GROUP BY 1, 2) q
    ON g.size_range = q.size_range AND g.color = q.color
  LEFT JOIN (SELECT size_range, "Color" AS color, sum("EV_Stock") AS ev_stock, sum("EV_Sold") AS ev_sold FROM ev_ranged
      WHERE size_range IS NOT NULL GROUP BY 1, 2) e ON g.size_range = e.size_range AND g.color = e.color""")
S.add("cm1", ["cm0"], f"""SELECT *, CASE WHEN stock > 0 THEN sold / stock * 100 END AS spct,
    CASE WHEN ev_stock + ev_sold > 0 THEN ev_sold / (ev_stock + ev_sold) * 100 END AS epct,
    {_div('mv', 'mw')} AS cur, CASE WHEN ms > 0 THEN msold / ms * 100 END AS pp FROM cm0""")
CM_REC = """CASE WHEN cur IS NULL OR msold < 5 THEN 'INSUFFICIENT_SALES' WHEN pp < 20 AND ms >= msold THEN 'REDUCE_5'
      WHEN pp < 40 THEN 'REDUCE_2' WHEN pp > 80 AND ms < msold THEN 'STOCK_MORE' ELSE 'HOLD' END"""
CM_FACTOR = """CASE WHEN cur IS NULL OR msold < 5 THEN NULL WHEN pp < 20 AND ms >= msold THEN 0.95 WHEN pp < 40 THEN 0.98 ELSE 1.0 END"""


@register("range_color_matrix", S.with_ctes(f"""SELECT size_range, color, CAST(stock AS BIGINT) AS stock, CAST(sold AS BIGINT) AS sold,
    {S.rnd('spct', 1)} AS sales_pct, CASE WHEN spct IS NOT NULL AND epct IS NOT NULL THEN {S.rnd('spct * 0.6 + epct * 0.4', 1)} END AS demand_score,
    {_r2_sql('cur')} AS current_price, {_r2_sql(f'cur * ({CM_FACTOR})')} AS suggested_price, {CM_REC} AS recommendation,
    CAST(ms AS BIGINT) AS matched_stock, CAST(msold AS BIGINT) AS matched_sales FROM cm1""", "cm1"))
def range_color_matrix(spark, d):
    return MX.range_color_matrix(spark, stock_df(spark, d), sales_cohorts_df(spark, d), ev_df(spark, d)).select(*MX.COLOR_OUT)


@register("data_coverage", f"SELECT size_range, available_data, missing_data, data_coverage FROM ({ORACLES['carat_matrix']})")
def data_coverage(spark, d):
    return MX.carat_matrix(spark, stock_df(spark, d), sales_cohorts_df(spark, d), ev_df(spark, d)).select(
        "size_range", "available_data", "missing_data", "data_coverage")
